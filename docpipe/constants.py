"""Values that must equal the behaviour being rebuilt.

Everything below the FIXED VALUES marker is plain data: phrase lists, word lists, thresholds
and message formats, kept in their natural order. Code elsewhere builds regular
expressions and expressions from these lists; nothing here is logic.
"""

# ---------------------------------------------------------------------------------------
# FIXED VALUES — must stay equal to the original tool's observable results.
# ---------------------------------------------------------------------------------------

# Document profile thresholds.
PAGE_TEXT_LIMIT = 64000            # characters; a page with more "exceeds 64kb"
FILE_SIZE_LIMIT_MB = 300.0         # file-size flag
IMAGE_HEAVY_PAGE_LIMIT = 35        # a page with more images is "image heavy"
FILE_SIZE_WARNING_MB = 200.0       # recommendation threshold
OPTIMIZE_SIZE_THRESHOLD_MB = 50.0  # routing: optimise above this size
OPTIMIZE_IMAGE_THRESHOLD = 10      # routing: optimise above this many images

# Recommendations, in the order they are emitted. The third one is a format with the count.
RECOMMEND_REMOVE_IMAGES = "Remove images to reduce file size and processing time"
RECOMMEND_FILE_SIZE = "File size approaching LlamaParse limit - optimization recommended"
RECOMMEND_TEXT_LIMIT_FMT = "%d pages may exceed 64KB text limit"

# Chunking.
DEFAULT_CHUNK_SIZE = 15
DEFAULT_CHUNK_THRESHOLD = 20
SMALL_DOC_PAGES = 10     # pages <= 10 -> chunk size 5 (when the default size is in use)
SMALL_DOC_CHUNK = 5
MEDIUM_DOC_PAGES = 30    # pages <= 30 -> chunk size 10
MEDIUM_DOC_CHUNK = 10
CHUNK_JOB_ID_FMT = "%s_chunk_%02d_of_%02d"
CHUNK_MARKER_FMT = "<!-- Pages %s -->"
CHUNK_FAILED_FMT = "<!-- ERROR: Chunk %s failed: %s -->"
CHUNK_EXCEPTION_FMT = "<!-- ERROR: Chunk %s error: %s -->"
CHUNK_ERROR_PREFIX = "<!-- ERROR"
UNKNOWN_ERROR = "Unknown error"
UNKNOWN_ERROR_TYPE = "UnknownError"
CHUNKED_MODEL_FMT = "%s (chunked: %d/%d chunks)"
CHUNKED_PAGES_FMT = "all (%d chunks)"
FALLBACK_MODEL_FMT = "%s (OCR fallback - formatting reduced)"
CHUNKED_STAGE = "completed_chunked"

# Page join used when a converter returns one text per page.
PAGE_SEPARATOR = "\n\n---\n\n"

# Job monitor.
SLOW_JOB_SECONDS = 300
HUNG_JOB_SECONDS = 600
LONG_WAIT_SECONDS = 120
RECENT_JOBS_LIMIT = 10
STATUS_STYLES = [("completed", "green"), ("failed", "red"), ("started", "yellow")]
DEFAULT_STATUS_STYLE = "white"
WAITING_STAGE = "waiting_for_chat_response"

# Preview of a result text.
PREVIEW_CHARS = 500

# Response cleaner, block pass: indicator phrases (lower case, tested as substrings).
BLOCK_INDICATORS = [
    "all formatting has been preserved as per your requirements",
    "all formatting has been preserved as specified",
    "all formatting has been preserved as requested",
    "here is the converted document with all formatting preserved",
    "here is the document converted to markdown with all formatting preserved",
    "bold** text converted to",
    "italic* text converted to",
    "**bold** text converted to",
    "*italic* text converted to",
    "***bold-italic*** text converted to",
    "bold** markdown",
    "italic* markdown",
    "bold-italic*** text converted",
    "equipment descriptions preserved as",
    "```markdown",
]

# Block pass: a block holding any of these substrings is real content and is kept.
BLOCK_SUBJECT_WORDS = [
    "move", "roll", "dice", "stat", "character", "player", "gm", "master",
    "damage", "health", "armor", "weapon", "spell", "ability", "skill",
    "chapter", "section", "rule", "mechanic", "fellowship", "adventure",
    "game", "table", "example", "story", "narrative",
]

# Block pass: after deleting the indicators, these samples are deleted in this order.
BLOCK_FORMAT_SAMPLES = [
    "**bold**", "*italic*", "***bold-italic***",
    "`**bold**`", "`*italic*`", "`***bold-italic***`",
    "text converted to", "preserved as", "markdown",
    "- **Bold**", "- *Italic*", "- ***Bold-italic***",
    "equipment descriptions", "```markdown", "```",
]

BLOCK_MAX_LINES = 15       # a removable block has at most this many lines, markers included
BLOCK_MAX_RESIDUAL = 50    # and fewer than this many characters of remaining content
BLOCK_MARKER = "---"

# Response cleaner, line pass: a line containing any of these (case-insensitive) is dropped.
CHATTER_PHRASES = [
    "Here is the converted document with all formatting preserved as per your requirements:",
    "Here is the converted markdown text with all formatting preserved as per your requirements:",
    "Here is the converted markdown with all formatting preserved as specified:",
    "Here is the converted markdown text with all formatting preserved as specified:",
    "Here is the converted document with formatting preserved:",
    "Here is the document converted to Markdown with all formatting preserved:",
    "Here is the document converted to markdown with all formatting preserved as specified:",
    "Here is the document converted to markdown with all formatting preserved as per your requirements:",
    "Here is the document converted to markdown with all formatting preserved as per the requirements:",
    "Here is the PDF converted to Markdown format:",
    "Converting the PDF to markdown format with formatting preservation:",
    "Here is the markdown conversion with formatting preserved:",
    "I'll convert this PDF to Markdown while preserving all formatting:",
    "Here's the document converted to Markdown with formatting preserved:",
    "Converting this document to Markdown with all formatting preserved:",
    "Here is the conversion with all formatting requirements met:",
    "All formatting has been preserved as per your requirements.",
    "All formatting has been preserved as specified.",
    "All formatting has been preserved as requested.",
    "All formatting has been preserved as per the requirements.",
    "All formatting has been preserved as specified, including:",
    "All formatting has been preserved as requested, including:",
    "All formatting has been preserved as specified, including **bold**, *italic*, and ***bold-italic*** text.",
    "The formatting has been preserved as requested.",
    "The formatting has been preserved as specified.",
    "Formatting preserved as requested.",
    "Formatting preserved as specified.",
    "- **Bold** text converted to `**bold**`",
    "- *Italic* text converted to `*italic*`",
    "- ***Bold-italic*** text converted to `***bold-italic***`",
    "- *Italic* equipment descriptions preserved as `*italic*`",
    "```markdown",
]

PAGE_MARKER_PREFIX = "<!-- Pages "
PAGE_MARKER_SUFFIX = " -->"
CODE_FENCE = "```"

# Emphasis rules (applied per line, in this order).
MOVE_CLAUSE_PATTERN = r"When you ([^,]+)(?:,|:)"      # -> "When you **X**,"
ROLL_PATTERN = r"roll\+(\w+)"                          # -> "roll+**X**"
STAT_WORDS = ["cool", "hard", "hot", "sharp", "weird", "Hx"]   # whole word, any case -> "**X**"

# Python's str.strip() removes exactly the characters for which str.isspace() is true; the
# set is built from that rule (all such characters lie below U+3001).
PY_WHITESPACE_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Key of the service section inside an existing JSON job record (holds the token usage).
JOB_RECORD_API_KEY = "mistral_api"

# Job identifiers and output names.
JOB_TS_FORMAT = "yyyyMMdd_HHmmss"
DATA_URI_PREFIX = "data:application/pdf;base64,"

# Prompt variants, in catalogue order. The texts are this project's own.
APPROACH_NAMES = ["default", "aggressive", "minimal", "llamaparse", "italic_focused",
                  "style_hunter", "ultra_precise", "laser_focused"]
