"""Markdown from simple HTML page markup.

This is the target format of the conversion (headings, bold, italic, lists, tables,
paragraphs) produced directly from structured markup where a page already has it, so no
remote model is needed for such pages. Tables are rebuilt row by row, the other rules are
regex replacements applied in order. Real pages leave tags open: emphasis and headings end
at their closing tag or, without one, at the next block or line break.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.functions.text import col_, let, py_strip

WS = r"[ \t\n\f\r]*"
#: Elements that end a line or block and with it any open emphasis (fixed values).
BLOCKS = ("p", "div", "ul", "ol", "li", "article", "section", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6",
          "body", "html", "footer", "header", "main", "br")
#: Non-content elements, dropped in one pass (the leftmost element wins, so nested ones go with it).
NON_CONTENT = (r"(?is)<script\b[^>]*>.*?</script" + WS + r">|<style\b[^>]*>.*?</style" + WS + r">|<!--.*?-->"
               r"|<head\b[^>]*>.*?</head" + WS + r">|<nav\b[^>]*>.*?</nav" + WS + ">")
#: Internal name of an item of a numbered list.
NUMBERED = "numbered-item"


def _run(names: str) -> str:
    """An element with its content, up to its closing tag or the next block, line break or tag of its kind.

    Possessive loops: a long run neither backtracks nor nests calls."""
    stop = "|".join((*names.split("|"), *BLOCKS, NUMBERED))
    return (rf"(?i)<(?:{names})\b[^>]*+>([^<]*+(?:<(?!/?(?:{stop})\b)[^<]*+)*+)(?:</(?:{names}){WS}>)?")


# Rules in order: pattern, replacement, and lower-case substrings of which one must occur in
# the page for the rule to have anything to match. Replacements introduce no tag, so a tag
# absent from the page cannot appear later: skipping a rule is exact.
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    *[(_run(f"h{n}"), "\n\n" + "#" * n + " $1\n\n", (f"<h{n}",)) for n in range(1, 7)],
    (_run("b|strong"), "**$1**", ("<b>", "<b ", "<strong")),
    (_run("i|em"), "*$1*", ("<i>", "<i ", "<em>", "<em ")),
    (r"(?i)<li\b[^>]*>", "\n- ", ("<li",)),
    (rf"(?i)<{NUMBERED}\b[^>]*>", "\n1. ", ("<ol",)),
    (r"(?i)<br" + WS + "/?>", "\n", ("<br",)),
    (r"(?i)</?(?:p|div|ul|ol|article|section|body|html|footer|header|main)\b[^>]*>", "\n\n", ("<",)),
    (r"<[^>]*>", "", ("<",)),
]

#: Named character references (fixed values); ``&amp;`` last so that ``&amp;lt;`` becomes ``&lt;``.
ENTITIES: list[tuple[str, str]] = [
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"),
    ("&deg;", "°"), ("&times;", "×"), ("&euro;", "€"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&apos;", "'"), ("&amp;", "&")]

# Tidy-up of the line structure.
LAYOUT_RULES: list[tuple[str, str]] = [
    (r"[ \t]+\n", "\n"),
    (r"\n[ \t]+", "\n"),
    (r"\n{3,}", "\n\n"),
]


def _where(present: Column, change, text: Column) -> Column:
    return let(text, lambda t: F.when(present, change(t)).otherwise(t))


def _contains(low: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | low.contains(needle)
    return out


def _pipe_row(row: Column) -> Column:
    cells = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</?t[dhr]\b|$)"), F.lit(1))
    flat = F.transform(cells, lambda c: F.replace(py_strip(F.regexp_replace(c, r"(?i)(?:<br[^>]*>|\s)+", " ")), F.lit("|"), F.lit("\\|")))
    return flat


def _tables(text: Column) -> Column:
    """Every table as pipe rows, the first row followed by the rule that Markdown asks for."""
    def table(piece: Column) -> Column:
        body = F.regexp_extract(piece, r"(?is)^(<table\b.*?)(?:</table\s*>|$)", 1)
        rest = F.regexp_replace(F.substr(piece, F.length(body) + 1), r"(?i)^</table\s*>", "")
        rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</?tr\b|$)"), F.lit(1))
        cells = F.filter(F.transform(rows, _pipe_row), lambda c: F.size(c) > 0)
        line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
        rule = lambda c: F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(c)))
        lines = F.transform(cells, lambda c, k: F.when(k == 0, F.concat(line(c), F.lit("\n"), rule(c))).otherwise(line(c)))
        return F.concat(F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\n"), rest)

    pieces = F.split(text, r"(?i)(?=<table\b)", -1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"(?i)^<table\b"), table(p)).otherwise(p)), "")


def _numbered_lists(text: Column) -> Column:
    """Items that stand directly in a numbered list get a name of their own."""
    pieces = F.split(text, r"(?i)(?=</?(?:ol|ul)\b)", -1)
    mark = lambda p: F.regexp_replace(p, r"(?i)<li\b", f"<{NUMBERED}")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"(?i)^<ol\b"), mark(p)).otherwise(p)), "")


def _numeric_references(text: Column) -> Column:
    """``&#233;`` and ``&#xE9;`` as the character; references to no character stay."""
    def char(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"(?i)^&#x?([0-9a-f]+);$", 1)
        code = F.when(ref.rlike("(?i)^&#x"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        ok = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(ref)

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)(&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});)"), F.lit(1)))
    return F.aggregate(refs, text, lambda t, ref: F.replace(t, ref, char(ref)))


def markup_to_markdown(html: Column | str) -> Column:
    """Apply the rules in order; a rule whose tags do not occur in the page is skipped."""
    src = col_(html)

    def run(low: Column) -> Column:
        out = _where(_contains(low, ("<script", "<style", "<!--", "<head", "<nav")), lambda t: F.regexp_replace(t, NON_CONTENT, ""), src)
        out = _where(_contains(low, ("<table",)), _tables, out)
        out = _where(_contains(low, ("<ol",)), _numbered_lists, out)
        for pattern, replacement, needles in RULES:
            out = _where(_contains(low, needles), lambda t, p=pattern, r=replacement: F.regexp_replace(t, p, r), out)
        out = _where(_contains(low, ("&#",)), _numeric_references, out)
        for entity, char in ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(char))
        for pattern, replacement in LAYOUT_RULES:
            out = F.regexp_replace(out, pattern, replacement)
        return py_strip(out)
    return let(F.lower(src), run)
