"""SQL text builders for the DuckDB oracle.

The oracle restates each rule in plain relational SQL (unnest, window functions, GROUP BY)
so that it is an independent formulation of the Spark expressions, not a transcription.
Regex patterns are shared with the Spark side; they are written to read the same in Java
regex and RE2.
"""

from __future__ import annotations

from docpipe.constants import (
    BLOCK_FORMAT_SAMPLES,
    BLOCK_INDICATORS,
    BLOCK_MARKER,
    BLOCK_MAX_LINES,
    BLOCK_MAX_RESIDUAL,
    CODE_FENCE,
    PAGE_MARKER_PREFIX,
    PAGE_MARKER_SUFFIX,
    STAT_WORDS,
)
from docpipe.functions.cleaning import CHATTER_RE, INDICATOR_RE, SUBJECT_RE
from docpipe.functions.markup import ENTITIES
from docpipe.functions.text import BLANK_RE, STRIP_RE, WS_CLASS, regex_escape


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {lit(STRIP_RE)}, '', 'g')"


def is_blank(expr: str) -> str:
    return f"regexp_matches({expr}, {lit(BLANK_RE)})"


def stripped_eq(expr: str, literal: str) -> str:
    pat = r"\A" + WS_CLASS + "*" + regex_escape(literal) + WS_CLASS + r"*\z"
    return f"regexp_matches({expr}, {lit(pat)})"


def _scrub(expr: str) -> str:
    for p in BLOCK_INDICATORS + BLOCK_FORMAT_SAMPLES:
        expr = f"replace({expr}, {lit(p)}, '')"
    return strip(expr)


def clean_sql(src: str, key: str = "doc_id", col: str = "content", blocks: bool = True,
              lines: bool = True, remove_markers: bool = True, trim: bool = True,
              out: str = "markdown", as_lines: bool = False) -> str:
    """Relational cleaner over relation ``src(key, col)``; returns ``(key, out)``, or with
    ``as_lines`` the surviving lines ``(key, line_no, line)`` with the trim applied."""
    parts = [f"""
l0 AS (
  SELECT {key} AS k, CAST(ln AS BIGINT) AS ln, line FROM (
    SELECT {key}, unnest(range(1, len(string_split({col}, chr(10))) + 1)) AS ln,
           unnest(string_split({col}, chr(10))) AS line
    FROM {src} WHERE {col} IS NOT NULL))"""]
    cur = "l0"
    if blocks:
        parts.append(f"""
b1 AS (
  SELECT k, ln, line, {stripped_eq('line', BLOCK_MARKER)} AS mk FROM {cur}),
b2 AS (
  SELECT *, sum(CAST(mk AS INTEGER)) OVER (PARTITION BY k ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rc,
         sum(CAST(mk AS INTEGER)) OVER (PARTITION BY k) AS tot FROM b1),
b3 AS (
  SELECT *, CASE WHEN mk OR rc % 2 = 1 THEN (rc + 1) // 2 END AS blk FROM b2),
b4 AS (
  SELECT k, blk, count(*) AS n,
         bool_or(regexp_matches(low, {lit(INDICATOR_RE)})) AS has_ind,
         bool_or(regexp_matches(low, {lit(SUBJECT_RE)})) AS has_subj,
         coalesce(sum(CASE WHEN keep THEN length(res) ELSE 0 END), 0)
           + greatest(count(*) FILTER (WHERE keep) - 1, 0) AS residual
  FROM (SELECT k, blk, low, res, (res <> '' AND NOT starts_with(res, '-')) AS keep
        FROM (SELECT k, blk, lower(line) AS low, {_scrub('lower(line)')} AS res
              FROM b3 WHERE blk IS NOT NULL AND 2 * blk <= tot))
  GROUP BY k, blk),
b5 AS (
  SELECT b3.k, b3.ln, b3.line FROM b3
  LEFT JOIN (SELECT k, blk FROM b4 WHERE has_ind AND n <= {BLOCK_MAX_LINES} AND NOT has_subj
             AND residual < {BLOCK_MAX_RESIDUAL}) rm
    ON b3.k = rm.k AND b3.blk = rm.blk
  WHERE rm.k IS NULL)""")
        cur = "b5"
    if lines:
        marker = "FALSE"
        if remove_markers:
            marker = (f"(starts_with({strip('line')}, {lit(PAGE_MARKER_PREFIX)}) "
                      f"AND ends_with({strip('line')}, {lit(PAGE_MARKER_SUFFIX)}))")
        parts.append(f"""
c1 AS (
  SELECT k, ln, line, (regexp_matches(lower(line), {lit(CHATTER_RE)}) OR {marker}) AS trig
  FROM {cur} WHERE NOT {stripped_eq('line', CODE_FENCE)}),
c2 AS (
  SELECT *, lag(trig) OVER (PARTITION BY k ORDER BY ln) AS pt FROM c1),
c3 AS (
  SELECT k, ln, line FROM c2 WHERE NOT trig AND NOT (coalesce(pt, FALSE) AND {is_blank('line')}))""")
        cur = "c3"
    if as_lines:
        lstrip = f"regexp_replace(line, {lit(chr(92) + 'A' + WS_CLASS + '+')}, '', 'g')"
        rstrip = f"regexp_replace(line, {lit(WS_CLASS + '+' + chr(92) + 'z')}, '', 'g')"
        parts.append(f"""
fl AS (SELECT k, min(ln) AS f, max(ln) AS l FROM {cur} WHERE NOT {is_blank('line')} GROUP BY k)""")
        return ("WITH " + ",".join(p.strip("\n") for p in parts) + f"""
SELECT c.k AS {key}, CAST(c.ln AS INTEGER) AS line_no,
       CASE WHEN c.ln = fl.f AND c.ln = fl.l THEN {strip('line')} WHEN c.ln = fl.f THEN {lstrip}
            WHEN c.ln = fl.l THEN {rstrip} ELSE line END AS line
FROM {cur} c JOIN fl ON c.k = fl.k WHERE c.ln BETWEEN fl.f AND fl.l""")
    body = f"coalesce(a.txt, '')"
    if trim:
        body = strip(body)
    parts.append(f"""
agg AS (SELECT k, string_agg(line, chr(10) ORDER BY ln) AS txt FROM {cur} GROUP BY k)""")
    return ("WITH " + ",".join(p.strip("\n") for p in parts) + f"""
SELECT s.{key} AS {key}, CASE WHEN s.{col} IS NULL THEN NULL ELSE {body} END AS {out}
FROM {src} s LEFT JOIN agg a ON s.{key} = a.k""")


WORD_CLASS = r"[\pL\pN\pM_]"
NON_WORD_CLASS = r"[^\pL\pN\pM_]"


def enhance_sql(expr: str) -> str:
    """Emphasis rules; whole-word matching done by splitting into word / non-word runs."""
    move_re = lit(r"When you ([^,\n]+)(?:,|:)")
    roll_re = lit(r"roll\+(" + WORD_CLASS + "+)")
    moved = f"regexp_replace({expr}, {move_re}, 'When you **\\1**,', 'g')"
    rolled = f"regexp_replace({moved}, {roll_re}, 'roll+**\\1**', 'g')"
    words = ", ".join(lit(w.lower()) for w in STAT_WORDS)
    runs = f"regexp_extract_all({rolled}, {lit(WORD_CLASS + '+|' + NON_WORD_CLASS + '+')})"
    return (f"array_to_string(list_transform({runs}, lambda p: CASE WHEN lower(p) IN ({words}) "
            f"THEN '**' || p || '**' ELSE p END), '')")


def markup_sql(src: str, key: str, col: str) -> str:
    """Markup to Markdown as a token stream: (key, markdown) for each row of ``src``.

    Tags and texts become rows; windows tell whether bold or italic is open at a token, and
    each token writes its own piece. Independent of the Spark side's regex chain; covers the
    markup of the test data (no tables, numbered lists or numeric references).
    """
    blocks = "'p','div','ul','ol','li','article','section','table','tr','td','th','h1','h2','h3','h4','h5','h6','body','html','footer','header','main','br'"
    text = "string_agg(piece, '' ORDER BY n)"
    for entity, char in ENTITIES:
        text = f"replace({text}, {lit(entity)}, {lit(char)})"
    for pattern, new in ((r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")):
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(new)}, 'g')"
    dropped = lit(r"(?is)<script[ >].*?</script>|<style[ >].*?</style>|<!--.*?-->|<head[ >].*?</head>|<nav[ >].*?</nav>")
    return f"""
WITH page AS (SELECT {key} AS k, regexp_extract_all(regexp_replace({col}, {dropped}, '', 'g'), '<[^>]*>|[^<]+|<') AS parts FROM {src}),
token AS (
  SELECT k, n, part, lower(regexp_extract(part, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, starts_with(part, '</') AS ends
  FROM (SELECT k, unnest(range(1, len(parts) + 1)) AS n, unnest(parts) AS part FROM page)),
event AS (
  SELECT *, tag IN ({blocks}) AS block,
         CASE WHEN tag IN ('b', 'strong') THEN NOT ends WHEN tag IN ({blocks}) THEN FALSE END AS bold,
         CASE WHEN tag IN ('i', 'em') THEN NOT ends WHEN tag IN ({blocks}) THEN FALSE END AS slanted
  FROM token),
state AS (
  SELECT *, coalesce(last_value(bold IGNORE NULLS) OVER before, FALSE) AS was_bold,
         coalesce(last_value(slanted IGNORE NULLS) OVER before, FALSE) AS was_slanted
  FROM event WINDOW before AS (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
piece AS (
  SELECT k, n,
    CASE WHEN bold IS NOT NULL AND was_bold THEN '**' ELSE '' END || CASE WHEN slanted IS NOT NULL AND was_slanted THEN '*' ELSE '' END
    || CASE WHEN bold THEN '**' WHEN slanted THEN '*' WHEN NOT starts_with(part, '<') THEN part
            WHEN regexp_full_match(tag, 'h[1-6]') THEN chr(10) || chr(10) || CASE WHEN ends THEN ''
                                                       ELSE repeat('#', CAST(substr(tag, 2) AS INTEGER)) || ' ' END
            WHEN tag = 'li' THEN CASE WHEN ends THEN '' ELSE chr(10) || '- ' END
            WHEN tag = 'br' THEN chr(10) WHEN block AND tag NOT IN ('table', 'tr', 'td', 'th') THEN chr(10) || chr(10) ELSE '' END AS piece
  FROM state)
SELECT s.{key}, CASE WHEN s.{col} IS NOT NULL THEN {strip("coalesce(o.t, '')")} END AS markdown
FROM {src} s LEFT JOIN (SELECT k, {text} AS t FROM piece GROUP BY k) o ON s.{key} = o.k"""
