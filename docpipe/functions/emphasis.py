"""Emphasis rules for game-manual style text, as whole-string regex replacements.

The rules are defined per line. Each one is written so it cannot cross a line break
(``[^,\\n]`` in the move clause; the other two match inside a word), so they run on the
whole string: no split, no explode, one codegen'd projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.constants import MOVE_CLAUSE_PATTERN, ROLL_PATTERN, STAT_WORDS
from docpipe.functions.text import col_

# "When you X," / "When you X:" -> "When you **X**,". The rule is per line; on the whole
# string the clause must also stop at a line end, so the class excludes the newline.
MOVE_RE = MOVE_CLAUSE_PATTERN.replace("[^,]", r"[^,\n]")
MOVE_REPLACEMENT = "When you **$1**,"
# roll+word -> roll+**word**; Java needs (?U) for Unicode word characters, as in Python.
ROLL_RE = "(?U)" + ROLL_PATTERN
ROLL_REPLACEMENT = "roll+**$1**"
# stat words, whole word, any case
STAT_RE = r"(?iU)\b(" + "|".join(STAT_WORDS) + r")\b"
STAT_REPLACEMENT = "**$1**"


def enhance_formatting(text: Column | str, enabled: Column | bool = True) -> Column:
    """Apply the three rules in order when ``enabled``; otherwise return the text as is."""
    t = col_(text)
    out = F.regexp_replace(t, MOVE_RE, MOVE_REPLACEMENT)
    out = F.regexp_replace(out, ROLL_RE, ROLL_REPLACEMENT)
    out = F.regexp_replace(out, STAT_RE, STAT_REPLACEMENT)
    gate = enabled if isinstance(enabled, Column) else F.lit(bool(enabled))
    return F.when(gate, out).otherwise(t)
