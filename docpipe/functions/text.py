"""Small Column-expression helpers shared by the text operators.

All helpers return ``pyspark.sql.Column`` expressions that stay on the JVM. Array work is
done with Spark's higher-order functions (``transform``, ``filter``, ``exists``,
``aggregate``) so a document is processed inside the task that already holds its row:
no explode, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.constants import PY_WHITESPACE_CHARS

_REGEX_META = set("\\.^$|?*+()[]{}")


def regex_escape(text: str) -> str:
    """Escape regex metacharacters; the result reads the same in Java regex and RE2."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in text)


def alternation(literals: Iterable[str]) -> str:
    """One regex that matches any of ``literals`` as a plain substring."""
    return "(?:" + "|".join(regex_escape(s) for s in literals) + ")"


# The same set as a regex class, spelled so that Java regex and RE2 both read it.
WS_CLASS = "[" + "".join("\\x{%X}" % ord(ch) for ch in PY_WHITESPACE_CHARS) + "]"
STRIP_RE = r"\A" + WS_CLASS + "+|" + WS_CLASS + r"+\z"
BLANK_RE = r"\A" + WS_CLASS + r"*\z"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: ``btrim`` with the exact white-space set (Spark's ``trim``
    removes blanks only). Touches only the two ends of the string."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE_CHARS))


def is_blank(c: Column | str) -> Column:
    """True when the text is empty after ``py_strip``."""
    return py_strip(c) == ""


def stripped_equals(c: Column | str, literal: str) -> Column:
    """``strip(c) == literal``; the cheap ``contains`` test runs first."""
    return col_(c).contains(literal) & (py_strip(c) == literal)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Spark does not share sub-expressions across lambda boundaries, so an array used inside
    a ``transform``/``filter`` body must be bound first or it would be rebuilt per element.
    """
    return F.transform(F.array(value), body).getItem(0)


def empty_int_array() -> Column:
    return F.array().cast("array<int>")


def int_range(start: Column, stop_inclusive: Column) -> Column:
    """``sequence(start, stop)`` that is empty, not descending, when ``stop < start``."""
    return F.when(stop_inclusive >= start, F.sequence(start, stop_inclusive)).otherwise(empty_int_array())
