"""Response cleaner as Column expressions.

A converter's answer often wraps the Markdown in chatter: a preamble line, a ``---`` block
confirming that "all formatting has been preserved", stray code fences and page markers.
Two passes remove it, then the text is trimmed:

1. Block pass (``remove_confirmation_blocks``). ``---`` lines pair up 1-2, 3-4, ... and each
   closed pair delimits a block. A block is dropped, markers included, when it names one
   of the indicator phrases, has at most 15 lines, names none of the subject words, and
   fewer than 50 characters remain once indicator phrases and formatting samples are
   deleted. An unclosed last block is kept.
2. Line pass (``remove_chatter_lines``). A line containing a chatter phrase (any case) is a
   *trigger* and is dropped, as is a page marker when markers are to go; a blank line
   directly after a trigger is dropped too. Bare code fences are dropped and do not count
   as "the line before".
3. ``clean_response`` = trim(line pass(block pass(text))). NULL and ``''`` pass unchanged.

Each document is handled inside its own row with higher-order array functions, so the
cleaner is a narrow transformation: it runs in the scan's task, needs no shuffle, and
works unchanged on a stream. Every rule tests one line at a time (no phrase spans a line
break), which is what makes the per-line array form exact.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.constants import (
    BLOCK_FORMAT_SAMPLES,
    BLOCK_INDICATORS,
    BLOCK_MARKER,
    BLOCK_MAX_LINES,
    BLOCK_MAX_RESIDUAL,
    BLOCK_SUBJECT_WORDS,
    CHATTER_PHRASES,
    CODE_FENCE,
    PAGE_MARKER_PREFIX,
    PAGE_MARKER_SUFFIX,
)
from docpipe.functions.text import (
    alternation,
    col_,
    int_range,
    is_blank,
    let,
    py_strip,
    stripped_equals,
)

INDICATOR_RE = alternation(BLOCK_INDICATORS)
SUBJECT_RE = alternation(BLOCK_SUBJECT_WORDS)
CHATTER_RE = alternation(p.lower() for p in CHATTER_PHRASES)

# Every chatter phrase contains one of these, so a line without any of them is no trigger
# and skips the 32-way regex (a plain substring search is far cheaper per line).
CHATTER_ANCHORS = ["format", "convert", "preserv", "```"]
assert all(any(a in p.lower() for a in CHATTER_ANCHORS) for p in CHATTER_PHRASES)


def split_lines(text: Column) -> Column:
    """Python ``str.split('\\n')``: trailing empty lines are kept."""
    return F.split(text, "\n", -1)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


# --- block pass -------------------------------------------------------------------------

def scrub_line(lowered_line: Column) -> Column:
    """A lower-cased block line with indicator phrases, then formatting samples, deleted
    (in list order) and stripped: what still counts as content."""
    line = lowered_line
    for phrase in BLOCK_INDICATORS + BLOCK_FORMAT_SAMPLES:
        line = F.replace(line, F.lit(phrase), F.lit(""))
    return py_strip(line)


def counts_as_content(residual: Column) -> Column:
    return (residual != "") & ~residual.startswith("-")


def _residual_length(lowered: Column) -> Column:
    """Characters left in a block once indicators and samples are deleted (join + strip)."""
    kept = F.filter(F.transform(lowered, scrub_line), counts_as_content)
    return let(kept, lambda rs: F.aggregate(rs, F.lit(0), lambda acc, r: acc + F.length(r))
               + F.greatest(F.size(rs) - 1, F.lit(0)))


def is_confirmation_block(block_lines: Column) -> Column:
    """The removal test for one closed block (markers included)."""
    def test(low: Column) -> Column:
        return ((F.size(low) <= BLOCK_MAX_LINES)
                & F.exists(low, lambda l: l.rlike(INDICATOR_RE))
                & ~F.exists(low, lambda l: l.rlike(SUBJECT_RE))
                & (_residual_length(low) < BLOCK_MAX_RESIDUAL))
    return let(F.transform(block_lines, lambda l: F.lower(l)), test)


def _closed_blocks(lines: Column) -> Column:
    """ARRAY<STRUCT<s, e>> of closed blocks, 0-based inclusive line positions of the markers."""
    positions = F.filter(
        F.transform(lines, lambda l, i: F.when(stripped_equals(l, BLOCK_MARKER), i).otherwise(-1)),
        lambda p: p >= 0)

    def pairs(pos: Column) -> Column:
        n_closed = (F.size(pos) / 2).cast("int")
        return F.transform(int_range(F.lit(0), n_closed - 1),
                           lambda k: F.struct(F.get(pos, k * 2).alias("s"),
                                              F.get(pos, k * 2 + 1).alias("e")))
    return let(positions, pairs)


def _lines_outside(lines: Column, removed: Column) -> Column:
    """``lines`` with every [s, e] range of ``removed`` (sorted, disjoint) cut out."""
    n_removed = F.size(removed)

    def segment(j: Column) -> Column:
        start = F.when(j == 0, F.lit(0)).otherwise(F.get(removed, j - 1)["e"] + 1)
        end = F.when(j == n_removed, F.size(lines) - 1).otherwise(F.get(removed, j)["s"] - 1)
        return F.slice(lines, start + 1, F.greatest(end - start + 1, F.lit(0)))
    return F.flatten(F.transform(F.sequence(F.lit(0), n_removed), segment))


def remove_confirmation_blocks_lines(lines: Column) -> Column:
    """Block pass over an ARRAY<STRING> of lines; returns the kept lines."""
    def run(ls: Column) -> Column:
        removed = F.filter(_closed_blocks(ls),
                           lambda b: is_confirmation_block(F.slice(ls, b["s"] + 1, b["e"] - b["s"] + 1)))
        return let(removed, lambda rm: _lines_outside(ls, rm))
    return let(lines, run)


def remove_confirmation_blocks(text: Column | str) -> Column:
    if isinstance(text, str):
        return _cached("blocks", text, True)
    t = text
    # Without any "---" there is no block: the pass is the identity (a cheap whole-text test).
    return F.when(t.contains(BLOCK_MARKER), join_lines(remove_confirmation_blocks_lines(split_lines(t)))).otherwise(t)


# --- line pass --------------------------------------------------------------------------

def is_page_marker(line: Column) -> Column:
    """Stripped line starts with ``<!-- Pages `` and ends with `` -->``."""
    return F.when(
        line.contains(PAGE_MARKER_PREFIX),
        let(py_strip(line), lambda s: s.startswith(PAGE_MARKER_PREFIX) & s.endswith(PAGE_MARKER_SUFFIX)),
    ).otherwise(F.lit(False))


def is_chatter(line: Column) -> Column:
    def test(low: Column) -> Column:
        candidate = F.lit(False)
        for anchor in CHATTER_ANCHORS:
            candidate = candidate | low.contains(anchor)
        return candidate & low.rlike(CHATTER_RE)
    return let(F.lower(line), test)


def is_trigger(line: Column, remove_page_markers: bool) -> Column:
    if remove_page_markers:
        return is_chatter(line) | is_page_marker(line)
    return is_chatter(line)


def is_bare_fence(line: Column) -> Column:
    return line.contains(CODE_FENCE) & stripped_equals(line, CODE_FENCE)


def remove_chatter_lines_lines(lines: Column, remove_page_markers: bool = True) -> Column:
    """Line pass over an ARRAY<STRING>; returns the kept lines."""
    no_fences = F.filter(lines, lambda l: ~is_bare_fence(l))

    def run(ls: Column) -> Column:
        triggers = F.transform(ls, lambda l: is_trigger(l, remove_page_markers))

        def keep(trig: Column) -> Column:
            marked = F.transform(ls, lambda l, i: F.when(
                F.get(trig, i) | (F.coalesce(F.get(trig, i - 1), F.lit(False)) & is_blank(l)),
                F.lit(None)).otherwise(l))
            return F.filter(marked, lambda l: l.isNotNull())
        return let(triggers, keep)
    return let(no_fences, run)


def remove_chatter_lines(text: Column | str, remove_page_markers: bool = True) -> Column:
    if isinstance(text, str):
        return _cached("lines", text, remove_page_markers)
    return join_lines(remove_chatter_lines_lines(split_lines(text), remove_page_markers))


# --- full cleaner -----------------------------------------------------------------------

def clean_response(text: Column | str, remove_page_markers: bool = True) -> Column:
    """Block pass, line pass, then Python-style strip. NULL and '' come back unchanged.

    Given a column name, the (large) expression is built once per process and reused.
    """
    if isinstance(text, str):
        return _cached("clean", text, remove_page_markers)
    return _clean_response(text, remove_page_markers)


@functools.lru_cache(maxsize=64)
def _cached(kind: str, name: str, remove_page_markers: bool) -> Column:
    """The expression for a column name, built once per process (it is unresolved, so one
    tree serves every DataFrame that has a column of that name)."""
    col = F.col(name)
    if kind == "blocks":
        return remove_confirmation_blocks(col)
    if kind == "lines":
        return remove_chatter_lines(col, remove_page_markers)
    return _clean_response(col, remove_page_markers)


def _clean_response(text: Column | str, remove_page_markers: bool) -> Column:
    t = col_(text)
    lines = split_lines(t)
    # Without any "---" there is no block, and the block pass is skipped.
    after_blocks = F.when(t.contains(BLOCK_MARKER), remove_confirmation_blocks_lines(lines)).otherwise(lines)
    cleaned = join_lines(remove_chatter_lines_lines(after_blocks, remove_page_markers))
    # The line pass changes a text only where a phrase, a fence or a page marker stands in it
    # (phrases and markers lie within a line), so other texts without blocks go to the trim.
    touched = t.contains(BLOCK_MARKER) | t.contains(CODE_FENCE)
    for anchor in CHATTER_ANCHORS:                  # part of every phrase, and far cheaper to look for
        touched = touched | F.lower(t).contains(anchor)
    if remove_page_markers:
        touched = touched | t.contains(PAGE_MARKER_PREFIX)
    return py_strip(F.when(touched, cleaned).otherwise(t))
