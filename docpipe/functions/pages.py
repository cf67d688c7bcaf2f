"""Page-range parsing and chunk labelling as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.constants import (
    CHUNK_JOB_ID_FMT,
    DEFAULT_CHUNK_SIZE,
    MEDIUM_DOC_CHUNK,
    MEDIUM_DOC_PAGES,
    SMALL_DOC_CHUNK,
    SMALL_DOC_PAGES,
)
from docpipe.functions.text import WS_CLASS, col_, empty_int_array, int_range, py_strip

_NUMBER = WS_CLASS + "*[0-9]+" + WS_CLASS + "*"
_PART_RE = r"\A" + _NUMBER + "(-" + _NUMBER + r")?\z"


def range_parts(spec: Column | str) -> Column:
    """Comma-separated parts without blanks; other white space may stand around a number only."""
    return F.split(F.replace(col_(spec), F.lit(" "), F.lit("")), ",", -1)


def _number(text: Column) -> Column:
    return py_strip(text).try_cast("int")


def page_ranges_valid(spec: Column | str) -> Column:
    """Every part is ``n`` or ``a-b`` with integers that fit an INT.

    Parts like ``1-2-3``, ``x`` or an empty part make the whole spec invalid, as they make the
    original parser raise. A reversed range (``5-3``) is valid and selects nothing.
    """
    parts = range_parts(spec)
    return F.forall(parts, lambda p: p.rlike(_PART_RE)
                    & F.forall(F.split(p, "-", -1), lambda n: _number(n).isNotNull()))


def parse_page_ranges(spec: Column | str, max_page: Column | None = None) -> Column:
    """``"1-3,5,7-9"`` -> sorted distinct ARRAY<INT>; NULL when the spec is NULL or invalid.

    With ``max_page`` only pages in 1..max_page are produced, and each range is clipped
    before it is expanded, so a range like ``1-1000000000`` costs no more than the
    document's own pages. Use it where only existing pages matter.
    """
    def expand(p: Column) -> Column:
        bounds = F.split(p, "-", -1)
        a, b = _number(F.get(bounds, 0)), _number(F.get(bounds, 1))
        if max_page is not None:
            top = max_page.cast("int")
            return F.when(F.size(bounds) == 2, int_range(F.greatest(a, F.lit(1)), F.least(b, top))) \
                .otherwise(F.when((a >= 1) & (a <= top), F.array(a)).otherwise(empty_int_array()))
        return F.when(F.size(bounds) == 2, int_range(a, b)).otherwise(F.array(a))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(range_parts(spec), expand))))
    return F.when(page_ranges_valid(spec), pages)


def merged_ranges(spec: Column | str) -> Column:
    """``"7-9,1-3,2-5"`` -> disjoint sorted ARRAY<STRUCT<first, last>>, adjacent ranges joined.

    The pages are never expanded, so a range of a billion pages is one entry. NULL when
    the spec is NULL or invalid, empty when its ranges are all reversed.
    """
    def bounds(p: Column) -> Column:
        ends = F.split(p, "-", -1)
        first = _number(F.get(ends, 0))
        return F.struct(first.alias("first"), F.coalesce(_number(F.get(ends, 1)), first).alias("last"))

    def join(found: Column, r: Column) -> Column:
        before = F.element_at(found, -1)
        joined = F.struct(before["first"].alias("first"), F.greatest(before["last"], r["last"]).alias("last"))
        touches = F.when(F.size(found) > 0, before["last"] >= r["first"] - 1).otherwise(False)
        return F.when(touches, F.concat(F.slice(found, 1, F.size(found) - 1), F.array(joined))).otherwise(
            F.concat(found, F.array(r)))

    ranges = F.array_sort(F.filter(F.transform(range_parts(spec), bounds), lambda r: r["first"] <= r["last"]))
    none = F.array().cast("array<struct<first:int,last:int>>")
    return F.when(page_ranges_valid(spec), F.aggregate(ranges, none, join))


def ranges_label(ranges: Column, shift: int = 0) -> Column:
    """``1-3,5`` for a range array; ``shift`` is added to every page number."""
    return F.array_join(F.transform(ranges, lambda r: range_label(r["first"] + shift, r["last"] + shift)), ",")


def parse_page_ranges_strict(spec: Column | str) -> Column:
    """As ``parse_page_ranges`` but an invalid spec fails the task, like the original parser."""
    return F.when(col_(spec).isNull() | page_ranges_valid(spec), parse_page_ranges(spec)).otherwise(
        F.raise_error(F.concat(F.lit("invalid page ranges: "), col_(spec))).cast("array<int>"))


def zero_based(pages: Column | str) -> Column:
    """1-based page numbers -> 0-based indexes, as a page-selecting service expects."""
    return F.transform(col_(pages), lambda p: p - 1)


def effective_chunk_size(total_pages: Column, chunk_size: Column | int = DEFAULT_CHUNK_SIZE) -> Column:
    """The default size adapts to short documents; any other size is used as given."""
    size = chunk_size if isinstance(chunk_size, Column) else F.lit(chunk_size)
    return (F.when(size != DEFAULT_CHUNK_SIZE, size)
            .when(total_pages <= SMALL_DOC_PAGES, F.lit(SMALL_DOC_CHUNK))
            .when(total_pages <= MEDIUM_DOC_PAGES, F.lit(MEDIUM_DOC_CHUNK))
            .otherwise(size))


def chunk_starts(total_pages: Column, size: Column) -> Column:
    """First page of every chunk: 1, 1+size, ... <= total_pages (empty for no pages)."""
    return F.when(total_pages >= 1, F.sequence(F.lit(1), total_pages.cast("int"), size.cast("int"))) \
        .otherwise(empty_int_array())


def range_label(start: Column, end: Column) -> Column:
    """``"s-e"``, or ``"s"`` for a one-page range."""
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def chunk_job_id(job_id: Column, chunk_number: Column, total_chunks: Column) -> Column:
    return F.format_string(CHUNK_JOB_ID_FMT, job_id, chunk_number, total_chunks)


def chunk_of_page(page_no: Column, size: Column) -> Column:
    """Chunk number of a page: chunk bounds are regular, so this is arithmetic, not a range join."""
    return (F.floor((page_no - 1) / size) + 1).cast("int")


__all__ = [
    "chunk_job_id", "chunk_of_page", "chunk_starts", "effective_chunk_size", "int_range",
    "merged_ranges", "page_ranges_valid", "parse_page_ranges", "parse_page_ranges_strict", "range_label",
    "range_parts", "ranges_label", "zero_based",
]
