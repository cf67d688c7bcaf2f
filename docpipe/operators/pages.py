"""Page ranges, page selection and page stitching.

Selection is an equi semi-join on the composite key ``(doc_id, page_no)``: the requested
pages are exploded from the parsed range, so the join key is unique per page and a huge
document spreads over many partitions instead of landing in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.constants import PAGE_SEPARATOR
from docpipe.functions.pages import merged_ranges, page_ranges_valid, parse_page_ranges


def parsed_requests(requests: DataFrame, spec_col: str = "page_ranges") -> DataFrame:
    """Adds ``ranges`` (disjoint sorted ARRAY<STRUCT<first, last>>), ``n_pages`` (how many pages
    they name) and ``valid``. Pages are not listed, so the size of a range costs nothing."""
    spec = F.col(spec_col)
    named = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["last"].cast("long") - r["first"] + 1)
    return (requests
            .withColumn("ranges", merged_ranges(spec))
            .withColumn("n_pages", named)
            .withColumn("valid", F.when(spec.isNotNull(), page_ranges_valid(spec))))


def last_pages(pages: DataFrame) -> DataFrame:
    """doc_id, last_page."""
    return pages.groupBy("doc_id").agg(F.max("page_no").alias("last_page"))


def requested_pages(pages: DataFrame, requests: DataFrame, spec_col: str = "page_ranges") -> DataFrame:
    """(doc_id, page_no) for every page named by a valid range, up to the document's last page.

    Ranges are clipped before they are expanded: a request costs no more than the document."""
    known = requests.select("doc_id", spec_col).join(last_pages(pages), "doc_id")
    return known.select("doc_id", F.explode(parse_page_ranges(F.col(spec_col), F.col("last_page"))).alias("page_no"))


#: Page numbers of one block of the interval join.
PAGE_BLOCK = 1024


def pages_to_convert(pages: DataFrame, requests: DataFrame, spec_col: str = "page_ranges") -> DataFrame:
    """The pages of each requested document that its range names, or all if it has no range.

    An interval join in blocks of page numbers: the blocks in which a document has pages meet
    the merged ranges that reach into them, then pages meet their block. Only pages that
    exist count, so gaps in the numbering lose nothing, and a range of a billion pages
    costs the document's blocks. A range that cannot be read names no page.
    """
    block = F.floor(F.col("page_no") / PAGE_BLOCK)
    blocks = pages.where("page_no IS NOT NULL").groupBy("doc_id", block.alias("_block")).agg(
        F.min("page_no").alias("_first"), F.max("page_no").alias("_last"))
    whole = F.coalesce(F.col(spec_col) == "", F.lit(True))
    asked = requests.select("doc_id", whole.alias("_whole"), merged_ranges(F.col(spec_col)).alias("_ranges")).distinct()
    reach = F.filter("_ranges", lambda r: (r["last"] >= F.col("_first")) & (r["first"] <= F.col("_last")))
    met = blocks.join(asked, "doc_id").select(F.col("doc_id").alias("_doc"), F.col("_block").alias("_of"), "_whole", reach.alias("_reach")).where(
        F.col("_whole") | (F.size("_reach") > 0))
    inside = F.col("_whole") | F.exists("_reach", lambda r: F.col("page_no").between(r["first"], r["last"]))
    keyed = pages.withColumn("_block", block)
    return keyed.join(met, (F.col("doc_id") == F.col("_doc")) & (F.col("_block") == F.col("_of")) & inside, "left_semi").drop("_block")


def select_pages(pages: DataFrame, requests: DataFrame, spec_col: str = "page_ranges") -> DataFrame:
    """Pages that were asked for and exist (left semi-join)."""
    return pages.join(requested_pages(pages, requests, spec_col), ["doc_id", "page_no"], "left_semi")


def missing_pages(pages: DataFrame, requests: DataFrame, spec_col: str = "page_ranges") -> DataFrame:
    """Requested pages that do not exist, as ranges (doc_id, first_page, last_page): reported and skipped.

    A document's pages are numbered from 1 to its last page; one without pages has none.
    """
    wanted = requests.select("doc_id", merged_ranges(F.col(spec_col)).alias("ranges")).where("ranges IS NOT NULL")
    wanted = wanted.join(last_pages(pages), "doc_id", "left").select(
        "doc_id", F.coalesce("last_page", F.lit(0)).alias("last_page"), F.explode("ranges").alias("r"))
    first, last = F.col("r.first"), F.col("r.last")
    outside = F.array(F.struct(first.alias("first"), F.least(last, F.lit(0)).alias("last")),
                      F.struct(F.greatest(first, F.col("last_page") + 1).alias("first"), last.alias("last")))
    # A document without pages misses its ranges whole, not split at page 1.
    outside = F.when(F.col("last_page") == 0, F.array(F.struct(first.alias("first"), last.alias("last")))).otherwise(outside)
    return wanted.select("doc_id", F.explode(outside).alias("m")).where("m.first <= m.last").select(
        "doc_id", F.col("m.first").alias("first_page"), F.col("m.last").alias("last_page"))


BLOCK_PARTS = 1024


def _concat(parts: DataFrame, keys: list[str], order_col: str, text_col: str, separator: str) -> DataFrame:
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t"))))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), separator).alias(text_col))


def ordered_concat(parts: DataFrame, keys: str | list[str], order_col: str, text_col: str, separator: str,
                   block_parts: int = BLOCK_PARTS) -> DataFrame:
    """The parts of each key joined in order: the key columns and ``text_col``.

    Always in two levels: per (key, block of ``block_parts`` consecutive order values), which
    spreads a key with very many parts over many tasks, then the block texts per key.
    Joining block texts with the same separator gives the same text as one join of all
    parts. Null texts are left out; parts without an order value come first.
    """
    keys = [keys] if isinstance(keys, str) else keys
    blocked = parts.where(F.col(text_col).isNotNull()).withColumn("_block", F.floor(F.col(order_col) / block_parts))
    blocks = _concat(blocked, [*keys, "_block"], order_col, text_col, separator)
    return _concat(blocks, keys, "_block", text_col, separator)


def stitch_pages(pages: DataFrame, documents: DataFrame, text_col: str = "text", separator: str = PAGE_SEPARATOR,
                 block_parts: int = BLOCK_PARTS) -> DataFrame:
    """Non-empty pages of each document in page order, joined by ``separator``.

    A document without any usable page gets ``''`` (left join from ``documents``).
    """
    usable = pages.where(F.col(text_col) != "")
    stitched = ordered_concat(usable, "doc_id", "page_no", text_col, separator, block_parts).withColumnRenamed(
        text_col, "markdown")
    return documents.select("doc_id").join(stitched, "doc_id", "left").select(
        "doc_id", F.coalesce("markdown", F.lit("")).alias("markdown"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"))


def page_extents(pages: DataFrame) -> DataFrame:
    """doc_id, total_pages, last_page: they differ where page numbers have gaps."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.max("page_no").cast("long").alias("last_page"))
