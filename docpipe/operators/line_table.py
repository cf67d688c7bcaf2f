"""Response cleaner over a lines table, safe when one document holds a large share of rows.

``functions.cleaning`` cleans a document inside its own row. When text is stored one line
per row — ``(doc_id, line_no, line)`` — a single document may span a large part of the
table, and any window or join keyed by ``doc_id`` alone would put all of it in one task.
This operator never keys the lines by ``doc_id`` alone:

- lines are grouped into buckets of ``bucket_lines`` consecutive lines; every join and
  every window over lines is keyed by ``(doc_id, bucket)``, so a huge document spreads
  over as many tasks as it has buckets;
- everything that crosses bucket borders (running count of ``---`` markers, the block
  tests, "was the previous kept line a trigger", first/last kept non-blank line) is
  derived from small summary tables — one row per bucket, or per (bucket, block) — as
  prefixes over buckets, and joined back once;
- a removable block has at most 15 lines, so the removed block numbers of a bucket travel
  as a short array on the bucket's summary row.

The lines are read twice (a per-bucket marker count, then the annotated pass that is both
summarised and filtered); the result is the kept lines with the final trim applied, so
joining them with ``\\n`` in ``line_no`` order gives ``clean_response``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.constants import BLOCK_MARKER, BLOCK_MAX_LINES, BLOCK_MAX_RESIDUAL, PY_WHITESPACE_CHARS
from docpipe.functions.cleaning import (
    INDICATOR_RE,
    SUBJECT_RE,
    counts_as_content,
    is_bare_fence,
    is_trigger,
    scrub_line,
)
from docpipe.functions.text import is_blank, py_strip, stripped_equals
from docpipe.operators.pages import ordered_concat

DEFAULT_BUCKET_LINES = 4096


def _bucket(line_no: Column, bucket_lines: int) -> Column:
    return F.floor((line_no - 1) / bucket_lines).cast("long")


def _marker_prefix(src: DataFrame, key: str) -> DataFrame:
    """(key, b, before, tot): ``---`` lines in all earlier buckets and in the document."""
    per_bucket = src.groupBy(key, "b").agg(F.sum("mk").alias("m"))
    doc = Window.partitionBy(key)
    return per_bucket.select(
        key, "b",
        F.coalesce(F.sum("m").over(doc.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("m").over(doc).alias("tot"))


def _annotated(src: DataFrame, prefix: DataFrame, key: str, remove_page_markers: bool) -> DataFrame:
    """Every line with its closed-block number (or NULL) and its line-pass flags."""
    within = Window.partitionBy(key, "b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rc = F.col("before") + F.sum("mk").over(within)
    block = F.when((F.col("mk") == 1) | (F.col("rc") % 2 == 1), F.floor((F.col("rc") + 1) / 2))
    line = F.col("line")
    return (src.join(prefix, [key, "b"])
            .withColumn("rc", rc)
            .withColumn("blk", F.when(block * 2 <= F.col("tot"), block))
            .select(key, "b", "line_no", "line", "blk",
                    is_bare_fence(line).alias("fence"),
                    is_trigger(line, remove_page_markers).alias("trig"),
                    is_blank(line).alias("blank")))


def _summaries(lines: DataFrame, key: str) -> DataFrame:
    """One row per (key, b, blk): block-test parts, and the line-pass facts the next
    buckets and the trim need (last non-fence line and its trigger flag, first and last
    line that will certainly be kept and is not blank)."""
    in_block = F.col("blk").isNotNull()
    low = F.lower(F.col("line"))
    res = scrub_line(low)
    content = in_block & counts_as_content(res)
    usable = ~F.col("fence")
    solid = usable & ~F.col("trig") & ~F.col("blank")
    return lines.groupBy(key, "b", "blk").agg(
        F.count("*").alias("n"),
        F.bool_or(in_block & low.rlike(INDICATOR_RE)).alias("has_ind"),
        F.bool_or(in_block & low.rlike(SUBJECT_RE)).alias("has_subj"),
        F.sum(F.when(content, F.length(res)).otherwise(F.lit(0))).alias("res_len"),
        F.count_if(content).alias("res_cnt"),
        F.max_by("trig", F.when(usable, F.col("line_no"))).alias("last_trig"),
        F.max(F.when(usable, F.col("line_no"))).alias("last_no"),
        F.min(F.when(solid, F.col("line_no"))).alias("lo"),
        F.max(F.when(solid, F.col("line_no"))).alias("hi"))


def _bucket_state(summary: DataFrame, key: str) -> DataFrame:
    """(key, b, removed, prev_trig, first, last) from the summary table alone.

    A block is removed on its totals over all buckets it spans. Removed blocks drop out of
    the bucket facts; the previous bucket's last trigger flag is carried over buckets
    with no usable line; first/last are the document's outermost kept non-blank lines.
    """
    blocks = summary.where(F.col("blk").isNotNull()).groupBy(key, "blk").agg(
        F.sum("n").alias("n"), F.bool_or("has_ind").alias("has_ind"), F.bool_or("has_subj").alias("has_subj"),
        F.sum("res_len").alias("res_len"), F.sum("res_cnt").alias("res_cnt"))
    removed = blocks.where(
        F.col("has_ind") & (F.col("n") <= BLOCK_MAX_LINES) & ~F.col("has_subj")
        & (F.col("res_len") + F.greatest(F.col("res_cnt") - 1, F.lit(0)) < BLOCK_MAX_RESIDUAL)
    ).select(key, "blk", F.lit(True).alias("gone"))
    marked = summary.join(removed, [key, "blk"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    per_bucket = marked.groupBy(key, "b").agg(
        # a removable block has at most 15 lines, so this list stays short
        F.collect_list(F.when(F.col("gone"), F.col("blk"))).alias("removed"),
        F.max_by("last_trig", F.when(~F.col("gone"), F.col("last_no"))).alias("last_trig"),
        F.min(F.when(~F.col("gone"), F.col("lo"))).alias("lo"),
        F.max(F.when(~F.col("gone"), F.col("hi"))).alias("hi"))
    by_b = Window.partitionBy(key).orderBy("b")
    doc = Window.partitionBy(key)
    return per_bucket.select(
        key, "b", "removed",
        F.last("last_trig", ignorenulls=True).over(by_b.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_trig"),
        F.min("lo").over(doc).alias("first"), F.max("hi").over(doc).alias("last"))


def clean_line_table(lines: DataFrame, remove_page_markers: bool = True, key: str = "doc_id",
                     bucket_lines: int = DEFAULT_BUCKET_LINES) -> DataFrame:
    """``lines``: key, line_no (1-based, increasing within a document), line.
    Returns key, line_no, line of the lines that survive the block pass, the line pass and
    the final trim.

    The lines are read in two passes: one per-bucket marker count, and one pass that is
    both summarised (one row per bucket and block) and, joined with the per-bucket state
    derived from that summary, filtered into the result.
    """
    src = (lines.select(key, "line_no", "line")
           .withColumn("b", _bucket(F.col("line_no"), bucket_lines))
           .withColumn("mk", stripped_equals(F.col("line"), BLOCK_MARKER).cast("int")))
    annotated = _annotated(src, _marker_prefix(src, key), key, remove_page_markers)
    state = _bucket_state(_summaries(annotated, key), key)

    within = Window.partitionBy(key, "b").orderBy("line_no")
    prev = F.coalesce(F.lag("trig").over(within), F.col("prev_trig"), F.lit(False))
    survivors = (annotated.join(state, [key, "b"])
                 .where(~F.col("fence") & (F.col("blk").isNull() | ~F.array_contains("removed", F.col("blk"))))
                 .withColumn("prev", prev)
                 .where(~F.col("trig") & ~(F.col("prev") & F.col("blank"))))

    # Final trim of the joined text: drop blank lines before the first and after the last
    # non-blank line of the document, strip the outer ends of those two lines.
    ws = F.lit(PY_WHITESPACE_CHARS)
    ln = F.col("line_no")
    line = F.col("line")
    trimmed = (F.when((ln == F.col("first")) & (ln == F.col("last")), py_strip(line))
               .when(ln == F.col("first"), F.ltrim(line, ws))
               .when(ln == F.col("last"), F.rtrim(line, ws))
               .otherwise(line))
    return survivors.where(ln.between(F.col("first"), F.col("last"))).select(key, "line_no", trimmed.alias("line"))


def explode_lines(docs: DataFrame, text_col: str = "content", key: str = "doc_id") -> DataFrame:
    """key, line_no, line from one text per row (``split`` on ``\\n``, trailing lines kept)."""
    return (docs.select(key, F.posexplode_outer(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
            .where(F.col("pos").isNotNull())
            .select(key, (F.col("pos") + 1).alias("line_no"), "line"))


def assemble(lines: DataFrame, docs: DataFrame, text_col: str = "content", key: str = "doc_id",
             out: str = "markdown") -> DataFrame:
    """Join cleaned lines back into one text per document (NULL stays NULL, no lines -> '')."""
    joined = ordered_concat(lines, key, "line_no", "line", "\n").withColumnRenamed("line", "_t")
    return docs.select(key, text_col).join(joined, key, "left").select(
        key, F.when(F.col(text_col).isNull(), F.lit(None).cast("string"))
        .otherwise(F.coalesce(F.col("_t"), F.lit(""))).alias(out))
