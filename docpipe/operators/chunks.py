"""Chunk planning, chunk outcomes, chunk stitching and the chunk summary.

A long document is converted in page-range chunks. The plan is a narrow projection of the
per-document page count (``sequence`` + ``posexplode``). Chunk bounds are regular, so the
page -> chunk assignment is arithmetic on an equi-key, not a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.constants import (
    CHUNK_ERROR_PREFIX,
    CHUNK_EXCEPTION_FMT,
    CHUNK_FAILED_FMT,
    CHUNK_MARKER_FMT,
    CHUNKED_MODEL_FMT,
    CHUNKED_PAGES_FMT,
    CHUNKED_STAGE,
    DEFAULT_CHUNK_SIZE,
    DEFAULT_CHUNK_THRESHOLD,
    UNKNOWN_ERROR,
)
from docpipe.functions.cleaning import clean_response
from docpipe.functions.pages import (
    chunk_job_id,
    chunk_of_page,
    chunk_starts,
    effective_chunk_size,
    range_label,
)
from docpipe.operators.pages import BLOCK_PARTS, ordered_concat

#: Pages of one join bucket where page rows do not carry their document's page count.
PAGE_BUCKET = 256


def needs_chunking(counts: DataFrame, threshold: int = DEFAULT_CHUNK_THRESHOLD,
                   disable_chunking: Column | bool = False, spec_col: str = "page_ranges") -> DataFrame:
    """Adds ``needs_chunking``: chunking on, no page range given, more pages than ``threshold``."""
    disabled = disable_chunking if isinstance(disable_chunking, Column) else F.lit(bool(disable_chunking))
    no_range = F.col(spec_col).isNull() | (F.col(spec_col) == "")
    return counts.withColumn("needs_chunking", ~disabled & no_range & (F.col("total_pages") > threshold))


def chunk_plan(counts: DataFrame, chunk_size: int | Column = DEFAULT_CHUNK_SIZE,
               job_col: str = "job_id", keys: list[str] | None = None) -> DataFrame:
    """One row per chunk: the keys, job_id, total_pages, chunk_size, chunk_number, total_chunks,
    start_page, end_page, label, chunk_job_id. ``counts`` holds the keys, job_id, total_pages.

    ``keys`` (default doc_id; doc_id and approach for a run over prompt variants) identify a
    run. Job ids are labels: two files of one name have the same one.
    """
    keys = keys or ["doc_id"]
    size = effective_chunk_size(F.col("total_pages"), chunk_size)
    sized = counts.withColumn("chunk_size", size.cast("int")).withColumn(
        "starts", chunk_starts(F.col("total_pages"), F.col("chunk_size")))
    # posexplode_outer + a filter on pos: the inner form makes Catalyst infer a
    # size(starts) > 0 filter below the projection, which would recompute the inputs.
    exploded = sized.select(
        *keys, job_col, "total_pages", "chunk_size",
        F.size("starts").alias("total_chunks"),
        F.posexplode_outer("starts").alias("pos", "start_page")).where(F.col("pos").isNotNull())
    end = F.least(F.col("start_page") + F.col("chunk_size") - 1, F.col("total_pages").cast("int"))
    return exploded.select(
        *keys, job_col, "total_pages", "chunk_size",
        (F.col("pos") + 1).alias("chunk_number"), "total_chunks", "start_page",
        end.alias("end_page"),
        range_label(F.col("start_page"), end).alias("label"),
        chunk_job_id(F.col(job_col), F.col("pos") + 1, F.col("total_chunks")).alias("chunk_job_id"),
    )


def chunk_sizes(counts: DataFrame, chunk_size: int | Column = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """doc_id, chunk_size: the effective chunk size of each document (one row per document)."""
    return counts.select("doc_id", effective_chunk_size(F.col("total_pages"), chunk_size).cast("int").alias("chunk_size"))


def chunk_membership(pages: DataFrame, sizes: DataFrame | None = None, size_col: str | None = None,
                     chunk_size: int | Column = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """Pages with their chunk number; the page columns are kept.

    With ``size_col`` (the document's page count on every page row) the chunk size is
    computed per row: a narrow projection, no join. Otherwise ``sizes`` (one row per
    document, see ``chunk_sizes``) is joined on (doc_id, page bucket): the size rows are
    copied into the document's buckets, so a document with very many pages spreads.
    """
    if size_col is not None:
        size = effective_chunk_size(F.col(size_col), chunk_size)
        return pages.withColumn("chunk_number", chunk_of_page(F.col("page_no"), size))
    bucket = F.floor(F.col("page_no") / PAGE_BUCKET)
    used = pages.select("doc_id", bucket.alias("_bucket")).distinct()
    spread = sizes.select("doc_id", "chunk_size").join(used, "doc_id")
    return pages.withColumn("_bucket", bucket).join(spread, ["doc_id", "_bucket"]).withColumn(
        "chunk_number", chunk_of_page(F.col("page_no"), F.col("chunk_size"))).drop("chunk_size", "_bucket")


def chunk_texts(member: DataFrame, separator: str = "\n") -> DataFrame:
    """doc_id, chunk_number, text: the pages of each chunk joined in page order (empty ones too)."""
    return ordered_concat(member, ["doc_id", "chunk_number"], "page_no", "text", separator)


def chunk_results(plan: DataFrame, outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Failure isolation: every planned chunk gets a row, failed ones an error comment.

    ``outcomes``: the keys, chunk_number, status, markdown, error, processing_time.
    A returned error reads ``failed: {error}``, a raised one ``error: {message}``; a chunk
    without an outcome row counts as failed with an unknown error. ``success`` tells
    whether the content is that of a converted chunk.
    """
    keys = keys or ["doc_id"]
    o = outcomes.select(*keys, "chunk_number", "status", "markdown", "error", "processing_time")
    joined = plan.select(*keys, "job_id", "chunk_number", "total_chunks", "label", "chunk_job_id").join(
        o, [*keys, "chunk_number"], "left")
    ok = F.col("status") == "success"
    content = (F.when(ok, F.col("markdown"))
               .when(F.col("status") == "exception",
                     F.format_string(CHUNK_EXCEPTION_FMT, F.col("label"), F.coalesce(F.col("error"), F.lit(UNKNOWN_ERROR))))
               .otherwise(F.format_string(CHUNK_FAILED_FMT, F.col("label"),
                                          F.coalesce(F.col("error"), F.lit(UNKNOWN_ERROR)))))
    out = joined.select(
        *keys, F.col("job_id").alias("parent_job_id"), "chunk_number", "total_chunks",
        F.col("label").alias("pages"), F.coalesce(content, F.lit("")).alias("content"),
        F.when(ok, F.col("processing_time")).otherwise(F.lit(0.0)).alias("processing_time"),
        F.col("chunk_job_id").alias("job_id"))
    return out.withColumn("success", chunk_succeeded(F.col("content")))


def chunk_succeeded(content: Column) -> Column:
    return ~content.startswith(CHUNK_ERROR_PREFIX)


def stitch_chunks(results: DataFrame, keys: list[str] | None = None, block_parts: int = BLOCK_PARTS) -> DataFrame:
    """The keys, parent_job_id and markdown: every chunk (failed ones too) as
    ``<!-- Pages L -->\\n{content}\\n`` joined by newlines, then cleaned with page markers
    removed. Runs are told apart by their keys, never by the job id."""
    keys = keys or ["doc_id"]
    piece = F.concat(F.format_string(CHUNK_MARKER_FMT, F.col("pages")), F.lit("\n"), F.col("content"), F.lit("\n"))
    parts = results.select(*keys, "parent_job_id", "chunk_number", piece.alias("raw_markdown"))
    stitched = ordered_concat(parts, [*keys, "parent_job_id"], "chunk_number", "raw_markdown", "\n", block_parts)
    return stitched.select(*keys, "parent_job_id", clean_response("raw_markdown", True).alias("markdown"))


def chunk_summary(results: DataFrame, model: str = "converter", keys: list[str] | None = None) -> DataFrame:
    """Per run: ok/total chunks, time, chunk ids, details, status and labels."""
    keys = keys or ["doc_id"]
    agg = results.groupBy(*keys, "parent_job_id").agg(
        F.count_if("success").alias("chunks_processed"),
        F.count("*").alias("total_chunks"),
        F.sum("processing_time").alias("chunk_processing_time"),
        F.array_sort(F.collect_list(F.struct(
            "chunk_number", "pages", "job_id", "processing_time", "success"))).alias("chunk_details"))
    ok = F.col("chunks_processed") > 0
    return agg.select(
        *keys, "parent_job_id", "chunks_processed", "total_chunks", "chunk_processing_time",
        F.transform("chunk_details", lambda d: d["job_id"]).alias("chunk_job_ids"),
        "chunk_details",
        F.when(ok, "success").otherwise("error").alias("status"),
        F.when(ok, "completed").otherwise("failed").alias("job_status"),
        F.lit(CHUNKED_STAGE).alias("current_stage"),
        F.format_string(CHUNKED_MODEL_FMT, F.lit(model), F.col("chunks_processed"), F.col("total_chunks")).alias("model"),
        F.format_string(CHUNKED_PAGES_FMT, F.col("total_chunks")).alias("page_ranges"),
    )


def chunk_job_link(results: DataFrame, chunk_jobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Re-key the job record of each chunk run under its chunk job id.

    ``results``: chunk_results(). ``chunk_jobs``: the record of each chunk's own run (the
    keys, chunk_number, original_job_id, status). Only successful chunks whose record
    exists are renamed; failed ones keep their id.
    """
    keys = keys or ["doc_id"]
    r = results.select(*keys, "parent_job_id", "chunk_number", "total_chunks", "pages", "success",
                       F.col("job_id").alias("chunk_job_id"))
    linked = r.join(chunk_jobs.select(*keys, "chunk_number", "original_job_id", "status"), [*keys, "chunk_number"])
    return linked.select(
        *keys, F.when(F.col("success"), F.col("chunk_job_id")).otherwise(F.col("original_job_id")).alias("job_id"),
        "original_job_id", "parent_job_id", "chunk_number", "total_chunks",
        F.col("pages").alias("page_range"), F.col("success").alias("is_chunk"), "status")
