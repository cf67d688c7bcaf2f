"""Result records: previews, job ids and output names, run metadata and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.constants import DATA_URI_PREFIX, JOB_TS_FORMAT, PREVIEW_CHARS, UNKNOWN_ERROR, UNKNOWN_ERROR_TYPE
from docpipe.operators.jobs import base_name, stem


def preview(text: Column) -> Column:
    """First 500 characters followed by ``...``."""
    return F.concat(F.substring(text, 1, PREVIEW_CHARS), F.lit("..."))


def job_id(run_ts: Column, path: Column) -> Column:
    """``job_{yyyyMMdd_HHmmss}_{stem}`` (second resolution, as the ledger names jobs)."""
    return F.concat_ws("_", F.lit("job"), F.date_format(run_ts, JOB_TS_FORMAT), stem(path))


def job_ids(files: DataFrame, run_ts: Column) -> DataFrame:
    """Job id, file names and output names per document.

    The job id is a label: files of one name in one run share it. ``unique_job_id`` adds
    eight hex digits of the path's MD5 and tells them apart.

    ``files``: doc_id, path. Outputs ``{stem}_{job}.md`` / ``{stem}_{job}_metadata.json``,
    and for a run that failed unexpectedly ``job_{ts}_{stem}_error`` with
    ``{stem}_error_{id}_metadata.json``.
    """
    p = F.col("path")
    jid = job_id(run_ts, p)
    err = F.concat(jid, F.lit("_error"))
    return files.select(
        "doc_id", base_name(p).alias("source_name"), stem(p).alias("stem"), jid.alias("job_id"),
        F.concat(jid, F.lit("_"), F.substring(F.md5(p), 1, 8)).alias("unique_job_id"),
        F.concat(stem(p), F.lit("_"), jid, F.lit(".md")).alias("output_markdown"),
        F.concat(stem(p), F.lit("_"), jid, F.lit("_metadata.json")).alias("output_metadata"),
        err.alias("error_job_id"),
        F.concat(stem(p), F.lit("_error_"), err, F.lit("_metadata.json")).alias("error_metadata"))


def approach_output_name(stem_col: Column, approach: Column, jid: Column) -> Column:
    return F.concat(stem_col, F.lit("_"), approach, F.lit("_"), jid, F.lit(".md"))


def encode_document(files: DataFrame, content_col: str = "content", path_col: str = "path") -> DataFrame:
    """Base64 data URI of the document bytes plus its file name (S4).

    Spark's ``base64`` wraps lines with CRLF every 76 characters; a data URI must not.
    """
    b64 = F.replace(F.base64(F.col(content_col)), F.lit("\r\n"), F.lit(""))
    return files.select("doc_id", base_name(F.col(path_col)).alias("document_name"),
                        F.concat(F.lit(DATA_URI_PREFIX), b64).alias("document_url"))


def approach_summary(responses: DataFrame) -> DataFrame:
    """Per document over its approach runs: totals, successful and failed approach names.

    The name lists are bounded by the catalogue size (8-9 entries).
    """
    ok = F.col("status") == "success"
    agg = responses.groupBy("doc_id").agg(
        F.count("*").alias("total_approaches"),
        F.count_if(ok).alias("successful"),
        F.array_sort(F.collect_list(F.when(ok, F.struct("approach_no", "approach")))).alias("_ok"),
        F.array_sort(F.collect_list(F.when(~ok, F.struct("approach_no", "approach")))).alias("_bad"))
    return agg.select(
        "doc_id", "total_approaches", "successful",
        (F.col("total_approaches") - F.col("successful")).alias("failed"),
        F.transform("_ok", lambda a: a["approach"]).alias("successful_approaches"),
        F.transform("_bad", lambda a: a["approach"]).alias("failed_approaches"),
        (F.col("successful") == 0).alias("all_failed"))


def run_metadata(ids: DataFrame, routed: DataFrame, reduction: DataFrame, results: DataFrame,
                 processing_date: Column) -> DataFrame:
    """The metadata record of each conversion run, success or failure (S10).

    ``ids``: job_ids(); ``routed``: optimize_routing() output; ``reduction``:
    size_reduction(); all three one row per document. ``results``: the documents of
    ``convert_ladder``, with approach, prompt_length and custom_prompt_file where runs have
    them, and optionally optimization_time (without it the record shows 0, as the
    original's optimisation result carries no time of its own). A failed run names no
    output and has an error, its type and the time of failure.
    """
    def given(name: str, kind: str) -> Column:
        return (F.col(name) if name in results.columns else F.lit(None)).cast(kind).alias(name)

    runs = results.select("doc_id", "status", "markdown_length", "error", "error_type", "model", "page_ranges",
                          F.col("processing_time").alias("ocr_time"), given("optimization_time", "double"),
                          given("approach", "string"), given("prompt_length", "int"), given("custom_prompt_file", "string"))
    per_doc = ids.join(routed.select("doc_id", "route", "total_images"), "doc_id", "left").join(
        reduction.select("doc_id", F.col("size_reduction").alias("_reduction")), "doc_id", "left")
    j = per_doc.join(runs, "doc_id", "left")
    performed = F.coalesce(F.col("route") != "skipped", F.lit(False))
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    opt_time = F.when(performed, F.coalesce(F.col("optimization_time"), F.lit(0.0))).otherwise(F.lit(0.0))
    ocr_time = F.coalesce(F.col("ocr_time"), F.lit(0.0))
    named = F.when(F.col("approach").isNull(), F.col("output_markdown")).otherwise(
        approach_output_name(F.col("stem"), F.col("approach"), F.col("job_id")))
    date = F.date_format(processing_date, "yyyy-MM-dd'T'HH:mm:ss")
    return j.select(
        "doc_id", "job_id", "unique_job_id", "approach",
        F.col("source_name").alias("source_pdf"),
        F.when(ok, named).alias("output_markdown"),
        date.alias("processing_date"),
        F.coalesce(F.when(F.col("page_ranges") != "", F.col("page_ranges")), F.lit("all")).alias("pages_processed"),
        performed.alias("optimization_performed"),
        # A failed rewrite has no reduction figure: shown as N/A instead of failing the record.
        F.when(performed, F.coalesce(F.col("_reduction"), F.lit("N/A"))).otherwise(F.lit("N/A")).alias("size_reduction"),
        F.when(F.col("route") == "remove_images", F.col("total_images")).otherwise(F.lit(0).cast("bigint"))
        .alias("images_removed"),
        opt_time.alias("optimization_seconds"),
        ocr_time.alias("ocr_seconds"),
        (opt_time + ocr_time).alias("total_seconds"),
        F.coalesce(F.col("model"), F.lit("unknown")).alias("model"),
        F.coalesce("prompt_length", F.lit(0)).alias("prompt_length"), "custom_prompt_file",
        F.when(ok, "success").otherwise("error").alias("status"),
        F.when(ok, F.col("markdown_length")).otherwise(F.lit(0)).alias("markdown_length"),
        F.when(~ok, F.coalesce("error", F.lit(UNKNOWN_ERROR))).alias("error"),
        F.when(~ok, F.coalesce("error_type", F.lit(UNKNOWN_ERROR_TYPE))).alias("error_type"),
        F.when(~ok, date).alias("failed_at"),
    )


def timing_summary(metadata: DataFrame) -> DataFrame:
    """Optimisation / conversion / total seconds per status and optimisation decision."""
    return metadata.groupBy("status", "optimization_performed").agg(
        F.count("*").alias("runs"),
        F.sum("optimization_seconds").alias("optimization_seconds"),
        F.sum("ocr_seconds").alias("ocr_seconds"),
        F.sum("total_seconds").alias("total_seconds"))
