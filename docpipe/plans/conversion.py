"""End-to-end conversion plans, composed from the operators.

``single_pass``    profile, route, prune pages, convert page by page, stitch, emphasise.
``convert_ladder`` one call per document, time-outs retried in chunks or by the fallback
                   converter, long documents in chunks from the start; cleaned results.

Page pruning is done before the converter because Catalyst cannot push a filter through
``mapInPandas``. Converter results are checkpointed where several branches read them, so
each call is made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.constants import (
    DEFAULT_CHUNK_SIZE,
    DEFAULT_CHUNK_THRESHOLD,
    FALLBACK_MODEL_FMT,
    PAGE_TEXT_LIMIT,
)
from docpipe.functions.cleaning import clean_response
from docpipe.functions.emphasis import enhance_formatting
from docpipe.functions.pages import page_ranges_valid
from docpipe.operators import chunks as CH
from docpipe.operators import pages as PG
from docpipe.operators import profile as PR
from docpipe.operators.convert import ConverterFactory, convert, retried
from docpipe.operators.jobs import retry_routing
from docpipe.session import reliable


def bad_range(spec: str = "page_ranges") -> Column:
    """A page range was given that cannot be read."""
    return F.coalesce(F.col(spec) != "", F.lit(False)) & ~F.coalesce(page_ranges_valid(F.col(spec)), F.lit(False))


def single_pass(pages: DataFrame, files: DataFrame, requests: DataFrame, page_converter: ConverterFactory,
                enhanced: Column | bool = False, skip_optimization: Column | bool = False,
                keep_images: Column | bool = False, text_limit: int = PAGE_TEXT_LIMIT,
                call_rows: int = 1) -> dict[str, DataFrame]:
    """Returns ``routed`` (profile + route), ``converted`` (per page) and ``documents``
    (doc_id, status, error, markdown, pages_ok, pages_failed).

    ``requests``: doc_id, page_ranges (NULL = all pages). ``page_converter`` reads
    doc_id, page_no, text and returns Markdown per page. A failed page or an unreadable
    range fails its document: status ``error``, the first error, no Markdown.
    """
    routed = PR.optimize_routing(PR.document_profile(pages, files, text_limit), skip_optimization, keep_images)
    # The page table is joined on (doc_id, block of page numbers), never on doc_id alone.
    asked = requests.join(routed.select("doc_id"), "doc_id", "left_semi")
    wanted = PG.pages_to_convert(pages, asked)
    # Read by the stitch and by the counts: materialise so each page is converted once.
    converted = reliable(convert(wanted, page_converter, keep=["doc_id", "page_no"], inputs=["text"], call_rows=call_rows))
    good = F.col("status") == "success"
    ok = converted.where(good).select("doc_id", "page_no", F.col("markdown").alias("text"))
    stitched = PG.stitch_pages(ok, files)
    counts = converted.groupBy("doc_id").agg(
        F.count_if(good).alias("pages_ok"), F.count_if(~good).alias("pages_failed"),
        F.min(F.when(~good, F.struct("page_no", "error"))).alias("bad"))
    ranges = requests.select("doc_id", F.when(bad_range(), F.concat(F.lit("invalid page ranges: "), "page_ranges")).alias("bad_range"))
    gate = enhanced if isinstance(enhanced, Column) else F.lit(bool(enhanced))
    failed = F.col("bad_range").isNotNull() | (F.coalesce("pages_failed", F.lit(0)) > 0)
    documents = stitched.join(counts, "doc_id", "left").join(ranges, "doc_id", "left").select(
        "doc_id", F.when(failed, "error").otherwise("success").alias("status"),
        F.coalesce("bad_range", F.col("bad.error")).alias("error"),
        F.when(~failed, enhance_formatting(F.col("markdown"), gate)).alias("markdown"),
        F.coalesce("pages_ok", F.lit(0)).alias("pages_ok"), F.coalesce("pages_failed", F.lit(0)).alias("pages_failed"))
    return {"routed": routed, "converted": converted, "documents": documents}


def convert_ladder(pages: DataFrame, jobs: DataFrame, primary: ConverterFactory, fallback: ConverterFactory,
                   keys: list[str] | None = None, chunk_size: int = DEFAULT_CHUNK_SIZE,
                   threshold: int = DEFAULT_CHUNK_THRESHOLD, disable_chunking: Column | bool = False,
                   fallback_enabled: Column | bool = True, model: str = "converter", call_rows: int = 1,
                   keep_text: bool = True) -> dict[str, DataFrame]:
    """Every job to its end: ``documents`` (one row per job), ``chunk_results``, ``summary``, ``plan``.

    ``pages``: doc_id, page_no, text. ``jobs``: the keys (doc_id, for prompt variants also
    approach), job_id, page_ranges (one per document) and optionally approach_no and prompt,
    which the converters get. Converters read doc_id, chunk_number (0: the whole document),
    text, approach_no, prompt.

    1. A document above ``threshold`` pages without a page range goes to chunks; any other is
       converted in one call, a successful answer cleaned with its page markers kept.
    2. A time-out without a page range goes to chunks; with one it goes to the fallback if
       that is enabled. A fallback that fails leaves the first error. Other errors stay.
    3. Chunks are converted one by one with the same rules (a chunk has a page range),
       stitched with their failures as comments and cleaned with page markers removed. One
       good chunk makes a document successful; if none is, a document that came from a
       time-out keeps that error.

    ``documents``: keys, job_id, status, markdown (with ``keep_text``), markdown_length, error,
    error_type, processing_time (all attempts), route, fallback_used, formatting_preserved,
    model (NULL for failed single calls), page_ranges.
    """
    keys = keys or ["doc_id"]
    extra = [c for c in ("approach_no", "prompt") if c in jobs.columns]
    enabled = fallback_enabled if isinstance(fallback_enabled, Column) else F.lit(bool(fallback_enabled))
    counts = PG.page_extents(pages)
    routed = jobs.withColumn("_fallback", enabled).join(counts, "doc_id", "left").withColumn(
        "total_pages", F.coalesce("total_pages", F.lit(0))).withColumn("last_page", F.greatest("total_pages", F.coalesce("last_page", F.lit(0))))
    routed = reliable(CH.needs_chunking(routed, threshold, disable_chunking).select(
        *keys, "job_id", "page_ranges", *extra, "_fallback", "last_page", "needs_chunking", bad_range().alias("_bad")))
    text_out = [F.col("markdown")] if keep_text else []
    may_fall_back = isinstance(fallback_enabled, Column) or bool(fallback_enabled)
    good = F.col("status") == "success"

    def called(source: DataFrame, with_keys: list[str]) -> DataFrame:
        """First attempts, cleaned, with the next step of those that failed and, for the fallback, what they read."""
        read = ["text", *extra] if may_fall_back else []
        got = convert(source, primary, [*with_keys, "page_ranges", "_fallback", *read], ["chunk_number", "text", *extra], call_rows=call_rows)
        got = got.withColumn("markdown", clean_response("markdown", False))
        got = retry_routing(got, F.col("_fallback"))
        return got.withColumns({c: F.when(F.col("next_route") == "ocr_fallback", F.col(c)) for c in read})

    def second_attempts(tried: DataFrame, with_keys: list[str]) -> DataFrame:
        """The fallback's outcome of the attempts that go there, from the text they brought along: the pages are not read again."""
        again = tried.where(~good & (F.col("next_route") == "ocr_fallback"))
        if not may_fall_back:                       # no attempt goes there
            again = again.withColumns({c: F.lit(None).cast(t) for c, t in (("text", "string"), ("approach_no", "int"), ("prompt", "string"))})
        inputs = again if "chunk_number" in with_keys else again.withColumn("chunk_number", F.lit(0))
        return retried(again, inputs, fallback, with_keys, [c for c in ("chunk_number", "text", *extra) if c not in with_keys], call_rows)

    # One call per document: the requested pages, or all.
    whole = routed.where("NOT needs_chunking AND NOT _bad")
    asked = PG.pages_to_convert(pages, whole.select("doc_id", "page_ranges"))
    texts = PG.ordered_concat(asked, "doc_id", "page_no", "text", "\n")
    whole = whole.join(texts, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("chunk_number", F.lit(0))
    first = called(whole, keys).withColumn("markdown_length", F.length("markdown").cast("long"))
    first = reliable(first if keep_text else first.drop("markdown"))

    ok = first.where(good).select(
        *keys, "status", *text_out, "markdown_length", "error", "error_type", "processing_time", F.lit("primary").alias("route"),
        F.lit(False).alias("fallback_used"), F.lit(True).alias("formatting_preserved"), F.lit(model).alias("model"))
    dead = first.where(~good & (F.col("next_route") == "fail")).select(
        *keys, F.lit("error").alias("status"), *[F.lit(None).cast("string").alias("markdown") for _ in text_out],
        F.lit(None).cast("long").alias("markdown_length"), "error", "error_type", "processing_time", F.lit("fail").alias("route"),
        F.lit(False).alias("fallback_used"), F.lit(False).alias("formatting_preserved"), F.lit(None).cast("string").alias("model"))
    unread = routed.where("_bad").select(
        *keys, F.lit("error").alias("status"), *[F.lit(None).cast("string").alias("markdown") for _ in text_out],
        F.lit(None).cast("long").alias("markdown_length"), F.concat(F.lit("invalid page ranges: "), "page_ranges").alias("error"),
        F.lit("ValueError").alias("error_type"), F.lit(0.0).alias("processing_time"), F.lit("fail").alias("route"),
        F.lit(False).alias("fallback_used"), F.lit(False).alias("formatting_preserved"), F.lit(None).cast("string").alias("model"))
    second = second_attempts(first, keys).withColumn("markdown_length", F.length("markdown").cast("long"))
    second = second.select(
        *keys, F.when(good, "success").otherwise("error").alias("status"), *text_out, "markdown_length", "error", "error_type",
        "processing_time", F.lit("ocr_fallback").alias("route"), "fallback_used", F.lit(False).alias("formatting_preserved"),
        F.when(F.col("fallback_used"), F.format_string(FALLBACK_MODEL_FMT, F.lit(model))).alias("model"))

    # Chunks: long documents, and time-outs without a page range.
    timed_out = first.where(~good & (F.col("next_route") == "chunk")).select(
        *keys, F.col("error").alias("_error"), F.col("error_type").alias("_error_type"), F.col("processing_time").alias("_seconds"),
        F.lit(True).alias("_timed_out"))
    # chunks are ranges of page numbers, up to the last one
    to_chunk = routed.withColumnRenamed("last_page", "total_pages").join(timed_out, keys, "left").where("needs_chunking OR _timed_out")
    plan = CH.chunk_plan(to_chunk, chunk_size, keys=keys)
    sizes = CH.chunk_sizes(to_chunk.select("doc_id", "total_pages").distinct(), chunk_size)
    chunk_text = CH.chunk_texts(CH.chunk_membership(pages.select("doc_id", "page_no", "text"), sizes))
    chunk_in = plan.select(*keys, "chunk_number", F.col("label").alias("page_ranges")).join(
        to_chunk.select(*keys, "_fallback", *extra), keys).join(chunk_text, ["doc_id", "chunk_number"], "left").withColumn(
        "text", F.coalesce("text", F.lit("")))
    chunk_keys = [*keys, "chunk_number"]
    tried = reliable(called(chunk_in, chunk_keys))
    outcome = ["status", "markdown", "error", "processing_time"]
    kept = tried.where(good | (F.col("next_route") != "ocr_fallback")).select(*chunk_keys, *outcome)
    rescued = second_attempts(tried, chunk_keys).select(*chunk_keys, *outcome)
    results = reliable(CH.chunk_results(plan, kept.unionByName(rescued), keys))
    summary = CH.chunk_summary(results, model, keys)
    stitched = CH.stitch_chunks(results, keys).select(*keys, "markdown")
    ended = to_chunk.select(*keys, "_error", "_error_type", "_seconds", "_timed_out").join(
        summary.select(*keys, "status", "chunk_processing_time", F.col("model").alias("_model")), keys, "left").join(
        stitched, keys, "left")
    worked = F.coalesce(good, F.lit(False))
    gave_up = ~worked & F.coalesce("_timed_out", F.lit(False))
    chunked = ended.withColumn("markdown", F.when(~gave_up, F.col("markdown"))).select(
        *keys, F.when(worked, "success").otherwise("error").alias("status"), *text_out,
        F.length("markdown").cast("long").alias("markdown_length"), F.when(gave_up, F.col("_error")).alias("error"),
        F.when(gave_up, F.col("_error_type")).alias("error_type"),
        (F.coalesce("_seconds", F.lit(0.0)) + F.coalesce("chunk_processing_time", F.lit(0.0))).alias("processing_time"),
        F.lit("chunk").alias("route"), F.lit(False).alias("fallback_used"), worked.alias("formatting_preserved"),
        F.when(~gave_up, F.col("_model")).alias("model"))

    documents = ok.unionByName(dead).unionByName(unread).unionByName(second).unionByName(chunked)
    return {"documents": routed.select(*keys, "job_id", "page_ranges").join(documents, keys),
            "chunk_results": results, "summary": summary, "plan": plan}
