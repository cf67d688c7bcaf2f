"""The query catalogue: every operator as a named query over the driver's tables.

Each entry pairs a Spark callable ``(spark, data_dir) -> DataFrame`` with, where the rule
is expressible in SQL, an oracle query for DuckDB over the same parquet tables. Outputs
are flat scalar columns (arrays joined to strings, structs flattened) so both sides can
be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.functions.cleaning import (
    clean_response as clean_expr,
    remove_chatter_lines,
    remove_confirmation_blocks,
)
from docpipe.functions.emphasis import enhance_formatting
from docpipe.functions.markup import markup_to_markdown
from docpipe.functions.pages import ranges_label
from docpipe.operators import chunks as CH
from docpipe.operators import jobs as JB
from docpipe.operators import pages as PG
from docpipe.operators import profile as PR
from docpipe.operators.convert import echo_converter, ocr_echo_converter
from docpipe.operators.line_table import clean_line_table, explode_lines
from docpipe.operators.results import (
    approach_summary,
    encode_document,
    job_ids,
    preview,
    run_metadata,
    timing_summary,
)
from docpipe.plans import sqltext as S
from docpipe.plans.conversion import convert_ladder
from docpipe.sources import fixtures as FX
from docpipe.sources.fixtures import AS_OF, FX_TEXT_LIMIT, with_fixtures
from docpipe.sources.prompts import PROMPTS, fan_out


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return register


AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"

# ---------------------------------------------------------------------------------------
# Profile and routing
# ---------------------------------------------------------------------------------------


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return PR.document_profile(FX.fx_pages(spark, d), FX.fx_files(spark, d), text_limit=FX_TEXT_LIMIT)


_PROFILE_SQL = f"""
SELECT f.doc_id,
       CAST(f.file_size_bytes AS DOUBLE) / 1024 / 1024 AS file_size_mb,
       coalesce(a.total_pages, 0) AS total_pages,
       coalesce(a.total_images, 0) AS total_images,
       CASE WHEN coalesce(a.total_pages, 0) = 0 THEN 0.0
            ELSE CAST(a.total_images AS DOUBLE) / a.total_pages END AS avg_images_per_page,
       coalesce(a.pages_with_images, 0) AS pages_with_images,
       coalesce(a.pages_exceeding_text_limit, 0) AS pages_exceeding_text_limit,
       CAST(f.file_size_bytes AS DOUBLE) / 1024 / 1024 > 300 AS exceeds_file_size,
       coalesce(a.has_image_heavy_pages, FALSE) AS has_image_heavy_pages,
       coalesce(a.pages_exceeding_text_limit, 0) > 0 AS has_text_heavy_pages
FROM fx_files f
LEFT JOIN (SELECT doc_id, count(*) AS total_pages, CAST(sum(images) AS BIGINT) AS total_images,
                  count(*) FILTER (WHERE images > 0) AS pages_with_images,
                  count(*) FILTER (WHERE length(text) > {FX_TEXT_LIMIT}) AS pages_exceeding_text_limit,
                  bool_or(images > 35) AS has_image_heavy_pages
           FROM fx_pages GROUP BY doc_id) a ON f.doc_id = a.doc_id
"""


@query("document_profile", with_fixtures(_PROFILE_SQL, "fx_pages", "fx_files"))
def q_document_profile(spark: SparkSession, d: str) -> DataFrame:
    p = _profile(spark, d)
    return p.select(
        "doc_id", "file_size_mb", "total_pages", "total_images", "avg_images_per_page",
        "pages_with_images", "pages_exceeding_text_limit",
        F.col("exceeds_limits.file_size").alias("exceeds_file_size"),
        F.col("exceeds_limits.has_image_heavy_pages").alias("has_image_heavy_pages"),
        F.col("exceeds_limits.has_text_heavy_pages").alias("has_text_heavy_pages"))


@query("page_profile", with_fixtures(f"""
SELECT doc_id, page_no AS page, CAST(images AS INTEGER) AS images, CAST(length(text) AS INTEGER) AS text_length,
       length(text) > {FX_TEXT_LIMIT} AS exceeds_64kb
FROM fx_pages""", "fx_pages"))
def q_page_profile(spark: SparkSession, d: str) -> DataFrame:
    return PR.page_profile(FX.fx_pages(spark, d), text_limit=FX_TEXT_LIMIT)


_RECS_SQL = f"""
SELECT doc_id, CAST(rec_no AS INTEGER) AS rec_no, recommendation FROM (
  SELECT doc_id, unnest(range(1, len(recs) + 1)) AS rec_no, unnest(recs) AS recommendation FROM (
    SELECT doc_id, list_filter([
        CASE WHEN total_images > 0 THEN 'Remove images to reduce file size and processing time' END,
        CASE WHEN file_size_mb > 200 THEN 'File size approaching LlamaParse limit - optimization recommended' END,
        CASE WHEN pages_exceeding_text_limit > 0
             THEN CAST(pages_exceeding_text_limit AS VARCHAR) || ' pages may exceed 64KB text limit' END
      ], lambda x: x IS NOT NULL) AS recs
    FROM ({_PROFILE_SQL})))
"""


@query("recommendations", with_fixtures(_RECS_SQL, "fx_pages", "fx_files"))
def q_recommendations(spark: SparkSession, d: str) -> DataFrame:
    p = _profile(spark, d)
    return p.select("doc_id", F.posexplode("recommendations").alias("pos", "recommendation")).select(
        "doc_id", (F.col("pos") + 1).alias("rec_no"), "recommendation")


def _routed(spark: SparkSession, d: str) -> DataFrame:
    return PR.optimize_routing(_profile(spark, d), skip_optimization=F.col("doc_id") % 11 == 0,
                               keep_images=F.col("doc_id") % 5 == 1)


_ROUTING_SQL = f"""
SELECT doc_id, should_optimize,
       CASE WHEN doc_id % 11 = 0 OR NOT should_optimize THEN 'skipped'
            WHEN doc_id % 5 = 1 THEN 'compress_only' ELSE 'remove_images' END AS route,
       total_images, total_pages
FROM (SELECT doc_id, total_images, total_pages,
             coalesce(file_size_mb > 50 OR total_images > 10 OR exceeds_file_size
                      OR has_image_heavy_pages OR has_text_heavy_pages, FALSE) AS should_optimize
      FROM ({_PROFILE_SQL}))
"""


@query("optimize_routing", with_fixtures(
    "SELECT doc_id, should_optimize, route FROM (" + _ROUTING_SQL + ")", "fx_pages", "fx_files"))
def q_optimize_routing(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("doc_id", "should_optimize", "route")


@query("optimization_counters", with_fixtures(f"""
SELECT doc_id, route,
       CASE WHEN route = 'remove_images' THEN total_images ELSE 0 END AS images_removed,
       CASE WHEN route <> 'skipped' THEN total_pages ELSE 0 END AS pages_processed
FROM ({_ROUTING_SQL})""", "fx_pages", "fx_files"))
def q_optimization_counters(spark: SparkSession, d: str) -> DataFrame:
    return PR.optimization_counters(_routed(spark, d))


@query("size_reduction", with_fixtures("""
SELECT doc_id, original_size_mb, optimized_size_mb, pct AS size_reduction_percent,
       CASE WHEN pct IS NULL THEN 'error' ELSE 'success' END AS status,
       coalesce(printf('%.1f', round_even(pct, 1)) || '%', 'N/A') AS size_reduction
FROM (SELECT doc_id, CAST(file_size_bytes AS DOUBLE) / 1024 / 1024 AS original_size_mb,
             CAST(optimized_size_bytes AS DOUBLE) / 1024 / 1024 AS optimized_size_mb,
             CASE WHEN file_size_bytes = 0 THEN NULL
                  ELSE (CAST(file_size_bytes AS DOUBLE) - CAST(optimized_size_bytes AS DOUBLE))
                       / CAST(file_size_bytes AS DOUBLE) * 100 END AS pct
      FROM fx_files)""", "fx_files"))
def q_size_reduction(spark: SparkSession, d: str) -> DataFrame:
    return PR.size_reduction(FX.fx_files(spark, d))


# ---------------------------------------------------------------------------------------
# Page ranges, selection, stitching
# ---------------------------------------------------------------------------------------

_PARSE_SQL = r"""
WITH r AS (
  SELECT doc_id, page_ranges, string_split(replace(page_ranges, ' ', ''), ',') AS parts FROM fx_requests),
v AS (
  SELECT *, CASE WHEN page_ranges IS NULL THEN NULL
                 ELSE len(list_filter(parts, lambda p: NOT regexp_full_match(p, '[0-9]+(-[0-9]+)?')
                                            OR TRY_CAST(split_part(p, '-', 1) AS INTEGER) IS NULL
                                            OR (p LIKE '%-%' AND TRY_CAST(split_part(p, '-', 2) AS INTEGER) IS NULL))) = 0
            END AS valid
  FROM r),
part AS (
  SELECT DISTINCT doc_id, CAST(split_part(p, '-', 1) AS INTEGER) AS a,
         CAST(CASE WHEN p LIKE '%-%' THEN split_part(p, '-', 2) ELSE p END AS INTEGER) AS b
  FROM (SELECT doc_id, unnest(parts) AS p FROM v WHERE valid)),
isle AS (
  SELECT doc_id, a, b, sum(starts) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n
  FROM (SELECT doc_id, a, b, CASE WHEN a - 1 <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts
        FROM part WHERE a <= b)),
range_of AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM isle GROUP BY doc_id, n),
last_of AS (SELECT doc_id, count(*) AS last_page FROM fx_pages GROUP BY doc_id)
"""


def _label_sql(shift: int) -> str:
    return (f"string_agg(CASE WHEN a = b THEN CAST(a + {shift} AS VARCHAR) "
            f"ELSE CAST(a + {shift} AS VARCHAR) || '-' || CAST(b + {shift} AS VARCHAR) END, ',' ORDER BY a)")


@query("page_range_parse", with_fixtures(_PARSE_SQL + f"""
SELECT v.doc_id, v.page_ranges, v.valid, CASE WHEN v.valid THEN coalesce(m.n_pages, 0) END AS n_pages,
       CASE WHEN v.valid THEN coalesce(m.pages, '') END AS pages, CASE WHEN v.valid THEN coalesce(m.pages0, '') END AS pages0
FROM v LEFT JOIN (SELECT doc_id, CAST(sum(CAST(b AS BIGINT) - a + 1) AS BIGINT) AS n_pages, {_label_sql(0)} AS pages,
                         {_label_sql(-1)} AS pages0 FROM range_of GROUP BY doc_id) m ON v.doc_id = m.doc_id""",
    "fx_requests", "fx_pages"))
def q_page_range_parse(spark: SparkSession, d: str) -> DataFrame:
    p = PG.parsed_requests(FX.fx_requests(spark, d))
    return p.select("doc_id", "page_ranges", "valid", "n_pages", ranges_label(F.col("ranges")).alias("pages"),
                    ranges_label(F.col("ranges"), -1).alias("pages0"))


@query("page_selection", with_fixtures(_PARSE_SQL + """
SELECT p.doc_id, p.page_no, p.text, p.images FROM fx_pages p
WHERE EXISTS (SELECT 1 FROM range_of q WHERE q.doc_id = p.doc_id AND p.page_no BETWEEN q.a AND q.b)""",
    "fx_pages", "fx_requests"))
def q_page_selection(spark: SparkSession, d: str) -> DataFrame:
    return PG.select_pages(FX.fx_pages(spark, d), FX.fx_requests(spark, d))


@query("out_of_range_pages", with_fixtures(_PARSE_SQL + """
SELECT doc_id, CAST(lo AS INTEGER) AS first_page, CAST(hi AS INTEGER) AS last_page FROM (
  SELECT q.doc_id, q.a AS lo, least(q.b, 0) AS hi FROM range_of q JOIN last_of l ON q.doc_id = l.doc_id
  UNION ALL
  SELECT q.doc_id, greatest(q.a, l.last_page + 1), q.b FROM range_of q JOIN last_of l ON q.doc_id = l.doc_id
  UNION ALL
  SELECT q.doc_id, q.a, q.b FROM range_of q ANTI JOIN last_of l ON q.doc_id = l.doc_id)
WHERE lo <= hi""", "fx_pages", "fx_requests"))
def q_out_of_range_pages(spark: SparkSession, d: str) -> DataFrame:
    return PG.missing_pages(FX.fx_pages(spark, d), FX.fx_requests(spark, d))


@query("stitch_pages", with_fixtures("""
SELECT d.doc_id, coalesce(s.markdown, '') AS markdown FROM documents d
LEFT JOIN (SELECT doc_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_no) AS markdown
           FROM fx_pages WHERE text IS NOT NULL AND text <> '' GROUP BY doc_id) s ON d.doc_id = s.doc_id""",
    "fx_pages"))
def q_stitch_pages(spark: SparkSession, d: str) -> DataFrame:
    return PG.stitch_pages(FX.fx_pages(spark, d), FX.read_table(spark, d, "documents"))


# ---------------------------------------------------------------------------------------
# Chunking
# ---------------------------------------------------------------------------------------

RUN_JOB_PREFIX = "job_20240130_120000_"


def _doc_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Per document: doc_id, job_id (``job_{run ts}_{stem}``), total_pages.

    One page per line, so the page count comes straight from the document row: a narrow
    projection, no aggregation or join. Documents of one file name share their job id.
    """
    return FX.read_table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit(RUN_JOB_PREFIX), JB.stem(FX.fx_path())).alias("job_id"),
        F.size(F.split(F.col("text"), "\n", -1)).cast("bigint").alias("total_pages"))


_DOC_JOBS_SQL = f"""
SELECT c.doc_id, '{RUN_JOB_PREFIX}' || 'doc_' || CAST(c.doc_id % 40 AS VARCHAR) AS job_id, c.total_pages
FROM (SELECT doc_id, count(*) AS total_pages FROM fx_pages GROUP BY doc_id) c
JOIN fx_files f ON c.doc_id = f.doc_id
"""

_PLAN_SQL = f"""
SELECT doc_id, job_id, total_pages, chunk_size, CAST(chunk_number AS INTEGER) AS chunk_number,
       CAST(total_chunks AS INTEGER) AS total_chunks, CAST(start_page AS INTEGER) AS start_page,
       CAST(end_page AS INTEGER) AS end_page,
       CASE WHEN start_page = end_page THEN CAST(start_page AS VARCHAR)
            ELSE CAST(start_page AS VARCHAR) || '-' || CAST(end_page AS VARCHAR) END AS label,
       printf('%s_chunk_%02d_of_%02d', job_id, chunk_number, total_chunks) AS chunk_job_id
FROM (
  SELECT doc_id, job_id, total_pages, chunk_size, start_page,
         least(start_page + chunk_size - 1, total_pages) AS end_page,
         (start_page - 1) // chunk_size + 1 AS chunk_number,
         (total_pages + chunk_size - 1) // chunk_size AS total_chunks
  FROM (
    SELECT doc_id, job_id, total_pages, chunk_size,
           unnest(range(1, CAST(total_pages AS INTEGER) + 1, chunk_size)) AS start_page
    FROM (SELECT doc_id, job_id, total_pages,
                 CAST(CASE WHEN total_pages <= 10 THEN 5 WHEN total_pages <= 30 THEN 10 ELSE 15 END AS INTEGER)
                   AS chunk_size
          FROM ({_DOC_JOBS_SQL}))))
"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return CH.chunk_plan(_doc_jobs(spark, d))


@query("chunk_plan", with_fixtures(_PLAN_SQL, "fx_pages", "fx_files"))
def q_chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


@query("needs_chunking", with_fixtures("""
SELECT c.doc_id, c.total_pages, r.page_ranges,
       (r.page_ranges IS NULL OR r.page_ranges = '') AND c.total_pages > 20 AS needs_chunking
FROM (SELECT doc_id, count(*) AS total_pages FROM fx_pages GROUP BY doc_id) c
JOIN fx_requests r ON c.doc_id = r.doc_id""", "fx_pages", "fx_requests"))
def q_needs_chunking(spark: SparkSession, d: str) -> DataFrame:
    counts = PG.page_counts(FX.fx_pages(spark, d)).join(FX.fx_requests(spark, d), "doc_id")
    return CH.needs_chunking(counts).select("doc_id", "total_pages", "page_ranges", "needs_chunking")


@query("chunk_membership", with_fixtures(f"""
SELECT p.doc_id, p.page_no, CAST(pl.chunk_number AS INTEGER) AS chunk_number
FROM fx_pages p JOIN ({_PLAN_SQL}) pl
  ON p.doc_id = pl.doc_id AND p.page_no BETWEEN pl.start_page AND pl.end_page""", "fx_pages", "fx_files"))
def q_chunk_membership(spark: SparkSession, d: str) -> DataFrame:
    # Page rows carry their document's page count, so the assignment is a projection.
    pages = FX.fx_pages_sized(spark, d).select("doc_id", "page_no", "n_pages")
    return CH.chunk_membership(pages, size_col="n_pages").select("doc_id", "page_no", "chunk_number")


# Chunk outcomes of a converter run over the chunked documents: a chunk's Markdown is its
# pages joined by newlines; (doc_id + chunk_number) % 7 = 0 failed with a 504, and
# (doc_id + chunk_number) % 11 = 0 failed without an error message ("Unknown error").
def _chunk_outcomes(spark: SparkSession, d: str) -> DataFrame:
    pages = FX.fx_pages_sized(spark, d).where("n_pages > 20").select("doc_id", "page_no", "text", "n_pages")
    chunks = CH.chunk_texts(CH.chunk_membership(pages, size_col="n_pages"))
    key = F.col("doc_id") + F.col("chunk_number")
    failed = (key % 7 == 0) | (key % 11 == 0)
    return chunks.select(
        "doc_id", "chunk_number",
        F.when(failed, "error").otherwise("success").alias("status"),
        F.when(~failed, F.col("text")).alias("markdown"),
        F.when(key % 11 == 0, F.lit(None).cast("string")).when(key % 7 == 0, F.lit("504")).alias("error"),
        F.when(~failed, F.col("chunk_number") * 1.5).otherwise(0.0).alias("processing_time"))


def _chunk_results(spark: SparkSession, d: str) -> DataFrame:
    plan = _plan(spark, d).where(F.col("total_pages") > 20)
    return CH.chunk_results(plan, _chunk_outcomes(spark, d))


_CHUNK_RESULTS_SQL = f"""
SELECT *, NOT starts_with(content, '<!-- ERROR') AS success FROM (
SELECT pl.doc_id, pl.job_id AS parent_job_id, pl.chunk_number, pl.total_chunks, pl.label AS pages,
       CASE WHEN (pl.doc_id + pl.chunk_number) % 11 = 0
              THEN '<!-- ERROR: Chunk ' || pl.label || ' failed: Unknown error -->'
            WHEN (pl.doc_id + pl.chunk_number) % 7 = 0
              THEN '<!-- ERROR: Chunk ' || pl.label || ' failed: 504 -->'
            ELSE (SELECT string_agg(p.text, chr(10) ORDER BY p.page_no) FROM fx_pages p
                  WHERE p.doc_id = pl.doc_id AND p.page_no BETWEEN pl.start_page AND pl.end_page) END AS content,
       CAST(CASE WHEN (pl.doc_id + pl.chunk_number) % 11 = 0 OR (pl.doc_id + pl.chunk_number) % 7 = 0 THEN 0.0
            ELSE pl.chunk_number * 1.5 END AS DOUBLE) AS processing_time,
       pl.chunk_job_id AS job_id
FROM ({_PLAN_SQL}) pl WHERE pl.total_pages > 20)
"""


@query("chunk_failures", with_fixtures(_CHUNK_RESULTS_SQL, "fx_pages", "fx_files"))
def q_chunk_failures(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_results(spark, d)


@query("stitch_chunks", with_fixtures(S.clean_sql(
    f"""(SELECT doc_id, string_agg('<!-- Pages ' || pages || ' -->' || chr(10) || content || chr(10), chr(10)
                                      ORDER BY chunk_number) AS raw_markdown
        FROM ({_CHUNK_RESULTS_SQL}) GROUP BY doc_id)""",
    key="doc_id", col="raw_markdown", remove_markers=True), "fx_pages", "fx_files"))
def q_stitch_chunks(spark: SparkSession, d: str) -> DataFrame:
    return CH.stitch_chunks(_chunk_results(spark, d)).select("doc_id", "markdown")


@query("chunk_summary", with_fixtures(f"""
SELECT doc_id, parent_job_id, chunks_processed, total_chunks, chunk_processing_time, chunk_job_ids,
       CASE WHEN chunks_processed > 0 THEN 'success' ELSE 'error' END AS status,
       CASE WHEN chunks_processed > 0 THEN 'completed' ELSE 'failed' END AS job_status,
       'completed_chunked' AS current_stage,
       'converter (chunked: ' || CAST(chunks_processed AS VARCHAR) || '/' || CAST(total_chunks AS VARCHAR) || ' chunks)' AS model,
       'all (' || CAST(total_chunks AS VARCHAR) || ' chunks)' AS page_ranges
FROM (SELECT doc_id, any_value(parent_job_id) AS parent_job_id, count(*) FILTER (WHERE success) AS chunks_processed,
             count(*) AS total_chunks, sum(processing_time) AS chunk_processing_time,
             string_agg(job_id, ',' ORDER BY chunk_number) AS chunk_job_ids
      FROM ({_CHUNK_RESULTS_SQL}) GROUP BY doc_id)""", "fx_pages", "fx_files"))
def q_chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    s = CH.chunk_summary(_chunk_results(spark, d))
    return s.select("doc_id", "parent_job_id", "chunks_processed", "total_chunks", "chunk_processing_time",
                    F.array_join("chunk_job_ids", ",").alias("chunk_job_ids"), "status", "job_status",
                    "current_stage", "model", "page_ranges")


# ---------------------------------------------------------------------------------------
# Response cleaning, emphasis, markup
# ---------------------------------------------------------------------------------------

@query("clean_blocks", with_fixtures(S.clean_sql("fx_responses", lines=False, trim=False, out="content"),
                                     "fx_responses"))
def q_clean_blocks(spark: SparkSession, d: str) -> DataFrame:
    r = FX.fx_responses(spark, d)
    return r.select("doc_id", remove_confirmation_blocks("content").alias("content"))


@query("clean_lines", with_fixtures(S.clean_sql("fx_responses", blocks=False, trim=False, remove_markers=False,
                                                out="content"), "fx_responses"))
def q_clean_lines(spark: SparkSession, d: str) -> DataFrame:
    r = FX.fx_responses(spark, d)
    return r.select("doc_id", remove_chatter_lines("content", False).alias("content"))


@query("clean_response", with_fixtures(S.clean_sql("fx_responses", remove_markers=True), "fx_responses"))
def q_clean_response(spark: SparkSession, d: str) -> DataFrame:
    r = FX.fx_responses(spark, d)
    return r.select("doc_id", clean_expr("content", True).alias("markdown"))


@query("clean_line_table", with_fixtures(S.clean_sql("fx_responses", remove_markers=True, as_lines=True),
                                         "fx_responses"))
def q_clean_line_table(spark: SparkSession, d: str) -> DataFrame:
    # Small buckets so that the documents of the test data cross bucket borders.
    return clean_line_table(explode_lines(FX.fx_responses(spark, d)), True, bucket_lines=16)


@query("enhance_formatting", with_fixtures(f"""
SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN {S.enhance_sql('content')} ELSE content END AS markdown
FROM fx_responses""", "fx_responses"))
def q_enhance_formatting(spark: SparkSession, d: str) -> DataFrame:
    r = FX.fx_responses(spark, d)
    return r.select("doc_id", enhance_formatting(F.col("content"), F.col("doc_id") % 3 != 2).alias("markdown"))


@query("markup_to_markdown", S.markup_sql("pages", "page_id", "html"))
def q_markup_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return FX.read_table(spark, d, "pages").select("page_id", markup_to_markdown(F.col("html")).alias("markdown"))


@query("result_preview", with_fixtures("""
SELECT doc_id, CASE WHEN content IS NULL THEN NULL ELSE substring(content, 1, 500) || '...' END AS preview
FROM fx_responses""", "fx_responses"))
def q_result_preview(spark: SparkSession, d: str) -> DataFrame:
    return FX.fx_responses(spark, d).select("doc_id", preview(F.col("content")).alias("preview"))


# ---------------------------------------------------------------------------------------
# Job ledger
# ---------------------------------------------------------------------------------------

def _state(spark: SparkSession, d: str, as_of: str | None = None) -> DataFrame:
    return JB.latest_job_state(FX.fx_job_events(spark, d), as_of=as_of)


def _state_sql(seen: str = "TRUE") -> str:
    return f"""
SELECT r.job_id, r.status, r.current_stage, r.input_file, r.error, r.page_ranges, r.prompt_tokens,
       r.completion_tokens, r.total_tokens, r.end_time, r.prompt_type, r.processing_time, r.model, r.markdown_length,
       r.error_type, r.parent_job_id, r.is_chunk, r.event_ts AS last_event_ts, s.start_time, s.chat_request_ts, s.n_events
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_ts DESC, event_id DESC) AS rn
      FROM fx_job_events WHERE {seen}) r
JOIN (SELECT job_id, coalesce(min(start_time), min(event_ts)) AS start_time,
             coalesce(max(request_ts), max(CASE WHEN current_stage = 'waiting_for_chat_response' THEN event_ts END))
               AS chat_request_ts,
             count(*) AS n_events
      FROM fx_job_events WHERE {seen} GROUP BY job_id) s ON r.job_id = s.job_id
WHERE r.rn = 1
"""


_STATE_SQL = _state_sql()
_STATE_AS_OF_SQL = _state_sql(f"event_ts <= {AS_OF_SQL}")      # only the status queries have a "now"


@query("latest_job_state", with_fixtures(_STATE_SQL, "fx_job_events"))
def q_latest_job_state(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)


@query("list_jobs", with_fixtures(f"""
SELECT job_id, regexp_extract(input_file, '([^/]*)$', 1) AS input_name, status,
       CASE status WHEN 'completed' THEN 'green' WHEN 'failed' THEN 'red' WHEN 'started' THEN 'yellow'
            ELSE 'white' END AS status_style,
       strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time
FROM ({_STATE_SQL}) ORDER BY job_id || '.json' DESC LIMIT 10""", "fx_job_events"))
def q_list_jobs(spark: SparkSession, d: str) -> DataFrame:
    return JB.list_jobs(FX.fx_job_events(spark, d))


def _elapsed_sql(col: str) -> str:
    return f"(date_diff('microsecond', {col}, {AS_OF_SQL}) / 1e6)"


@query("job_status", with_fixtures(f"""
SELECT job_id, status, input_file, start_time, page_ranges, {_elapsed_sql('start_time')} AS elapsed_seconds,
       CASE WHEN status = 'started' THEN current_stage END AS current_stage,
       CASE WHEN waiting THEN {_elapsed_sql('chat_request_ts')} END AS api_wait_seconds,
       coalesce(waiting AND {_elapsed_sql('chat_request_ts')} > 120, FALSE) AS long_wait,
       CASE WHEN status = 'started' AND {_elapsed_sql('start_time')} > 300 THEN 'yellow' ELSE 'cyan' END AS severity,
       coalesce(total_tokens, prompt_tokens + completion_tokens) AS total_tokens,
       coalesce(prompt_type, 'unknown') AS prompt_type,
       CASE WHEN status = 'completed' THEN processing_time END AS processing_time,
       CASE WHEN status = 'completed' THEN markdown_length END AS markdown_length,
       CASE WHEN status = 'completed' THEN model END AS model,
       CASE WHEN status = 'failed' THEN error END AS error,
       CASE WHEN status = 'failed' THEN error_type END AS error_type
FROM (SELECT *, status = 'started' AND current_stage = 'waiting_for_chat_response'
                AND chat_request_ts IS NOT NULL AS waiting FROM ({_STATE_AS_OF_SQL}))""", "fx_job_events"))
def q_job_status(spark: SparkSession, d: str) -> DataFrame:
    return JB.job_status(_state(spark, d, AS_OF), AS_OF)


@query("hung_jobs", with_fixtures(f"""
SELECT job_id, start_time, {_elapsed_sql('start_time')} AS elapsed_seconds,
       {_elapsed_sql('start_time')} / 60.0 AS elapsed_minutes, coalesce(current_stage, 'unknown') AS stage,
       CASE WHEN chat_request_ts IS NOT NULL THEN {_elapsed_sql('chat_request_ts')} END AS api_wait_seconds,
       input_file
FROM ({_STATE_AS_OF_SQL}) WHERE status = 'started' AND {_elapsed_sql('start_time')} > 600""", "fx_job_events"))
def q_hung_jobs(spark: SparkSession, d: str) -> DataFrame:
    return JB.hung_jobs(_state(spark, d, AS_OF), AS_OF)


@query("token_usage", with_fixtures(f"""
SELECT CAST(start_time AS DATE) AS day, model, count(*) AS n_jobs, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       CAST(sum(coalesce(total_tokens, prompt_tokens + completion_tokens)) AS BIGINT) AS total_tokens
FROM ({_STATE_SQL}) GROUP BY CAST(start_time AS DATE), model""", "fx_job_events"))
def q_token_usage(spark: SparkSession, d: str) -> DataFrame:
    return JB.token_usage(_state(spark, d))


@query("retry_routing", with_fixtures("""
SELECT event_id, job_id, error_type, error, page_ranges, retriable,
       CASE WHEN retriable AND page_ranges IS NULL THEN 'chunk'
            WHEN retriable AND fallback THEN 'ocr_fallback' ELSE 'fail' END AS next_route,
       CASE WHEN error_type = 'APITimeoutError' THEN 'api_timeout' ELSE 'api_error' END AS final_stage
FROM (SELECT event_id, job_id, error_type, error, page_ranges, event_id % 3 <> 2 AS fallback,
             coalesce(error_type = 'APITimeoutError' OR contains(error, '504')
                      OR contains(lower(error), 'timeout'), FALSE) AS retriable
      FROM fx_job_events WHERE error IS NOT NULL)""", "fx_job_events"))
def q_retry_routing(spark: SparkSession, d: str) -> DataFrame:
    ev = FX.fx_job_events(spark, d).where(F.col("error").isNotNull())
    routed = JB.retry_routing(ev, fallback_enabled=F.col("event_id") % 3 != 2)
    return routed.select("event_id", "job_id", "error_type", "error", "page_ranges", "retriable",
                         "next_route", "final_stage")


# ---------------------------------------------------------------------------------------
# Encoding, job ids, prompt fan-out, conversion and run metadata
# ---------------------------------------------------------------------------------------

@query("encode_document", with_fixtures("""
SELECT doc_id, 'doc_' || CAST(doc_id % 40 AS VARCHAR) || '.pdf' AS document_name,
       'data:application/pdf;base64,' || to_base64(encode(text)) AS document_url
FROM documents"""))
def q_encode_document(spark: SparkSession, d: str) -> DataFrame:
    return encode_document(FX.fx_file_bytes(spark, d))


_JOB_IDS_SQL = f"""
SELECT doc_id, stem || '.pdf' AS source_name, stem, job_id, job_id || '_' || substr(md5(path), 1, 8) AS unique_job_id,
       stem || '_' || job_id || '.md' AS output_markdown, stem || '_' || job_id || '_metadata.json' AS output_metadata,
       job_id || '_error' AS error_job_id, stem || '_error_' || job_id || '_error_metadata.json' AS error_metadata
FROM (SELECT doc_id, path, 'doc_' || CAST(doc_id % 40 AS VARCHAR) AS stem,
             '{RUN_JOB_PREFIX}doc_' || CAST(doc_id % 40 AS VARCHAR) AS job_id FROM fx_files)
"""


def _job_ids(spark: SparkSession, d: str) -> DataFrame:
    return job_ids(FX.fx_files(spark, d), F.lit(FX.RUN_TS).cast("timestamp_ntz"))


@query("job_ids", with_fixtures(_JOB_IDS_SQL, "fx_files"))
def q_job_ids(spark: SparkSession, d: str) -> DataFrame:
    return _job_ids(spark, d)


def _prompt_values_sql() -> str:
    rows = [f"({i + 1}, {S.lit(name)}, {len(text)})" for i, (name, text) in enumerate(PROMPTS.items())]
    return "(VALUES " + ", ".join(rows) + ") AS a(approach_no, approach, prompt_length)"


@query("approach_fanout", with_fixtures(f"""
SELECT d.doc_id, a.approach_no, a.approach, a.prompt_length, 'custom' AS prompt_type
FROM documents d CROSS JOIN {_prompt_values_sql()}"""))
def q_approach_fanout(spark: SparkSession, d: str) -> DataFrame:
    docs = FX.read_table(spark, d, "documents").select("doc_id")
    return fan_out(docs).select("doc_id", "approach_no", "approach", "prompt_length", "prompt_type")


# One converter run: every document to its end through the retry ladder. The SQL restates the
# rules over the fixture pages; `route` says which rule ended a document.
def _jobs(spark: SparkSession, d: str) -> DataFrame:
    ids = FX.fx_files(spark, d).select("doc_id", F.concat(F.lit(RUN_JOB_PREFIX), JB.stem(F.col("path"))).alias("job_id"))
    return ids.join(FX.fx_requests(spark, d), "doc_id")


def _ladder(spark: SparkSession, d: str, keep_text: bool = False) -> DataFrame:
    pages = FX.fx_pages(spark, d).select("doc_id", "page_no", "text")
    return convert_ladder(pages, _jobs(spark, d), echo_converter, ocr_echo_converter,
                          fallback_enabled=F.col("doc_id") % 3 != 2, call_rows=1000, keep_text=keep_text)["documents"]


_TIMEOUT_TYPE = "CASE WHEN doc_id % 2 = 0 THEN 'APITimeoutError' ELSE 'SDKError' END"


def _ladder_ctes() -> str:
    cleaned_whole = S.clean_sql("whole_text", key="doc_id", col="text", remove_markers=False)
    cleaned_chunk = S.clean_sql("chunk_text", key="k", col="text", remove_markers=False)
    cleaned_doc = S.clean_sql("stitched_raw", key="doc_id", col="raw", remove_markers=True)
    return _PARSE_SQL + f""",
doc_count AS (SELECT doc_id, count(*) AS total_pages FROM fx_pages GROUP BY doc_id),
doc AS (
  SELECT d.doc_id, v.page_ranges, coalesce(c.total_pages, 0) AS total_pages, coalesce(v.page_ranges, '') = '' AS no_range,
         coalesce(v.page_ranges, '') <> '' AND NOT coalesce(v.valid, FALSE) AS bad, d.doc_id % 3 <> 2 AS fallback
  FROM documents d JOIN v ON d.doc_id = v.doc_id LEFT JOIN doc_count c ON d.doc_id = c.doc_id),
whole_text AS (
  SELECT o.doc_id, coalesce(t.text, '') AS text FROM doc o
  LEFT JOIN (SELECT p.doc_id, string_agg(p.text, chr(10) ORDER BY p.page_no) AS text FROM fx_pages p JOIN doc o ON p.doc_id = o.doc_id
             WHERE o.no_range OR EXISTS (SELECT 1 FROM range_of q WHERE q.doc_id = p.doc_id AND p.page_no BETWEEN q.a AND q.b)
             GROUP BY p.doc_id) t ON o.doc_id = t.doc_id
  WHERE NOT o.bad AND NOT (o.no_range AND o.total_pages > 20)),
whole_clean AS ({cleaned_whole}),
way AS (
  SELECT *, CASE WHEN bad THEN 'bad' WHEN no_range AND total_pages > 20 THEN 'chunk'
                 WHEN doc_id % 13 = 0 THEN CASE WHEN no_range THEN 'late chunk' WHEN fallback THEN 'fallback' ELSE 'fail' END
                 WHEN doc_id % 17 = 0 THEN 'fail' ELSE 'primary' END AS way FROM doc),
chunk_plan AS (SELECT * FROM ({_PLAN_SQL}) WHERE doc_id IN (SELECT doc_id FROM way WHERE way LIKE '%chunk')),
chunk_text AS (
  SELECT pl.doc_id * 100000 + pl.chunk_number AS k, pl.doc_id, pl.chunk_number, pl.label,
         (SELECT string_agg(p.text, chr(10) ORDER BY p.page_no) FROM fx_pages p
          WHERE p.doc_id = pl.doc_id AND p.page_no BETWEEN pl.start_page AND pl.end_page) AS text
  FROM chunk_plan pl),
chunk_clean AS ({cleaned_chunk}),
chunk_end AS (
  SELECT t.doc_id, t.chunk_number, t.label,
         CASE WHEN (t.doc_id + chunk_number) % 7 = 0
                THEN CASE WHEN doc.fallback AND t.doc_id % 4 <> 3 THEN text
                          ELSE '<!-- ERROR: Chunk ' || label || ' failed: HTTP 504 Gateway Timeout -->' END
              WHEN (t.doc_id + chunk_number) % 11 = 0 THEN '<!-- ERROR: Chunk ' || label || ' failed: Unknown error -->'
              ELSE c.markdown END AS content,
         CASE WHEN (t.doc_id + chunk_number) % 7 = 0
                THEN CASE WHEN doc.fallback AND t.doc_id % 4 <> 3 THEN 0.5 + length(text) / 2000.0::DOUBLE ELSE 0.0 END
              WHEN (t.doc_id + chunk_number) % 11 = 0 THEN 0.0 ELSE length(text) / 1000.0::DOUBLE END AS seconds
  FROM chunk_text t JOIN chunk_clean c ON t.k = c.k JOIN doc ON t.doc_id = doc.doc_id),
stitched_raw AS (
  SELECT doc_id, string_agg('<!-- Pages ' || label || ' -->' || chr(10) || content || chr(10), chr(10) ORDER BY chunk_number) AS raw
  FROM chunk_end GROUP BY doc_id),
stitched AS ({cleaned_doc}),
chunked AS (
  SELECT e.doc_id, count(*) FILTER (WHERE NOT starts_with(content, '<!-- ERROR')) AS good, count(*) AS n, sum(seconds) AS seconds,
         any_value(s.markdown) AS markdown
  FROM chunk_end e JOIN stitched s ON e.doc_id = s.doc_id GROUP BY e.doc_id),
ended AS (
  SELECT w.doc_id, w.page_ranges, w.way, w.way = 'late chunk' AND coalesce(c.good, 0) = 0 AS gave_up, c.good, c.n,
         CASE WHEN w.way = 'primary' OR (w.way LIKE '%chunk' AND coalesce(c.good, 0) > 0) OR (w.way = 'fallback' AND w.doc_id % 4 <> 3)
              THEN 'success' ELSE 'error' END AS status,
         CASE w.way WHEN 'primary' THEN p.markdown WHEN 'fallback' THEN t.text ELSE c.markdown END AS markdown,
         t.text, c.seconds
  FROM way w LEFT JOIN chunked c ON w.doc_id = c.doc_id LEFT JOIN whole_text t ON w.doc_id = t.doc_id
  LEFT JOIN whole_clean p ON w.doc_id = p.doc_id),
ladder AS (
  SELECT doc_id, page_ranges, status,
    CASE WHEN way LIKE '%chunk' THEN 'chunk' WHEN way = 'fallback' THEN 'ocr_fallback' WHEN way = 'bad' THEN 'fail' ELSE way END AS route,
    way = 'fallback' AND status = 'success' AS fallback_used,
    way = 'primary' OR (way LIKE '%chunk' AND status = 'success') AS formatting_preserved,
    CASE WHEN way = 'primary' THEN 'converter'
         WHEN way = 'fallback' AND status = 'success' THEN 'converter (OCR fallback - formatting reduced)'
         WHEN way LIKE '%chunk' AND NOT gave_up
           THEN 'converter (chunked: ' || CAST(good AS VARCHAR) || '/' || CAST(n AS VARCHAR) || ' chunks)' END AS model,
    CASE WHEN way = 'bad' THEN 'invalid page ranges: ' || page_ranges
         WHEN gave_up OR (status = 'error' AND way IN ('fallback', 'fail') AND doc_id % 13 = 0) THEN 'HTTP 504 Gateway Timeout'
         WHEN way = 'fail' THEN 'bad request' END AS error,
    CASE WHEN way = 'bad' THEN 'ValueError'
         WHEN gave_up OR (status = 'error' AND way IN ('fallback', 'fail') AND doc_id % 13 = 0) THEN {_TIMEOUT_TYPE}
         WHEN way = 'fail' THEN 'SDKError' END AS error_type,
    CASE WHEN status = 'success' OR (way LIKE '%chunk' AND NOT gave_up) THEN length(markdown) END AS markdown_length,
    CASE way WHEN 'bad' THEN 0.0 WHEN 'primary' THEN length(text) / 1000.0::DOUBLE WHEN 'fail' THEN 0.5
         WHEN 'fallback' THEN 0.5 + length(text) / 2000.0::DOUBLE
         WHEN 'chunk' THEN seconds ELSE 0.5 + coalesce(seconds, 0.0) END AS processing_time
  FROM ended)
"""


_LADDER_SQL = _ladder_ctes()


@query("convert_documents", with_fixtures(_LADDER_SQL + """
SELECT doc_id, status, route, fallback_used, formatting_preserved, model, error, error_type, markdown_length,
       round(processing_time, 6) AS processing_time FROM ladder""", "fx_requests", "fx_pages", "fx_files"))
def q_convert_documents(spark: SparkSession, d: str) -> DataFrame:
    c = _ladder(spark, d)
    return c.select("doc_id", "status", "route", "fallback_used", "formatting_preserved", "model", "error", "error_type",
                    "markdown_length", F.round("processing_time", 6).alias("processing_time"))


@query("convert_ladder", with_fixtures(_LADDER_SQL + """
SELECT l.doc_id, l.status, CASE WHEN l.status = 'success' OR (l.route = 'chunk' AND l.error IS NULL) THEN e.markdown END AS markdown
FROM ladder l JOIN ended e ON l.doc_id = e.doc_id""", "fx_requests", "fx_pages", "fx_files"))
def q_convert_ladder(spark: SparkSession, d: str) -> DataFrame:
    return _ladder(spark, d, keep_text=True).select("doc_id", "status", "markdown")


# Prompt variants: every document once per variant, keyed by (doc_id, approach).
@query("approach_summary", with_fixtures(f"""
SELECT doc_id, count(*) AS total_approaches, count(*) FILTER (WHERE ok) AS successful,
       count(*) FILTER (WHERE NOT ok) AS failed,
       coalesce(string_agg(CASE WHEN ok THEN approach END, ',' ORDER BY approach_no), '') AS successful_approaches,
       coalesce(string_agg(CASE WHEN NOT ok THEN approach END, ',' ORDER BY approach_no), '') AS failed_approaches,
       count(*) FILTER (WHERE ok) = 0 AS all_failed
FROM (SELECT d.doc_id, a.approach_no, a.approach,
             d.doc_id % 13 <> 0 AND d.doc_id % 17 <> 0 AND (d.doc_id + a.approach_no) % 9 <> 0 AS ok
      FROM documents d CROSS JOIN {_prompt_values_sql()})
GROUP BY doc_id"""))
def q_approach_summary(spark: SparkSession, d: str) -> DataFrame:
    # One page per document and no chunking: each run is a single call with the variant's prompt.
    docs = FX.read_table(spark, d, "documents")
    pages = docs.select("doc_id", F.lit(1).alias("page_no"), "text")
    jobs = fan_out(docs.select("doc_id", F.concat(F.lit(RUN_JOB_PREFIX), JB.stem(FX.fx_path())).alias("job_id"),
                               F.lit("1").alias("page_ranges")))
    runs = convert_ladder(pages, jobs, echo_converter, ocr_echo_converter, keys=["doc_id", "approach"],
                          disable_chunking=True, fallback_enabled=False, call_rows=1000, keep_text=False)["documents"]
    numbered = runs.join(jobs.select("doc_id", "approach", "approach_no"), ["doc_id", "approach"])
    s = approach_summary(numbered)
    return s.select("doc_id", "total_approaches", "successful", "failed",
                    F.array_join("successful_approaches", ",").alias("successful_approaches"),
                    F.array_join("failed_approaches", ",").alias("failed_approaches"), "all_failed")


def _run_metadata(spark: SparkSession, d: str) -> DataFrame:
    return run_metadata(_job_ids(spark, d), _routed(spark, d), PR.size_reduction(FX.fx_files(spark, d)), _ladder(spark, d),
                        F.lit(FX.RUN_TS).cast("timestamp_ntz"))


_METADATA_SQL = _LADDER_SQL + f"""
SELECT i.doc_id, i.job_id, i.unique_job_id, CAST(NULL AS VARCHAR) AS approach, i.source_name AS source_pdf,
       CASE WHEN c.status = 'success' THEN i.output_markdown END AS output_markdown,
       '2024-01-30T12:00:00' AS processing_date,
       coalesce(CASE WHEN c.page_ranges <> '' THEN c.page_ranges END, 'all') AS pages_processed,
       coalesce(r.route <> 'skipped', FALSE) AS optimization_performed,
       CASE WHEN coalesce(r.route <> 'skipped', FALSE)
            THEN coalesce(CASE WHEN f.file_size_bytes = 0 THEN 'N/A'
                               ELSE printf('%.1f', round_even((CAST(f.file_size_bytes AS DOUBLE) - CAST(f.optimized_size_bytes AS DOUBLE))
                                      / CAST(f.file_size_bytes AS DOUBLE) * 100, 1)) || '%' END, 'N/A')
            ELSE 'N/A' END AS size_reduction,
       CASE WHEN r.route = 'remove_images' THEN r.total_images ELSE 0 END AS images_removed,
       CAST(0.0 AS DOUBLE) AS optimization_seconds,
       round(c.processing_time, 6) AS ocr_seconds, round(c.processing_time, 6) AS total_seconds,
       coalesce(c.model, 'unknown') AS model, 0 AS prompt_length, CAST(NULL AS VARCHAR) AS custom_prompt_file, c.status,
       CASE WHEN c.status = 'success' THEN c.markdown_length ELSE 0 END AS markdown_length,
       CASE WHEN c.status <> 'success' THEN coalesce(c.error, 'Unknown error') END AS error,
       CASE WHEN c.status <> 'success' THEN coalesce(c.error_type, 'UnknownError') END AS error_type,
       CASE WHEN c.status <> 'success' THEN '2024-01-30T12:00:00' END AS failed_at
FROM ({_JOB_IDS_SQL}) i
LEFT JOIN ({_ROUTING_SQL}) r ON i.doc_id = r.doc_id
LEFT JOIN fx_files f ON i.doc_id = f.doc_id
LEFT JOIN ladder c ON i.doc_id = c.doc_id
"""


@query("run_metadata", with_fixtures(_METADATA_SQL, "fx_pages", "fx_files", "fx_requests"))
def q_run_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = _run_metadata(spark, d)
    return m.withColumns({c: F.round(c, 6) for c in ("ocr_seconds", "total_seconds")})


@query("timing_summary", with_fixtures(f"""
SELECT status, optimization_performed, count(*) AS runs, round(sum(optimization_seconds), 4) AS optimization_seconds,
       round(sum(ocr_seconds), 4) AS ocr_seconds, round(sum(total_seconds), 4) AS total_seconds
FROM ({_METADATA_SQL}) GROUP BY status, optimization_performed""", "fx_pages", "fx_files", "fx_requests"))
def q_timing_summary(spark: SparkSession, d: str) -> DataFrame:
    # Sums of doubles depend on the summation order; four decimals make the check order-free.
    t = timing_summary(_run_metadata(spark, d).withColumns({c: F.round(c, 6) for c in ("ocr_seconds", "total_seconds")}))
    return t.select("status", "optimization_performed", "runs",
                    *[F.round(c, 4).alias(c) for c in ("optimization_seconds", "ocr_seconds", "total_seconds")])


def _original_chunk_id(parent: F.Column, chunk_number: F.Column) -> F.Column:
    """Id the chunk's own run had before re-keying: one minute per chunk after the parent."""
    return F.format_string("job_20240130_12%02d00_%s", chunk_number,
                           F.regexp_extract(parent, r"^job_[0-9]{8}_[0-9]{6}_(.*)$", 1))


@query("chunk_job_link", with_fixtures(f"""
SELECT doc_id, CASE WHEN success THEN job_id ELSE original_job_id END AS job_id, original_job_id,
       parent_job_id, chunk_number, total_chunks, pages AS page_range, success AS is_chunk,
       CASE WHEN (doc_id + chunk_number) % 7 = 0 OR (doc_id + chunk_number) % 11 = 0 THEN 'failed' ELSE 'completed' END AS status
FROM (SELECT *, printf('job_20240130_12%02d00_%s', chunk_number, 'doc_' || CAST(doc_id % 40 AS VARCHAR)) AS original_job_id
      FROM ({_CHUNK_RESULTS_SQL}))""", "fx_pages", "fx_files"))
def q_chunk_job_link(spark: SparkSession, d: str) -> DataFrame:
    runs = _plan(spark, d).join(_chunk_outcomes(spark, d).select("doc_id", "chunk_number", "status"), ["doc_id", "chunk_number"]).select(
        "doc_id", "chunk_number", _original_chunk_id(F.col("job_id"), F.col("chunk_number")).alias("original_job_id"),
        F.when(F.col("status") == "success", "completed").otherwise("failed").alias("status"))
    return CH.chunk_job_link(_chunk_results(spark, d), runs)
