"""Catalogue queries that write and read back: files, the ledger's tables, the result cache, streams.

Each works in a new folder below the shared checkpoint folder, on data that Spark derives
from the given tables, and returns what is read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.operators import jobs as JB
from docpipe.operators import profile as PR
from docpipe.operators.convert import convert, echo_converter
from docpipe.operators.results import run_metadata
from docpipe.operators.resume import convert_resumable
from docpipe.plans import sqltext as S
from docpipe.plans.catalog import (
    _CHUNK_RESULTS_SQL,
    _JOB_IDS_SQL,
    _ROUTING_SQL,
    _STATE_SQL,
    _chunk_results,
    _job_ids,
    _prompt_values_sql,
    _routed,
    query,
)
from docpipe.session import checkpoint_dir, reliable
from docpipe.sources import fixtures as FX
from docpipe.sources import job_table as JT
from docpipe.sources.files import extract_page_ranges, extracted, list_files
from docpipe.sources.fixtures import FX_TEXT_LIMIT, with_fixtures
from docpipe.sources.named_files import file_system, write_named
from docpipe.sources.prompts import fan_out, read_prompt_file
from docpipe.streaming import ledger as SL
from docpipe.streaming import responses as SR

#: A custom prompt, written to a file and read back (a fixed value of the fixtures).
CUSTOM_PROMPT = "Convert the page to Markdown.\nKeep tables and footnotes."
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stored-{name}-{uuid.uuid4().hex}"


def _streaming(spark: SparkSession) -> SparkSession:
    """A session of its own for a stream: the state store is a session setting, and the caller's stay as they are."""
    own = spark.newSession()
    own.conf.set(*STATE_STORE)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


# --- profile details -----------------------------------------------------------------------

@query("page_details", with_fixtures(f"""
SELECT f.doc_id, p.page_no AS page, CAST(p.images AS INTEGER) AS images, CAST(length(p.text) AS INTEGER) AS text_length,
       length(p.text) > {FX_TEXT_LIMIT} AS exceeds_64kb, count(*) OVER (PARTITION BY f.doc_id) AS total_pages
FROM fx_files f JOIN fx_pages p ON f.doc_id = p.doc_id""", "fx_files", "fx_pages"))
def q_page_details(spark: SparkSession, d: str) -> DataFrame:
    profile = PR.document_profile(FX.fx_pages(spark, d), FX.fx_files(spark, d), FX_TEXT_LIMIT, include_page_details=True)
    return profile.select("doc_id", "total_pages", F.explode("page_details").alias("p")).select("doc_id", "p.*", "total_pages")


# --- files -----------------------------------------------------------------------------------

def _open(path: str):
    fs, name = file_system(path)
    return fs.open_input_file(name)


def _lines(handle) -> list[str]:
    return handle.read().decode().split("\n")


@query("document_files", with_fixtures("""
SELECT CAST(doc_id AS VARCHAR) || '.txt' AS file_name, CAST(strlen(text) AS BIGINT) AS file_size_bytes, page_no, page_text
FROM (SELECT doc_id, text, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS page_no,
             unnest(string_split(text, chr(10))) AS page_text FROM documents)"""))
def q_document_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files, listed and read page by page (a page is a line) in ranges of 16 pages."""
    path = _folder(spark, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    write_named(FX.read_table(spark, d, "documents").where("text IS NOT NULL").select(
        name.alias("name"), name.alias("second_name"), F.col("text").alias("content")), path)
    files = reliable(list_files(spark, path))               # listed once, for pages and for names
    pages = extract_page_ranges(
        files, _open, lambda handle: len(_lines(handle)),
        lambda handle, first, last: [(k, text, 0) for k, text in enumerate(_lines(handle), start=1)][first - 1:last], pages_per_range=16)
    named = files.select("doc_id", JB.base_name(F.col("path")).alias("file_name"), "file_size_bytes")
    return extracted(pages).join(named, "doc_id").select("file_name", "file_size_bytes", "page_no", F.col("text").alias("page_text"))


@query("approach_metadata", with_fixtures(f"""
SELECT i.doc_id, i.job_id, i.approach, CASE WHEN ok THEN i.stem || '_' || i.approach || '_' || i.job_id || '.md' END AS output_markdown,
       CASE WHEN i.approach = 'custom' THEN 'custom_prompt.txt' END AS custom_prompt_file, CAST(i.prompt_length AS INTEGER) AS prompt_length,
       CASE WHEN ok THEN 'success' ELSE 'error' END AS status, CASE WHEN ok THEN length(d.text) ELSE 0 END AS markdown_length,
       coalesce(r.route <> 'skipped', FALSE) AS optimization_performed,
       CASE WHEN i.doc_id % 13 = 0 THEN 'HTTP 504 Gateway Timeout' WHEN NOT ok THEN 'bad request' END AS error,
       CASE WHEN NOT ok THEN '2024-01-30T12:00:00' END AS failed_at
FROM (SELECT j.*, x.*, j.doc_id % 13 <> 0 AND j.doc_id % 17 <> 0 AND (j.doc_id + x.approach_no) % 9 <> 0 AS ok
      FROM ({_JOB_IDS_SQL}) j CROSS JOIN (SELECT * FROM {_prompt_values_sql()}
           UNION ALL SELECT 9, 'custom', {len(CUSTOM_PROMPT)}) x) i
JOIN documents d ON i.doc_id = d.doc_id LEFT JOIN ({_ROUTING_SQL}) r ON i.doc_id = r.doc_id""", "fx_pages", "fx_files"))
def q_approach_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The metadata record of every prompt variant's run, a custom prompt read from its file among them."""
    path = _folder(spark, "prompt")
    write_named(spark.createDataFrame([("custom_prompt.txt", "custom_prompt-2.txt", CUSTOM_PROMPT)], "name string, second_name string, content string"), path)
    prompt = read_prompt_file(spark, f"{path}/custom_prompt.txt")
    docs = FX.read_table(spark, d, "documents").select("doc_id", "text", F.lit(0).alias("chunk_number"))
    runs = convert(fan_out(docs, custom_prompt=prompt), echo_converter, ["doc_id", "approach", "prompt_length"],
                   ["approach_no", "chunk_number", "text", "prompt"], call_rows=1000)
    results = runs.select(
        "doc_id", "approach", "prompt_length", "status", "error", "error_type", "processing_time",
        F.length("markdown").cast("long").alias("markdown_length"), F.lit("converter").alias("model"), F.lit(None).cast("string").alias("page_ranges"),
        F.when(F.col("approach") == "custom", "custom_prompt.txt").alias("custom_prompt_file"))
    meta = run_metadata(_job_ids(spark, d), _routed(spark, d), PR.size_reduction(FX.fx_files(spark, d)), results,
                        F.lit(FX.RUN_TS).cast("timestamp_ntz"))
    return meta.select("doc_id", "job_id", "approach", "output_markdown", "custom_prompt_file", "prompt_length", "status", "markdown_length",
                       "optimization_performed", "error", "failed_at")


# --- ledger and result cache ------------------------------------------------------------------

@query("ledger_table", with_fixtures(_STATE_SQL, "fx_job_events"))
def q_ledger_table(spark: SparkSession, d: str) -> DataFrame:
    """The state of every job from a ledger of four appends, the first two compacted in turn."""
    path = _folder(spark, "ledger")
    events = FX.fx_job_events(spark, d)
    for seq in range(4):
        JT.append(events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == seq), path, seq)
        if seq < 2:
            JT.compact(spark, path, buckets=16)
    return JT.job_state(spark, path)


@query("resumed_conversion", with_fixtures("""
SELECT doc_id, CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'error' ELSE 'success' END AS status,
       CASE WHEN doc_id % 13 <> 0 AND doc_id % 17 <> 0 THEN length(text) END AS markdown_length,
       CASE WHEN doc_id % 13 = 0 THEN 'HTTP 504 Gateway Timeout' WHEN doc_id % 17 = 0 THEN 'bad request' END AS error,
       doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 2 = 0 AS cached
FROM documents"""))
def q_resumed_conversion(spark: SparkSession, d: str) -> DataFrame:
    """A run over all documents after one over those of even id: what worked then comes from the cache."""
    cache = _folder(spark, "cache")
    docs = FX.read_table(spark, d, "documents").select("doc_id", "text", F.lit(0).alias("chunk_number"))

    def run(of: DataFrame) -> DataFrame:
        return convert_resumable(of, echo_converter, ["doc_id"], ["doc_id", "chunk_number", "text"], cache, "echo 1", call_rows=1000)

    run(docs.where("doc_id % 2 = 0"))
    return run(docs).select("doc_id", "status", F.length("markdown").cast("long").alias("markdown_length"), "error", "cached")


# --- streams ----------------------------------------------------------------------------------

_LAST_SQL = "(SELECT max(event_ts) FROM fx_job_events)"


@query("hung_job_stream", with_fixtures(f"""
SELECT job_id, start_time, coalesce(current_stage, 'unknown') AS stage, input_file, start_time + INTERVAL 600 SECOND AS deadline
FROM ({_STATE_SQL}) WHERE status = 'started' AND epoch_ms(start_time + INTERVAL 600 SECOND) < epoch_ms({_LAST_SQL})""", "fx_job_events"))
def q_hung_job_stream(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of the stream over all ledger events, up to its last event."""
    path, own = _folder(spark, "alerts"), _streaming(spark)
    FX.fx_job_events(spark, d).write.parquet(f"{path}/events")
    (SL.hung_job_alerts(SL.read_job_events(own, f"{path}/events"), watermark="0 seconds").writeStream.format("parquet")
     .option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append")
     .trigger(availableNow=True).start()).awaitTermination()
    return spark.read.schema(SL.ALERT_SCHEMA).parquet(f"{path}/out")


@query("live_job_stream", with_fixtures(f"""
SELECT job_id, status, current_stage, input_file, error, page_ranges, prompt_tokens, completion_tokens, last_event_ts, start_time
FROM ({_STATE_SQL})""", "fx_job_events"))
def q_live_job_stream(spark: SparkSession, d: str) -> DataFrame:
    """The last state that the live stream tells of each job."""
    path, own = _folder(spark, "live"), _streaming(spark)
    FX.fx_job_events(spark, d).write.parquet(f"{path}/events")

    def told(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    (SL.live_job_state(SL.read_job_events(own, f"{path}/events"), retention_seconds=10 ** 8).writeStream.foreachBatch(told)
     .option("checkpointLocation", f"{path}/state").outputMode("update").trigger(availableNow=True).start()).awaitTermination()
    rows = spark.read.schema(f"{SL.LIVE_SCHEMA}, batch long").parquet(f"{path}/out")
    fields = [c for c in rows.columns if c not in ("job_id", "batch")]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*fields), F.struct("last_event_ts", "batch")).alias("s")).select("job_id", "s.*")


@query("cleaned_stream", with_fixtures(S.clean_sql("fx_responses", remove_markers=False), "fx_responses"))
def q_cleaned_stream(spark: SparkSession, d: str) -> DataFrame:
    """Answers cleaned as their files land."""
    path = _folder(spark, "cleaning")
    FX.fx_responses(spark, d).write.parquet(f"{path}/in")      # as many files as the table has splits
    SR.start_cleaning(spark, f"{path}/in", f"{path}/out", f"{path}/state", available_now=True).awaitTermination()
    return spark.read.schema("doc_id long, markdown string").parquet(f"{path}/out")


@query("completed_parents", with_fixtures(f"""
SELECT doc_id, CAST(NULL AS VARCHAR) AS approach, CAST(max(total_chunks) AS INTEGER) AS total_chunks
FROM ({_CHUNK_RESULTS_SQL}) GROUP BY doc_id HAVING count(*) FILTER (WHERE (doc_id + chunk_number) % 13 <> 0) = max(total_chunks)""",
                                       "fx_pages", "fx_files"))
def q_completed_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents whose every chunk has landed, some chunks twice; a thirteenth of all chunks is missing."""
    path, own = _folder(spark, "chunks"), _streaming(spark)
    chunks = _chunk_results(spark, d).where("(doc_id + chunk_number) % 13 <> 0").withColumn("approach", F.lit(None).cast("string"))
    chunks = chunks.select(*SR.chunk_columns())
    chunks.write.parquet(f"{path}/in")
    chunks.where("chunk_number = 1").write.mode("append").parquet(f"{path}/in")
    SR.start_parent_completion(own, f"{path}/in", f"{path}/out", f"{path}/state", available_now=True).awaitTermination()
    return spark.read.schema("doc_id long, approach string, total_chunks int").parquet(f"{path}/out")
