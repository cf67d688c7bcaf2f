"""Fixture views derived from the driver's tables.

The conversion tool's own inputs are PDF files and model answers, which the test data does
not contain. These views derive such inputs from ``documents``, ``pages`` and ``events``
deterministically, once as DataFrame code and once as DuckDB SQL, so that the Spark
queries and their SQL oracle read identical rows. Every view is a narrow projection of one
driver table (no shuffle); chunk outcomes are derived in ``plans/catalog.py`` from the
chunk plan, slicing each chunk's pages out of its document row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.sources.tables import read_table

# Fixed run time of the fixture batch; job ids and "now" of the ledger queries use it.
RUN_TS = "2024-01-30 12:00:00"
AS_OF = "2024-01-30 12:00:00"
FX_TEXT_LIMIT = 400       # page text limit used on the fixtures (instead of 64,000)

NL = "\n"


def _docs(spark: SparkSession, data_dir: str, *cols: str) -> DataFrame:
    return read_table(spark, data_dir, "documents").select(*cols)


def fx_pages(spark: SparkSession, data_dir: str) -> DataFrame:
    """One page per line of a document: doc_id, page_no, text, images."""
    lines = _docs(spark, data_dir, "doc_id", "text").select(
        "doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "text")).where(F.col("pos").isNotNull())
    page_no = (F.col("pos") + 1).cast("int")
    images = F.when((F.col("doc_id") + page_no) % 23 == 0,
                    (F.col("doc_id") * 7 + page_no * 3) % 41).otherwise(F.lit(0).cast("bigint"))
    return lines.select("doc_id", page_no.alias("page_no"), "text", images.alias("images"))


def fx_pages_sized(spark: SparkSession, data_dir: str) -> DataFrame:
    """fx_pages plus ``n_pages``, the page count of the document on every page row (known
    where pages are extracted; here the line count of the document row, so no join)."""
    d = _docs(spark, data_dir, "doc_id", "text").withColumn("_lines", F.split("text", "\n", -1))
    lines = d.select("doc_id", F.size("_lines").cast("long").alias("n_pages"),
                     F.posexplode_outer("_lines").alias("pos", "text")).where(F.col("pos").isNotNull())
    page_no = (F.col("pos") + 1).cast("int")
    images = F.when((F.col("doc_id") + page_no) % 23 == 0,
                    (F.col("doc_id") * 7 + page_no * 3) % 41).otherwise(F.lit(0).cast("bigint"))
    return lines.select("doc_id", page_no.alias("page_no"), "text", images.alias("images"), "n_pages")


FX_PAGES_SQL = """
SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, text,
       CASE WHEN (doc_id + page_no) % 23 = 0 THEN (doc_id * 7 + page_no * 3) % 41 ELSE 0 END AS images
FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_no,
             unnest(string_split(text, chr(10))) AS text FROM documents)
"""


def fx_path() -> Column:
    """A path per document; many documents share a file name, as in any real collection."""
    return F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("/doc_"),
                    (F.col("doc_id") % 40).cast("string"), F.lit(".pdf"))


def fx_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """Stand-in file listing: doc_id, path, file_size_bytes, optimized_size_bytes."""
    d = _docs(spark, data_dir, "doc_id", "source", "n_chars")
    zero = F.col("doc_id") % 97 == 0
    return d.select(
        "doc_id",
        fx_path().alias("path"),
        F.when(zero, F.lit(0).cast("bigint")).otherwise(F.col("n_chars") * 16384).alias("file_size_bytes"),
        F.when(zero, F.lit(0).cast("bigint")).otherwise(
            F.col("n_chars") * (16384 - (F.col("doc_id") % 60) * 128)).alias("optimized_size_bytes"))


FX_FILES_SQL = """
SELECT doc_id, concat('/corpus/', source, '/', CAST(doc_id AS VARCHAR), '/doc_', CAST(doc_id % 40 AS VARCHAR), '.pdf') AS path,
       CASE WHEN doc_id % 97 = 0 THEN 0 ELSE n_chars * 16384 END AS file_size_bytes,
       CASE WHEN doc_id % 97 = 0 THEN 0 ELSE n_chars * (16384 - (doc_id % 60) * 128) END AS optimized_size_bytes
FROM documents
"""

_REQUEST_SPECS = ["1-3,5,7-9", " 2 - 4 ,3", "5-3", "1", "10,1,1", "1-2-3", "x", "3-1000000000,0"]


def fx_requests(spark: SparkSession, data_dir: str) -> DataFrame:
    """Page-range requests per document: doc_id, page_ranges (NULL = all pages)."""
    k = F.col("doc_id") % 10
    spec: Column = F.lit(None).cast("string")
    for i in reversed(range(len(_REQUEST_SPECS))):
        spec = F.when(k == i, F.lit(_REQUEST_SPECS[i])).otherwise(spec)
    return _docs(spark, data_dir, "doc_id").select("doc_id", spec.alias("page_ranges"))


FX_REQUESTS_SQL = """
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN '1-3,5,7-9' WHEN 1 THEN ' 2 - 4 ,3' WHEN 2 THEN '5-3'
       WHEN 3 THEN '1' WHEN 4 THEN '10,1,1' WHEN 5 THEN '1-2-3' WHEN 6 THEN 'x' WHEN 7 THEN '3-1000000000,0' END AS page_ranges
FROM documents
"""


def _lines(*parts: str) -> Column:
    return F.concat_ws(NL, *[F.lit(p) for p in parts])


def fx_responses(spark: SparkSession, data_dir: str) -> DataFrame:
    """Model answers with injected chatter: doc_id, content."""
    d = _docs(spark, data_dir, "doc_id", "text")
    doc = F.col("doc_id")
    head = (
        F.when(doc % 10 == 0, _lines("Here is the PDF converted to Markdown format:", "", "# Title", "", ""))
        .when(doc % 10 == 1, _lines("---", "All formatting has been preserved as requested.",
                                    "- **Bold** text converted to `**bold**`", "---"))
        .when(doc % 10 == 2, _lines("---", "All formatting has been preserved as requested.",
                                    "The damage rule follows.", "---"))
        .when(doc % 10 == 3, _lines("---", "Formatting preserved as specified.", ""))
        .when(doc % 10 == 4, F.when(doc % 30 == 4, _lines("```markdown", "```", ""))
              .otherwise(_lines("```markdown", "```", "", "code", "```")))
        .when(doc % 10 == 5, _lines("<!-- Pages 1-2 -->", "", "", "<!-- ERROR: Chunk 3 failed: 504 -->"))
        .when(doc % 10 == 6, _lines("first", "", "---", "", "second", "", "---", "",
                                    "Formatting preserved as requested.", "---"))
        .when(doc % 10 == 7, F.lit("When you act under fire: roll+hard, then stop."))
        .when(doc % 10 == 8, F.lit("When you read a person, roll+Sharp. On a hit: stay cool."))
        .otherwise(F.lit("   ")))
    body = F.when(doc % 30 == 4, F.concat(F.lit("Formatting preserved as specified.\n"), F.col("text"))).otherwise(F.col("text"))
    tail = F.when(doc % 4 == 0, F.lit("All formatting has been preserved as specified.")).otherwise(F.lit("end "))
    answers = d.select("doc_id", F.concat_ws(NL, head, body, tail).alias("content"))
    # the cases without text are answers of their own, under negative ids
    bare = d.where((doc % 250 == 9) | (doc % 250 == 19)).select(
        (-1 - doc).alias("doc_id"), F.when(doc % 250 == 19, F.lit("")).alias("content"))
    short = d.where(doc % 30 == 4).select((-1 - doc).alias("doc_id"), _lines(
        "```markdown", "```", "", "Formatting preserved as specified.").alias("content"))
    return answers.union(bare).union(short)


FX_RESPONSES_SQL = """
SELECT doc_id, concat_ws(chr(10),
  CASE doc_id % 10
    WHEN 0 THEN concat_ws(chr(10), 'Here is the PDF converted to Markdown format:', '', '# Title', '', '')
    WHEN 1 THEN concat_ws(chr(10), '---', 'All formatting has been preserved as requested.', '- **Bold** text converted to `**bold**`', '---')
    WHEN 2 THEN concat_ws(chr(10), '---', 'All formatting has been preserved as requested.', 'The damage rule follows.', '---')
    WHEN 3 THEN concat_ws(chr(10), '---', 'Formatting preserved as specified.', '')
    WHEN 4 THEN CASE WHEN doc_id % 30 = 4 THEN concat_ws(chr(10), '```markdown', '```', '')
                     ELSE concat_ws(chr(10), '```markdown', '```', '', 'code', '```') END
    WHEN 5 THEN concat_ws(chr(10), '<!-- Pages 1-2 -->', '', '', '<!-- ERROR: Chunk 3 failed: 504 -->')
    WHEN 6 THEN concat_ws(chr(10), 'first', '', '---', '', 'second', '', '---', '', 'Formatting preserved as requested.', '---')
    WHEN 7 THEN 'When you act under fire: roll+hard, then stop.'
    WHEN 8 THEN 'When you read a person, roll+Sharp. On a hit: stay cool.'
    ELSE '   ' END,
  CASE WHEN doc_id % 30 = 4 THEN 'Formatting preserved as specified.' || chr(10) || text ELSE text END,
  CASE WHEN doc_id % 4 = 0 THEN 'All formatting has been preserved as specified.' ELSE 'end ' END) AS content
FROM documents
UNION ALL
SELECT -1 - doc_id, CASE WHEN doc_id % 250 = 19 THEN '' END FROM documents WHERE doc_id % 250 IN (9, 19)
UNION ALL
SELECT -1 - doc_id, concat_ws(chr(10), '```markdown', '```', '', 'Formatting preserved as specified.') FROM documents
WHERE doc_id % 30 = 4
"""


def fx_job_events(spark: SparkSession, data_dir: str) -> DataFrame:
    """Job ledger events derived from ``events``."""
    e = read_table(spark, data_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    et = F.col("event_type")
    eid = F.col("event_id")
    return e.select(
        "event_id",
        F.concat(F.lit("job_"), F.date_format("ts", "yyyyMMdd"), F.lit("_000000_doc"),
                 F.col("user_id").cast("string")).alias("job_id"),
        F.col("ts").alias("event_ts"),
        F.when(et == "purchase", "completed").when(et == "error", "failed").otherwise("started").alias("status"),
        F.when(et == "view", "waiting_for_chat_response").when(et == "click", "preparing_chat_request")
        .when(et == "signup", "processing_response")
        .when(et == "error", F.when(eid % 2 == 0, "api_timeout").otherwise("api_error")).alias("current_stage"),
        F.concat(F.lit("/corpus/doc"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("input_file"),
        F.when(et == "error", F.when(eid % 3 == 0, "HTTP 504").when(eid % 3 == 1, "Request Timeout")
               .otherwise("bad request")).alias("error"),
        F.when(eid % 4 == 0, F.lit("1-5")).alias("page_ranges"),
        F.floor("value").cast("bigint").alias("prompt_tokens"),
        (eid % 1000).cast("bigint").alias("completion_tokens"),
        F.when(eid % 5 == 0, F.floor("value").cast("bigint") + eid % 1000 + 3).alias("total_tokens"),
        F.when(eid % 6 == 0, F.col("ts") - F.expr("INTERVAL 30 SECONDS")).alias("start_time"),
        F.when(et.isin("purchase", "error"), F.col("ts")).alias("end_time"),
        F.when(eid % 7 == 0, F.col("ts") - F.expr("INTERVAL 5 SECONDS")).alias("request_ts"),
        F.when(eid % 3 == 0, "default").when(eid % 3 == 1, "custom").alias("prompt_type"),
        F.when(et == "purchase", F.col("value")).alias("processing_time"),
        F.when(eid % 2 == 0, "model-a").when(eid % 3 == 0, "model-b").alias("model"),
        F.when(et == "purchase", eid * 10).alias("markdown_length"),
        F.when(et == "error", F.when(eid % 2 == 0, "APITimeoutError").otherwise("SDKError")).alias("error_type"),
        F.lit(None).cast("string").alias("parent_job_id"),
        F.lit(None).cast("boolean").alias("is_chunk"),
    )


FX_JOB_EVENTS_SQL = """
SELECT event_id, concat('job_', strftime(ts, '%Y%m%d'), '_000000_doc', CAST(user_id AS VARCHAR)) AS job_id,
  ts AS event_ts,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'started' END AS status,
  CASE event_type WHEN 'view' THEN 'waiting_for_chat_response' WHEN 'click' THEN 'preparing_chat_request'
    WHEN 'signup' THEN 'processing_response'
    WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'api_timeout' ELSE 'api_error' END END AS current_stage,
  concat('/corpus/doc', CAST(user_id AS VARCHAR), '.pdf') AS input_file,
  CASE event_type WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'HTTP 504' WHEN 1 THEN 'Request Timeout' ELSE 'bad request' END END AS error,
  CASE WHEN event_id % 4 = 0 THEN '1-5' END AS page_ranges,
  CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(event_id % 1000 AS BIGINT) AS completion_tokens,
  CASE WHEN event_id % 5 = 0 THEN CAST(floor(value) AS BIGINT) + event_id % 1000 + 3 END AS total_tokens,
  CASE WHEN event_id % 6 = 0 THEN ts - INTERVAL 30 SECOND END AS start_time,
  CASE WHEN event_type IN ('purchase', 'error') THEN ts END AS end_time,
  CASE WHEN event_id % 7 = 0 THEN ts - INTERVAL 5 SECOND END AS request_ts,
  CASE event_id % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'custom' END AS prompt_type,
  CASE WHEN event_type = 'purchase' THEN value END AS processing_time,
  CASE WHEN event_id % 2 = 0 THEN 'model-a' WHEN event_id % 3 = 0 THEN 'model-b' END AS model,
  CASE WHEN event_type = 'purchase' THEN event_id * 10 END AS markdown_length,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'APITimeoutError' ELSE 'SDKError' END END AS error_type,
  CAST(NULL AS VARCHAR) AS parent_job_id, CAST(NULL AS BOOLEAN) AS is_chunk
FROM events
"""


FIXTURE_SQL = {
    "fx_pages": FX_PAGES_SQL,
    "fx_files": FX_FILES_SQL,
    "fx_requests": FX_REQUESTS_SQL,
    "fx_responses": FX_RESPONSES_SQL,
    "fx_job_events": FX_JOB_EVENTS_SQL,
}


def with_fixtures(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the fixture views it reads, as CTEs."""
    ctes = [f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in names]
    for n, body in (extra or {}).items():
        ctes.append(f"{n} AS ({body.strip()})")
    if not ctes:
        return sql.strip()
    return "WITH " + ",\n".join(ctes) + "\nSELECT * FROM (\n" + sql.strip() + "\n) q"


def fx_file_bytes(spark: SparkSession, data_dir: str) -> DataFrame:
    """Stand-in file contents: doc_id, path, content (the document text as UTF-8 bytes)."""
    d = _docs(spark, data_dir, "doc_id", "source", "text")
    return d.select(
        "doc_id",
        fx_path().alias("path"),
        F.encode("text", "UTF-8").alias("content"))
