"""Job ledger storage: append-only events, read with a fixed schema.

The original keeps one JSON file per job and rewrites it at every stage. Here each stage
change is one appended row; the current state of a job is ``latest_job_state`` over the
events. Existing JSON job records (one object per file, possibly pretty-printed) can be
ingested as events with ``read_job_records``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.constants import JOB_RECORD_API_KEY
from docpipe.schemas import JOB_EVENT_SCHEMA

# Fields of a job record file; the service's answer details are nested under one key.
JOB_RECORD_SCHEMA = T.StructType([
    *[T.StructField(name, T.StringType()) for name in
      ("id", "input_file", "status", "start_time", "end_time", "page_ranges", "current_stage", "formatting_prompt_type",
       "model", "error", "error_type")],
    T.StructField("processing_time", T.DoubleType()),
    T.StructField("markdown_length", T.LongType()),
    T.StructField("is_chunk", T.BooleanType()),
    T.StructField("chunk_info", T.StructType([T.StructField("parent_job_id", T.StringType())])),
    T.StructField(JOB_RECORD_API_KEY, T.StructType([
        T.StructField("chat_request_timestamp", T.StringType()),
        T.StructField("usage", T.StructType([
            T.StructField("prompt_tokens", T.LongType()),
            T.StructField("completion_tokens", T.LongType()),
            T.StructField("total_tokens", T.LongType()),
        ])),
    ])),
])


def read_job_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(JOB_EVENT_SCHEMA).format(fmt).load(path)


def append_job_events(events: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append events; each write is one atomic commit of new files."""
    events.select(*[f.name for f in JOB_EVENT_SCHEMA.fields]).write.mode("append").format(fmt).save(path)


def read_job_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON job records (``{job_id}.json`` files) as ledger events, one per record.

    The event time is the latest time the record names (ISO strings parsed as
    TIMESTAMP_NTZ); its start, end and request times are columns of their own, so a finished
    job keeps its start. Optional keys missing from a record come back NULL.
    """
    rec = spark.read.schema(JOB_RECORD_SCHEMA).option("multiLine", "true").json(path)
    api = JOB_RECORD_API_KEY
    start, end = F.to_timestamp_ntz("start_time"), F.to_timestamp_ntz("end_time")
    asked = F.to_timestamp_ntz(f"{api}.chat_request_timestamp")
    ts = F.coalesce(end, F.greatest(start, asked))
    event = rec.select(
        F.xxhash64("id", ts).alias("event_id"), F.col("id").alias("job_id"), ts.alias("event_ts"),
        "status", "current_stage", "input_file", "error", "page_ranges",
        F.col(f"{api}.usage.prompt_tokens").alias("prompt_tokens"),
        F.col(f"{api}.usage.completion_tokens").alias("completion_tokens"),
        F.col(f"{api}.usage.total_tokens").alias("total_tokens"),
        start.alias("start_time"), end.alias("end_time"), asked.alias("request_ts"),
        F.col("formatting_prompt_type").alias("prompt_type"), "processing_time", "model", "markdown_length", "error_type",
        F.col("chunk_info.parent_job_id").alias("parent_job_id"), "is_chunk")
    return event.select(*[f.name for f in JOB_EVENT_SCHEMA.fields])
