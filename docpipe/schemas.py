"""Fixed, all-nullable schemas of the tables the operators exchange.

Sources are read with these schemas, never with inference.
"""

from __future__ import annotations

from pyspark.sql import types as T

JOB_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("event_ts", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("current_stage", T.StringType()),
    T.StructField("input_file", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("page_ranges", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("end_time", T.TimestampNTZType()),
    T.StructField("request_ts", T.TimestampNTZType()),
    T.StructField("prompt_type", T.StringType()),
    T.StructField("processing_time", T.DoubleType()),
    T.StructField("model", T.StringType()),
    T.StructField("markdown_length", T.LongType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("parent_job_id", T.StringType()),
    T.StructField("is_chunk", T.BooleanType()),
])

PAGES_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("images", T.LongType()),
])

CHUNK_RESULTS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("parent_job_id", T.StringType()),
    T.StructField("chunk_number", T.IntegerType()),
    T.StructField("total_chunks", T.IntegerType()),
    T.StructField("pages", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("processing_time", T.DoubleType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("approach", T.StringType()),
])

RESPONSES_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("content", T.StringType()),
])

PAGE_DETAIL = T.StructType([
    T.StructField("page", T.IntegerType()),
    T.StructField("images", T.IntegerType()),
    T.StructField("text_length", T.IntegerType()),
    T.StructField("exceeds_64kb", T.BooleanType()),
])
