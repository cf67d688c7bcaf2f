"""Job ledger: latest state per job, listings, status checks, hung jobs and token usage.

The ledger is an append-only event table (one row per state change) instead of one JSON
file overwritten in place. The newest state of a job is a ``max_by`` aggregate grouped by
``job_id`` — partially aggregated map-side, so a job with very many events adds no skew —
rather than a window that would hold all events of a job in one task. "Now" is always an
explicit ``as_of`` timestamp, which keeps every query deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.constants import (
    DEFAULT_STATUS_STYLE,
    HUNG_JOB_SECONDS,
    LONG_WAIT_SECONDS,
    RECENT_JOBS_LIMIT,
    SLOW_JOB_SECONDS,
    STATUS_STYLES,
    WAITING_STAGE,
)

STATE_FIELDS = ["status", "current_stage", "input_file", "error", "page_ranges", "prompt_tokens", "completion_tokens",
                "total_tokens", "end_time", "prompt_type", "processing_time", "model", "markdown_length", "error_type",
                "parent_job_id", "is_chunk"]


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds (DOUBLE) between two TIMESTAMP_NTZ values."""
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def as_of_ts(as_of: str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def latest_job_state(events: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """One row per job: the newest values of the state fields, start_time (as recorded, else
    the first event's time) and chat_request_ts (as recorded, else the time of the newest
    event that waits on the service)."""
    ev = events if as_of is None else events.where(F.col("event_ts") <= as_of_ts(as_of))
    order = F.struct("event_ts", "event_id")
    latest = F.max_by(F.struct(*STATE_FIELDS, F.col("event_ts").alias("last_event_ts")), order)
    waiting = F.when(F.col("current_stage") == WAITING_STAGE, F.col("event_ts"))
    agg = ev.groupBy("job_id").agg(
        latest.alias("s"),
        F.coalesce(F.min("start_time"), F.min("event_ts")).alias("start_time"),
        F.coalesce(F.max("request_ts"), F.max(waiting)).alias("chat_request_ts"),
        F.count("*").alias("n_events"),
    )
    return agg.select("job_id", "s.*", "start_time", "chat_request_ts", "n_events")


def status_style(status: Column) -> Column:
    out = F.lit(DEFAULT_STATUS_STYLE)
    for name, style in reversed(STATUS_STYLES):
        out = F.when(status == name, F.lit(style)).otherwise(out)
    return out


def base_name(path: Column) -> Column:
    """Last path segment (``Path.name``)."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """Last path segment without its final suffix (``Path.stem``)."""
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def recent_job_ids(events: DataFrame, limit: int = RECENT_JOBS_LIMIT) -> DataFrame:
    """The ``limit`` job ids that come first by record name (``{job_id}.json``) descending."""
    return events.select("job_id").distinct().orderBy(F.concat("job_id", F.lit(".json")).desc()).limit(limit)


def list_jobs(events: DataFrame, limit: int = RECENT_JOBS_LIMIT) -> DataFrame:
    """The most recent jobs: the top ids first, then the state of those jobs only."""
    recent = recent_job_ids(events, limit)
    state = latest_job_state(events.join(recent, "job_id", "left_semi"))
    return state.select("job_id", base_name(F.col("input_file")).alias("input_name"), "status",
                        status_style(F.col("status")).alias("status_style"),
                        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"))


def all_tokens() -> Column:
    """Total tokens as recorded, else prompt plus completion."""
    return F.coalesce("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def job_status(state: DataFrame, as_of: str | Column, job_ids: DataFrame | None = None) -> DataFrame:
    """Status panel per job: elapsed time, severity colour, long-wait warning.

    With ``job_ids`` (a one-column ``job_id`` table) only those jobs are shown; ids without
    a record come back with ``found = false``.
    """
    now = as_of_ts(as_of)
    elapsed = seconds_between(F.col("start_time"), now)
    started = F.col("status") == "started"
    waiting = started & (F.col("current_stage") == WAITING_STAGE) & F.col("chat_request_ts").isNotNull()
    wait = F.when(waiting, seconds_between(F.col("chat_request_ts"), now))
    out = state.select(
        "job_id", "status", "input_file", "start_time", "page_ranges",
        elapsed.alias("elapsed_seconds"),
        F.when(started, F.col("current_stage")).alias("current_stage"),
        wait.alias("api_wait_seconds"),
        F.coalesce(wait > LONG_WAIT_SECONDS, F.lit(False)).alias("long_wait"),
        # A job over 300 s is yellow; the 600 s red branch is shadowed by the 300 s test.
        F.when(started & (elapsed > SLOW_JOB_SECONDS), F.lit("yellow")).otherwise(F.lit("cyan")).alias("severity"),
        all_tokens().alias("total_tokens"),
        F.coalesce("prompt_type", F.lit("unknown")).alias("prompt_type"),
        # shown for completed jobs
        F.when(F.col("status") == "completed", F.col("processing_time")).alias("processing_time"),
        F.when(F.col("status") == "completed", F.col("markdown_length")).alias("markdown_length"),
        F.when(F.col("status") == "completed", F.col("model")).alias("model"),
        # shown for failed jobs
        F.when(F.col("status") == "failed", F.col("error")).alias("error"),
        F.when(F.col("status") == "failed", F.col("error_type")).alias("error_type"),
    )
    if job_ids is None:
        return out
    return job_ids.select("job_id").join(out.withColumn("found", F.lit(True)), "job_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))


def hung_jobs(state: DataFrame, as_of: str | Column) -> DataFrame:
    """Jobs still ``started`` more than 600 s after their start."""
    now = as_of_ts(as_of)
    elapsed = seconds_between(F.col("start_time"), now)
    return state.where((F.col("status") == "started") & (elapsed > HUNG_JOB_SECONDS)).select(
        "job_id", "start_time", elapsed.alias("elapsed_seconds"), (elapsed / 60.0).alias("elapsed_minutes"),
        F.coalesce(F.col("current_stage"), F.lit("unknown")).alias("stage"),
        F.when(F.col("chat_request_ts").isNotNull(), seconds_between(F.col("chat_request_ts"), now)).alias("api_wait_seconds"),
        "input_file")


def token_usage(state: DataFrame) -> DataFrame:
    """Token usage of the newest record of each job, summed per start day and model."""
    return state.groupBy(F.to_date("start_time").alias("day"), "model").agg(
        F.count("*").alias("n_jobs"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(all_tokens()).alias("total_tokens"))


def is_retriable(error_type: Column, error: Column) -> Column:
    """Time-outs: a timeout error type, or a message with ``504`` or ``timeout`` (any case)."""
    return F.coalesce((error_type == "APITimeoutError") | error.contains("504")
                      | F.lower(error).contains("timeout"), F.lit(False))


def retry_routing(failures: DataFrame, fallback_enabled: Column | bool = True) -> DataFrame:
    """Next step after a failed conversion call and the stage recorded if everything fails.

    Retriable and no page range -> ``chunk``; retriable with a page range and the fallback
    on -> ``ocr_fallback``; otherwise ``fail``. Non-timeout errors never use the fallback.
    """
    fb = fallback_enabled if isinstance(fallback_enabled, Column) else F.lit(bool(fallback_enabled))
    retriable = is_retriable(F.col("error_type"), F.col("error"))
    no_range = F.col("page_ranges").isNull() | (F.col("page_ranges") == "")
    route = (F.when(retriable & no_range, F.lit("chunk"))
             .when(retriable & fb, F.lit("ocr_fallback"))
             .otherwise(F.lit("fail")))
    final = F.when(F.col("error_type") == "APITimeoutError", F.lit("api_timeout")).otherwise(F.lit("api_error"))
    return failures.withColumn("retriable", retriable).withColumn("next_route", route).withColumn("final_stage", final)


USAGE_SCHEMA = T.StructType([
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
])


def parse_usage(raw_json: Column, path: str = "usage") -> Column:
    """Token usage from a raw JSON response string: STRUCT<prompt, completion, total>.

    Missing objects or keys come back NULL (the optional-attribute chains of a client
    response), malformed JSON too; parsing uses a fixed schema, never inference.
    """
    return F.from_json(F.get_json_object(raw_json, f"$.{path}"), USAGE_SCHEMA)
