"""Streaming views of the job ledger.

Job events arrive as files (JSON or Parquet) in a folder. Two standing queries replace
the hand-polled ``--check-job`` / ``--check-hung`` loops:

- ``live_job_state``: newest state per job, emitted whenever it changes (a built-in aggregate).
- ``hung_job_alerts``: at most one alert per job, when the event-time watermark passes its
  start + 600 s and its newest status is still ``started`` (named state and event-time timers,
  kept by buckets of jobs).

Both keep state per job and drop it a retention time after the job's last event, so state
follows the number of recently active jobs. Until then a finished or alerted job leaves a
tombstone: events that arrive late or out of order change neither its start nor its alert.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docpipe.constants import HUNG_JOB_SECONDS
from docpipe.schemas import JOB_EVENT_SCHEMA

def read_job_events(spark: SparkSession, path: str, fmt: str = "parquet",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source over a folder of ledger files, with the fixed ledger schema."""
    reader = spark.readStream.schema(JOB_EVENT_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def with_event_time(events: DataFrame) -> DataFrame:
    """Adds ``event_time`` (TIMESTAMP): the ledger's wall-clock ``event_ts`` read as UTC.

    Watermarks need an instant; deriving it from epoch microseconds keeps it independent
    of the session time zone.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return events.withColumn("event_time", F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("event_ts"))))


ALERT_SCHEMA = ("job_id string, start_time timestamp_ntz, stage string, input_file string, "
                "deadline timestamp_ntz")


#: Buckets that jobs are dealt to by a hash of their id; fixed for the life of a checkpoint.
JOB_BUCKETS = 1024
#: A start that is not known (later than any) and the time of an event without one (earlier than any).
NO_START, NO_TIME = 2 ** 63 - 1, -2 ** 63
JOB_STATE = {"job_id": "string", "recorded_us": "long", "first_us": "long", "ts_us": "long", "event_id": "long", "status": "string",
             "stage": "string", "input_file": "string", "alerted": "boolean"}


def _by_job(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per job: its newest event (of equals the last row), its earliest starts, whether it was alerted or has come now."""
    rows = rows.sort_values(["ts_us", "event_id"], kind="stable", ignore_index=True)
    job = rows.groupby("job_id", dropna=False, sort=False).ngroup()
    of = rows.groupby(job)
    for column, least in (("recorded_us", "min"), ("first_us", "min"), ("alerted", "max"), ("come", "max")):
        rows[column] = of[column].transform(least)
    return rows[~job.duplicated(keep="last")]


class HungJobs(StatefulProcessor):
    """State of a bucket of jobs, column by column: of each job its start, its newest event and whether it was alerted.

    One event-time timer stands per bucket, at the first of its jobs' times: a job's deadline
    while it runs, else when it may be forgotten. The state's cost is a few calls per bucket
    that has events or a timer, however many jobs it holds.
    """

    def __init__(self, limit_us: int, retention_ms: int):
        self.limit_us, self.retention_ms = limit_us, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", ", ".join(f"{c} array<{kind}>" for c, kind in JOB_STATE.items()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        jobs = self.known()
        for pdf in rows:
            come = pdf[[c for c in JOB_STATE if c in pdf.columns]].assign(
                first_us=pdf["ts_us"].where(pdf["ts_us"] != NO_TIME, NO_START), alerted=False, come=True)
            jobs = _by_job(come if jobs is None else pd.concat([come, jobs], ignore_index=True))
        yield from self.settled(jobs, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settled(self.known(), timerValues.getCurrentWatermarkInMs())

    def known(self) -> pd.DataFrame | None:
        """The bucket's jobs, none of which has come in this batch yet."""
        state = self.jobs.get()
        return None if state is None else pd.DataFrame(dict(zip(JOB_STATE, state))).assign(come=False)

    def settled(self, jobs: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        """The alerts that are due; the jobs that stay and the bucket's next timer."""
        start = jobs["recorded_us"].where(jobs["recorded_us"] != NO_START, jobs["first_us"])
        waits = (jobs["status"] == "started") & ~jobs["alerted"] & (start != NO_START)
        start = start.where(waits, 0)
        deadline = (start + self.limit_us) // 1000
        due = waits & (deadline < watermark)
        if due.any():
            told = jobs[due]
            yield pd.DataFrame({
                "job_id": told["job_id"], "start_time": start[due].to_numpy().astype("datetime64[us]"),
                "stage": told["stage"].where(told["stage"].notna(), "unknown"), "input_file": told["input_file"],
                "deadline": (start[due] + self.limit_us).to_numpy().astype("datetime64[us]")})
        waits &= ~due
        wake = (deadline + 1).where(waits, jobs["ts_us"] // 1000 + self.retention_ms)
        # what has come now, or was alerted now, is forgotten when the watermark moves on at the earliest
        stays = waits | due | jobs["come"] | (wake > watermark)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if stays.any():
            jobs = jobs.assign(alerted=jobs["alerted"] | due)[stays]
            self.jobs.update(tuple(jobs[c].astype(object).where(jobs[c].notna(), None).tolist() for c in JOB_STATE))
            self.handle.registerTimer(max(int(wake[stays].min()), watermark + 1))
        else:
            self.jobs.clear()

    def close(self) -> None:
        pass


def hung_job_alerts(events: DataFrame, watermark: str = "10 minutes", retention_seconds: int = 86400) -> DataFrame:
    """Alerts for jobs still running 600 s after they started (output mode ``append``).

    A job gets at most one alert, and none if any event so far says it has ended, in whatever
    order events arrive. ``retention_seconds`` after its last event a job that has ended or
    was alerted is forgotten; an event that comes later still begins a new job. Retention is
    in event time, by timers: Spark's state TTL counts processing time only. Needs the RocksDB
    state store (``build_session`` sets it).

    Jobs are kept in ``JOB_BUCKETS`` buckets of state, so that Python is called per bucket and
    not per job; only the columns that alerts need go there. A stream begins with a new
    checkpoint if the number of buckets changes.
    """
    def micros(column: str, missing: int) -> Column:
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.coalesce(F.timestamp_diff("MICROSECOND", epoch, F.col(column)), F.lit(missing))

    rows = with_event_time(events).withWatermark("event_time", watermark).select(
        F.pmod(F.xxhash64("job_id"), F.lit(JOB_BUCKETS)).alias("bucket"), "job_id", micros("start_time", NO_START).alias("recorded_us"),
        micros("event_ts", NO_TIME).alias("ts_us"), F.coalesce("event_id", F.lit(NO_TIME)).alias("event_id"), "status",
        F.col("current_stage").alias("stage"), "input_file", "event_time")
    return rows.groupBy("bucket").transformWithStateInPandas(
        HungJobs(HUNG_JOB_SECONDS * 1_000_000, retention_seconds * 1000), ALERT_SCHEMA, "append", "EventTime")


LIVE_FIELDS = ["status", "current_stage", "input_file", "error", "page_ranges", "prompt_tokens", "completion_tokens"]
LIVE_SCHEMA = (", ".join(["job_id string", *(f"{f} {'long' if f.endswith('tokens') else 'string'}" for f in LIVE_FIELDS)])
               + ", last_event_ts timestamp_ntz, start_time timestamp_ntz")


def live_job_state(events: DataFrame, retention_seconds: int = 86400, watermark: str = "10 minutes") -> DataFrame:
    """Newest state per job, emitted whenever it changes (output mode ``update``).

    A built-in aggregate, so that no event leaves the JVM. Aggregate state is dropped by
    window: every event counts in two overlapping windows of twice the retention, and a job is
    told by the one in whose second half its newest event lies, which holds all its events of
    the ``retention_seconds`` before. A window goes when the watermark passes its end, at the
    latest twice the retention after a job's last event; an event that comes later still
    begins a new job. Where events of one batch lie on both sides of a border, or one comes
    that late behind newer ones, an older state is told too: a sink keeps the row of the
    greatest ``last_event_ts``.
    """
    span = F.window("event_time", f"{2 * retention_seconds} seconds", f"{retention_seconds} seconds")
    newest = F.max_by(F.struct(*LIVE_FIELDS, "event_ts", "event_time"), F.struct("event_ts", "event_id"))
    state = (with_event_time(events).withWatermark("event_time", watermark).groupBy("job_id", span.alias("span"))
             .agg(newest.alias("s"), F.min("start_time").alias("recorded"), F.min("event_ts").alias("first")))
    half = F.col("span.start") + F.make_dt_interval(secs=F.lit(retention_seconds))
    return state.where(F.col("s.event_time") >= half).select(
        "job_id", *[F.col(f"s.{f}").alias(f) for f in LIVE_FIELDS], F.col("s.event_ts").alias("last_event_ts"),
        F.coalesce("recorded", "first").alias("start_time"))
