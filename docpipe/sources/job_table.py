"""The job ledger as base and delta.

Appended events stay as they are; beside them stands the state of every job up to some
append, in buckets by job id. Reading merges that state with the events appended since, so
its cost follows the events since the last compaction, not the ledger's age. A compaction
rewrites only the buckets in which events have come, as a new generation of them.

    events/seq=<n>/                 the n-th append
    state/gen=<n>/bucket=<b>/       state of bucket b after append n
    commits/                        one row per compaction: gen, and the buckets it wrote

A generation counts once its commit row is there, so a compaction that dies half-way leaves
nothing that is read; its next run starts anew. Appends name their number, so a retried one
replaces itself. One writer compacts at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.constants import WAITING_STAGE
from docpipe.operators.jobs import STATE_FIELDS
from docpipe.schemas import JOB_EVENT_SCHEMA

BUCKETS = 256

#: A job's state so far, in a form that merges: newest by ``last``, others by least, greatest and sum.
PARTIAL_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("last", T.StructType([T.StructField("event_ts", T.TimestampNTZType()), T.StructField("event_id", T.LongType())])),
    T.StructField("fields", T.StructType([JOB_EVENT_SCHEMA[f] for f in STATE_FIELDS])),
    T.StructField("recorded_start", T.TimestampNTZType()),
    T.StructField("first_event", T.TimestampNTZType()),
    T.StructField("recorded_request", T.TimestampNTZType()),
    T.StructField("waiting", T.TimestampNTZType()),
    T.StructField("n_events", T.LongType()),
])
STATE_SCHEMA = T.StructType([*PARTIAL_SCHEMA.fields, T.StructField("gen", T.LongType()), T.StructField("bucket", T.IntegerType())])
SEQUENCED_SCHEMA = T.StructType([*JOB_EVENT_SCHEMA.fields, T.StructField("seq", T.LongType())])
COMMIT_SCHEMA = "gen long, buckets array<int>, n_buckets int"


def bucket_of(job_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(job_id), F.lit(buckets)).cast("int")


def append(events: DataFrame, path: str, seq: int) -> None:
    """Write ``events`` as append number ``seq`` (a stream's batch id, a run's number).

    Numbers rise from append to append; one at or below the last compaction would never be read.
    """
    events.select(*JOB_EVENT_SCHEMA.names).write.mode("overwrite").parquet(f"{path}/events/seq={seq}")


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    """The commits, or None before the first compaction."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    there = files.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(files)
    return spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/commits") if there else None


def _generations(spark: SparkSession, path: str) -> tuple[int, int, dict[int, list[int]]]:
    """Last compacted append (-1: none), number of buckets (0: none) and the buckets whose newest state each generation holds.

    At most one row per bucket reaches the driver.
    """
    commits = _commits(spark, path)
    if commits is None:
        return -1, 0, {}
    last = commits.agg(F.max("gen").alias("gen"), F.max("n_buckets").alias("n")).first()
    newest = commits.select("gen", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max("gen").alias("gen"))
    found: dict[int, list[int]] = {}
    for row in newest.collect():
        found.setdefault(row["gen"], []).append(row["bucket"])
    return last["gen"], last["n"], found


def _state(spark: SparkSession, path: str, generations: dict[int, list[int]], only: list[int] | None) -> DataFrame | None:
    """Partial states of the buckets (None: there are none); other generations and buckets are pruned by partition."""
    chosen = {g: sorted(b for b in own if only is None or b in only) for g, own in generations.items()}
    chosen = {g: own for g, own in chosen.items() if own}
    if not chosen:
        return None
    wanted = None
    for gen, own in sorted(chosen.items()):
        one = (F.col("gen") == gen) & F.col("bucket").isin(own)
        wanted = one if wanted is None else wanted | one
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path}/state").where(wanted).select(*PARTIAL_SCHEMA.names)


def _delta(spark: SparkSession, path: str, after: int, upto: int | None = None) -> DataFrame:
    """The events of the appends after ``after`` (and up to ``upto``); earlier ones are pruned by partition."""
    events = spark.read.schema(SEQUENCED_SCHEMA).parquet(f"{path}/events").where(F.col("seq") > after)
    return events if upto is None else events.where(F.col("seq") <= upto)


def _partials(events: DataFrame) -> DataFrame:
    waiting = F.when(F.col("current_stage") == WAITING_STAGE, F.col("event_ts"))
    return events.select(
        "job_id", F.struct("event_ts", "event_id").alias("last"), F.struct(*STATE_FIELDS).alias("fields"),
        F.col("start_time").alias("recorded_start"), F.col("event_ts").alias("first_event"),
        F.col("request_ts").alias("recorded_request"), waiting.alias("waiting"), F.lit(1).cast("long").alias("n_events"))


def _merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("job_id").agg(
        F.max("last").alias("last"), F.max_by("fields", "last").alias("fields"), F.min("recorded_start").alias("recorded_start"),
        F.min("first_event").alias("first_event"), F.max("recorded_request").alias("recorded_request"),
        F.max("waiting").alias("waiting"), F.sum("n_events").alias("n_events"))


def compact(spark: SparkSession, path: str, buckets: int = BUCKETS) -> int:
    """Merge the events appended since the last compaction into the state; returns the last append merged.

    ``buckets`` counts at the first compaction only. The number of appends and of buckets
    that have events reach the driver, no job does.
    """
    after, known, generations = _generations(spark, path)
    buckets = known or buckets
    upto = _delta(spark, path, after).agg(F.max("seq")).first()[0]
    if upto is None:
        return after
    delta = _delta(spark, path, after, upto)
    touched = sorted(r[0] for r in delta.select(bucket_of(F.col("job_id"), buckets).alias("b")).distinct().collect())
    state, partials = _state(spark, path, generations, touched), _partials(delta)
    merged = _merged(partials if state is None else state.unionByName(partials))
    out = merged.withColumn("bucket", bucket_of(F.col("job_id"), buckets))
    out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state/gen={upto}")
    commit = spark.createDataFrame([(upto, touched, buckets)], COMMIT_SCHEMA)
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return upto


def job_state(spark: SparkSession, path: str, job_ids: list[str] | None = None) -> DataFrame:
    """The newest state of every job (or of ``job_ids``): what ``latest_job_state`` gives over all events.

    Reads the newest generation of each bucket (of the named jobs' buckets) and the events
    appended since the last compaction.
    """
    after, buckets, generations = _generations(spark, path)
    only = None
    if job_ids is not None and buckets:
        named = spark.createDataFrame([(j,) for j in job_ids], "job_id string")
        only = [r[0] for r in named.select(bucket_of(F.col("job_id"), buckets)).distinct().collect()]
    state, partials = _state(spark, path, generations, only), _partials(_delta(spark, path, after))
    both = partials if state is None else state.unionByName(partials)
    if job_ids is not None:
        both = both.where(F.col("job_id").isin(job_ids))
    return _merged(both).select(
        "job_id", "fields.*", F.col("last.event_ts").alias("last_event_ts"),
        F.coalesce("recorded_start", "first_event").alias("start_time"),
        F.coalesce("recorded_request", "waiting").alias("chat_request_ts"), "n_events")
