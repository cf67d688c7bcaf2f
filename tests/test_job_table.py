"""The ledger as base and delta, against the full recompute."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from docpipe.operators.jobs import latest_job_state
from docpipe.sources import fixtures as FX
from docpipe.sources import job_table as J


def rows(df):
    return sorted(df.select(sorted(df.columns)).collect(), key=lambda r: (r["job_id"] is not None, r["job_id"]))


def spoil(folder):
    """Make every Parquet file below a folder unreadable: a plan that opens one fails."""
    files = glob.glob(f"{folder}/**/*.parquet", recursive=True)
    assert files
    for f in files:
        open(f, "wb").write(b"spoiled")


def buckets_of(path, gen):
    return {int(f.rsplit("=", 1)[1]) for f in glob.glob(f"{path}/state/gen={gen}/bucket=*")}


@pytest.fixture(scope="module")
def events(spark):
    return FX.fx_job_events(spark, SF_SMALL).cache()


def test_equal_to_the_full_recompute_after_random_appends(spark, events, tmp_path):
    rng, path, seen = random.Random(5), str(tmp_path), None
    dealt = events.withColumn("append", F.pmod(F.xxhash64("event_id"), F.lit(6))).cache()
    for seq in range(6):                                # events of a job come in any order
        part = dealt.where(F.col("append") == seq).drop("append")
        J.append(part, path, seq)
        if rng.random() < 0.3:
            J.append(part, path, seq)                   # a retried append
        seen = part if seen is None else seen.union(part)
        if seq in (1, 2, 4):
            assert J.compact(spark, path, buckets=8) == seq
        assert rows(J.job_state(spark, path)) == rows(latest_job_state(seen))
    assert J.compact(spark, path) == 5 == J.compact(spark, path)
    assert rows(J.job_state(spark, path)) == rows(latest_job_state(events))


def test_only_delta_and_touched_buckets_are_read_and_written(spark, events, tmp_path):
    path = str(tmp_path)
    J.append(events, path, 1)
    J.compact(spark, path, buckets=16)
    jobs = [r[0] for r in events.select("job_id").distinct().orderBy("job_id").limit(2).collect()]
    news = events.where(F.col("job_id") == jobs[0]).withColumn("event_id", F.col("event_id") + 10 ** 9).withColumn(
        "status", F.lit("failed")).withColumn("event_ts", F.expr("event_ts + INTERVAL 1 DAY"))
    J.append(news, path, 2)
    want = rows(latest_job_state(events.union(news)))
    spoil(f"{path}/events/seq=1")                                        # compacted events are not read again
    assert rows(J.job_state(spark, path)) == want
    (touched,) = [r[0] for r in news.select(J.bucket_of(F.col("job_id"), 16)).distinct().collect()]
    kept = buckets_of(path, 1) - {touched}
    saved = {f: open(f, "rb").read() for b in kept for f in glob.glob(f"{path}/state/gen=1/bucket={b}/*.parquet")}
    for b in kept:
        spoil(f"{path}/state/gen=1/bucket={b}")                          # nor does a compaction read untouched buckets
    assert J.compact(spark, path) == 2 and buckets_of(path, 2) == {touched}
    for f, data in saved.items():
        open(f, "wb").write(data)
    spoil(f"{path}/events/seq=2")
    spoil(f"{path}/state/gen=1/bucket={touched}")                        # superseded
    assert rows(J.job_state(spark, path)) == want
    named = [r["job_id"] for r in want if r["job_id"] == jobs[0]] + ["nobody"]
    others = {r[0] for r in spark.createDataFrame([(j,) for j in named], "j string").select(J.bucket_of(F.col("j"), 16)).collect()}
    for b in kept - others:
        spoil(f"{path}/state/gen=1/bucket={b}")                          # a look-up reads the named jobs' buckets
    one = J.job_state(spark, path, named)
    assert rows(one) == [r for r in want if r["job_id"] == jobs[0]] and one.first()["status"] == "failed"


def test_a_compaction_that_died_leaves_nothing_that_is_read(spark, events, tmp_path):
    path = str(tmp_path)
    J.append(events, path, 1)
    J.compact(spark, path, buckets=4)
    J.append(events.limit(50).withColumn("status", F.lit("odd")).withColumn("event_id", F.col("event_id") + 10 ** 9), path, 2)
    before = rows(J.job_state(spark, path))
    spark.read.parquet(f"{path}/state/gen=1").write.partitionBy("bucket").parquet(f"{path}/state/gen=2")   # no commit row
    assert rows(J.job_state(spark, path)) == before
    assert J.compact(spark, path) == 2
    assert rows(J.job_state(spark, path)) == before


def test_null_job_ids_and_an_empty_append(spark, events, tmp_path):
    path = str(tmp_path)
    odd = events.limit(3).withColumn("job_id", F.lit(None).cast("string"))
    J.append(odd, path, 1)
    J.compact(spark, path, buckets=4)
    J.append(events.limit(0), path, 2)
    assert J.compact(spark, path) == 1
    assert rows(J.job_state(spark, path)) == rows(latest_job_state(odd))
