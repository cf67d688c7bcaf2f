"""Streaming jobs over split fixture files, compared with the batch operators."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from docpipe.operators import jobs as JB
from docpipe.sources import fixtures as FX
from docpipe.streaming import ledger as L
from docpipe.streaming import responses as R


def scratch():
    return tempfile.mkdtemp(prefix="docpipe-stream-")


def test_hung_job_alerts_match_batch(spark):
    src = scratch()
    events = FX.fx_job_events(spark, SF_SMALL)
    events.coalesce(1).write.mode("overwrite").parquet(src)
    q = (L.hung_job_alerts(L.read_job_events(spark, src), watermark="0 seconds").writeStream
         .format("memory").queryName("hung_alerts").outputMode("append")
         .option("checkpointLocation", scratch()).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(r.job_id for r in spark.table("hung_alerts").collect())
    # The stream's final watermark is the largest event time; its timers fire at that point.
    last = events.agg(F.max("event_ts")).first()[0]
    want = sorted(r.job_id for r in JB.hung_jobs(JB.latest_job_state(events), F.lit(last)).collect())
    assert got == want and len(got) > 0


def test_streaming_cleaner_matches_batch(spark):
    src = scratch()
    responses = FX.fx_responses(spark, SF_SMALL)
    responses.repartition(3).write.mode("overwrite").parquet(src)
    sink = scratch() + "/out"
    R.start_cleaning(spark, src, sink, scratch(), available_now=True).awaitTermination()
    got = spark.read.parquet(sink)
    want = R.cleaned_responses(responses)
    assert sorted(got.collect()) == sorted(want.collect())


def test_cleaned_stream_writes_the_table_split_by_split(spark, tmp_path):
    """No fixed number of tasks takes the whole table: each answer file holds one split of it."""
    import glob
    from docpipe.plans import stored
    from docpipe.session import checkpoint_dir
    rows = [(k, f"---\nline {k}\n" * 3, "en", "s", 10) for k in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(12).write.parquet(
        f"{tmp_path}/documents.parquet")
    before = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/stored-cleaning-*"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = stored.q_cleaned_stream(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == sorted(R.cleaned_responses(FX.fx_responses(spark, str(tmp_path))).collect())
    folder, = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/stored-cleaning-*")) - before
    assert len(glob.glob(f"{folder}/in/part-*.parquet")) >= 12


def test_live_state_matches_batch(spark):
    src = scratch()
    events = FX.fx_job_events(spark, SF_SMALL)
    # Files arrive in event-time order (one time slice per write): a stateful stream drops
    # events older than its watermark, as it should.
    for lo, hi in [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-01")]:
        events.where(F.col("event_ts").between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"))
                     & (F.col("event_ts") < F.lit(hi).cast("timestamp_ntz"))) \
            .coalesce(1).write.mode("append").parquet(src)
    q = (L.live_job_state(L.read_job_events(spark, src, max_files_per_trigger=1), retention_seconds=10 ** 7)
         .writeStream.format("memory").queryName("live_bounded").outputMode("update")
         .option("checkpointLocation", scratch()).trigger(availableNow=True).start())
    q.awaitTermination()
    emitted = spark.table("live_bounded")
    newest = emitted.groupBy("job_id").agg(F.max_by(F.struct("status", "current_stage", "last_event_ts", "start_time",
                                                              "prompt_tokens"), "last_event_ts").alias("s")).select("job_id", "s.*")
    want = JB.latest_job_state(events).select("job_id", "status", "current_stage", "last_event_ts", "start_time",
                                              "prompt_tokens")
    assert sorted(newest.collect()) == sorted(want.collect())


def test_live_state_is_a_built_in_aggregate_that_forgets(spark):
    """No Python in the plan; jobs across window borders keep their start; old windows are dropped."""
    import datetime as dt
    from docpipe.schemas import JOB_EVENT_SCHEMA
    src, sink, t0 = scratch(), scratch() + "/out", dt.datetime(2024, 1, 1)
    #   seconds, job, status: a spans a border of 100 s; b speaks again long after its windows are gone
    batches = [[(95, "a", "started"), (5, "b", "started")], [(105, "a", "completed"), (106, "a", "failed")], [(1000, "c", "started")],
               [(1001, "c", "started")], [(1500, "b", "completed"), (1499, "b", "started")]]
    n = 0
    for rows in batches:
        out = []
        for seconds, job, status in rows:
            n += 1
            event = dict.fromkeys(f.name for f in JOB_EVENT_SCHEMA.fields)
            out.append(tuple((event | {"event_id": n, "job_id": job, "event_ts": t0 + dt.timedelta(seconds=seconds), "status": status}).values()))
        spark.createDataFrame(out, JOB_EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    live = L.live_job_state(L.read_job_events(spark, src, max_files_per_trigger=1), retention_seconds=100, watermark="0 seconds")
    plan = live._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan
    q = (live.writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{sink}/batch={k}")).outputMode("update")
         .option("checkpointLocation", scratch()).trigger(availableNow=True).start())
    q.awaitTermination()
    told = [(r.job_id, r.status, (r.start_time - t0).seconds, (r.last_event_ts - t0).seconds) for r in spark.read.parquet(sink).orderBy("batch").collect()]
    assert sorted(told) == [("a", "failed", 95, 106), ("a", "started", 95, 95), ("b", "completed", 1499, 1500), ("b", "started", 5, 5),
                            ("b", "started", 1499, 1499), ("c", "started", 1000, 1000), ("c", "started", 1000, 1001)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_chunk_collection_then_batch_stitch(spark):
    from docpipe.operators.chunks import stitch_chunks
    src = scratch()
    rows = [(1, "j", 1, 2, "1-2", "a\nb", 1.0, "j_chunk_01_of_02", True), (1, "j", 2, 2, "3", "c", 1.5, "j_chunk_02_of_02", True),
            (2, "j", 1, 2, "1", "x", 0.5, "j_chunk_01_of_02", True)]
    schema = "doc_id long, parent_job_id string, chunk_number int, total_chunks int, pages string, content string, " \
             "processing_time double, job_id string, success boolean"
    for r in rows:                                   # chunks arrive one file at a time
        spark.createDataFrame([r], schema).write.mode("append").parquet(src)
    table = scratch() + "/chunks"
    R.start_chunk_collection(spark, src, table, scratch(), available_now=True).awaitTermination()
    collected = spark.read.parquet(table)
    done = R.complete_parents(collected)
    assert [r.doc_id for r in done.collect()] == [1]
    stitched = stitch_chunks(collected.join(done, "doc_id", "left_semi")).collect()
    assert [(r.doc_id, r.markdown) for r in stitched] == [(1, "a\nb\n\nc")]


def test_hung_job_alerts_over_many_batches(spark):
    src = scratch()
    events = FX.fx_job_events(spark, SF_SMALL)
    # one file per ~3 days, in event-time order: timers fire across micro-batches
    days = [f"2024-01-{d:02d}" for d in range(1, 32, 3)] + ["2024-02-01"]
    for lo, hi in zip(days, days[1:]):
        events.where((F.col("event_ts") >= F.lit(lo).cast("timestamp_ntz"))
                     & (F.col("event_ts") < F.lit(hi).cast("timestamp_ntz"))).coalesce(1).write.mode("append").parquet(src)
    q = (L.hung_job_alerts(L.read_job_events(spark, src, max_files_per_trigger=1), watermark="0 seconds").writeStream
         .format("memory").queryName("hung_many").outputMode("append")
         .option("checkpointLocation", scratch()).trigger(availableNow=True).start())
    q.awaitTermination()
    alerts = spark.table("hung_many")
    assert alerts.count() == alerts.select("job_id").distinct().count() > 0      # at most one alert per job
    # Each job's events lie in one file, so the alerts equal the batch view at the last event.
    last = events.agg(F.max("event_ts")).first()[0]
    want = sorted(r.job_id for r in JB.hung_jobs(JB.latest_job_state(events), F.lit(last)).collect())
    assert sorted(r.job_id for r in alerts.collect()) == want


def alerts_of(spark, name, batches, **options):
    """Alerts of a stream whose micro-batches are the given (seconds, job, status) lists."""
    import datetime as dt
    from docpipe.schemas import JOB_EVENT_SCHEMA
    src, t0, n = scratch(), dt.datetime(2024, 1, 1), 0
    for rows in batches:
        events = []
        for seconds, job, status in rows:
            n += 1
            event = dict.fromkeys(f.name for f in JOB_EVENT_SCHEMA.fields)
            event |= {"event_id": n, "job_id": job, "event_ts": t0 + dt.timedelta(seconds=seconds), "status": status,
                      "input_file": f"/x/{job}.pdf"}
            events.append(tuple(event.values()))
        spark.createDataFrame(events, JOB_EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    q = (L.hung_job_alerts(L.read_job_events(spark, src, max_files_per_trigger=1), **options).writeStream
         .format("memory").queryName(name).outputMode("append").option("checkpointLocation", scratch())
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return [(r.job_id, (r.start_time - t0).total_seconds()) for r in spark.table(name).collect()]


def test_end_seen_before_start_raises_no_alert(spark):
    """The end of a job arrives one batch before its start: no alert, however far time goes on."""
    got = alerts_of(spark, "late_start", [[(700, "a", "completed"), (0, "z", "started")], [(10, "a", "started")],
                                          [(2000, "clock", "completed")], [(4000, "clock", "completed")]], watermark="1000 seconds")
    assert got == [("z", 0.0)]


def test_alerted_job_that_speaks_again_is_not_alerted_again(spark):
    got = alerts_of(spark, "speaks_again", [[(0, "a", "started")], [(1000, "clock", "completed")], [(1100, "a", "started")],
                                            [(3000, "clock", "completed")], [(3100, "a", "started")], [(6000, "clock", "completed")]],
                    watermark="0 seconds")
    assert got == [("a", 0.0)]


def test_state_is_forgotten_after_the_retention(spark):
    got = alerts_of(spark, "forgotten", [[(0, "a", "started")], [(1000, "clock", "completed")], [(9000, "clock", "completed")],
                                         [(9001, "clock", "completed")], [(9100, "a", "started")], [(12000, "clock", "completed")]],
                    watermark="0 seconds", retention_seconds=2000)
    assert got == [("a", 0.0), ("a", 9100.0)]


def test_alerts_go_on_after_a_restart(spark):
    """A query stopped and started from its checkpoint keeps its timers and does not alert twice."""
    import datetime as dt
    from docpipe.schemas import JOB_EVENT_SCHEMA
    src, checkpoint, sink, t0 = scratch(), scratch(), scratch() + "/out", dt.datetime(2024, 1, 1)

    def land(n, seconds, job, status):
        event = dict.fromkeys(f.name for f in JOB_EVENT_SCHEMA.fields)
        event |= {"event_id": n, "job_id": job, "event_ts": t0 + dt.timedelta(seconds=seconds), "status": status}
        spark.createDataFrame([tuple(event.values())], JOB_EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def run():
        (L.hung_job_alerts(L.read_job_events(spark, src, max_files_per_trigger=1), watermark="0 seconds").writeStream
         .format("parquet").option("path", sink).outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start()).awaitTermination()
        return sorted(r.job_id for r in spark.read.parquet(sink).collect())

    land(1, 0, "a", "started")
    land(2, 100, "b", "started")
    assert run() == []
    land(3, 650, "b", "completed")                    # passes a's deadline, ends b before its own
    assert run() == ["a"]
    land(4, 660, "a", "started")
    land(5, 5000, "clock", "completed")
    assert run() == ["a"]


def test_state_of_jobs_is_kept_by_buckets(spark, monkeypatch):
    """Python and the state store are called per bucket of jobs, not per job; nulls are a job like others."""
    import datetime as dt
    from docpipe.schemas import JOB_EVENT_SCHEMA
    monkeypatch.setattr(L, "JOB_BUCKETS", 4, raising=False)
    src, t0, told = scratch(), dt.datetime(2024, 1, 1), []
    blank = dict.fromkeys(f.name for f in JOB_EVENT_SCHEMA.fields)

    def land(*events):
        spark.createDataFrame([tuple((blank | {"event_id": n, "job_id": job, "event_ts": t0 + dt.timedelta(seconds=s), "status": status}).values())
                               for n, s, job, status in events], JOB_EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)

    land(*[(k, k, f"j{k}", "started") for k in range(200)], (500, 7, None, "started"))
    land(*[(1000 + k, 300, f"j{k}", "completed") for k in range(0, 200, 2)])
    land((2000, 700, "clock", "completed"))
    land((3000, 5000, "clock", "completed"))
    q = (L.hung_job_alerts(L.read_job_events(spark, src, max_files_per_trigger=1), watermark="0 seconds").writeStream
         .foreachBatch(lambda df, k: told.extend((r.job_id, (r.start_time - t0).seconds, r.stage) for r in df.collect()))
         .option("checkpointLocation", scratch()).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(told, key=str) == sorted([(f"j{k}", k, "unknown") for k in range(1, 200, 2)] + [(None, 7, "unknown")], key=str)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * 3          # a value and a timer with its index


CHUNKS = ("doc_id long, parent_job_id string, chunk_number int, total_chunks int, pages string, content string, "
          "processing_time double, job_id string, success boolean, approach string")


def test_parents_are_told_once_when_their_last_chunk_arrives(spark):
    src, sink, checkpoint = scratch(), scratch() + "/done", scratch()

    def land(*rows):
        full = [(d, "j", n, total, "", "x", 1.0, "c", n != 2, approach) for d, approach, n, total in rows]
        spark.createDataFrame(full, CHUNKS).coalesce(1).write.mode("append").parquet(src)

    def run(**options):
        R.start_parent_completion(spark, src, sink, checkpoint, available_now=True, **options).awaitTermination()
        return sorted((r.doc_id, r.approach or "", r.total_chunks) for r in spark.read.parquet(sink).collect())

    land((1, None, 2, 3), (1, None, 2, 3), (2, "a", 1, 1), (3, None, 1, 2), (None, None, 1, 1), (5, None, None, 2))
    assert run() == [(2, "a", 1)]
    land((1, "a", 1, 3), (1, "a", 3, 3), (1, None, 3, 3), (3, None, 7, 2))       # variants do not mix; chunk 7 of 2 is none
    assert run() == [(2, "a", 1)]
    land((1, None, 1, 3), (2, "a", 1, 1))                                        # the last one, late; a repeated one
    want = [(1, "", 3), (2, "a", 1)]
    assert run() == want
    land((1, None, 1, 3), (1, "a", 2, 3), (3, None, 2, 2))
    want += [(1, "a", 3), (3, "", 2)]
    assert run() == sorted(want)
    batch = R.complete_parents(spark.read.schema(CHUNKS).parquet(src).where("doc_id IS NOT NULL"))
    assert sorted((r.doc_id, r.approach or "") for r in batch.collect()) == sorted(w[:2] for w in want)


def test_unfinished_parents_are_forgotten_after_the_retention(spark):
    import time
    src, sink, checkpoint = scratch(), scratch() + "/done", scratch()
    for n in (1, 2):
        spark.createDataFrame([(1, "j", n, 2, "", "x", 1.0, "c", True, None)], CHUNKS).coalesce(1).write.mode("append").parquet(src)
        R.start_parent_completion(spark, src, sink, checkpoint, available_now=True, retention_seconds=1).awaitTermination()
        time.sleep(2)
    assert spark.read.schema("doc_id long").parquet(sink).count() == 0
