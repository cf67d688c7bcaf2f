"""Page ranges, chunk plans, profiles and ledger rules on literal tables."""

import pytest
from pyspark.sql import functions as F

import seqmodel as M
from docpipe.functions.pages import parse_page_ranges
from docpipe.operators import chunks as CH
from docpipe.operators import jobs as JB
from docpipe.operators import pages as PG
from docpipe.operators import profile as PR


@pytest.mark.parametrize("spec,expected", [
    ("1-3,5,7-9", [1, 2, 3, 5, 7, 8, 9]), ("5-3", []), ("7-7", [7]), ("10,1", [1, 10]),
    (" 2 - 4 ,3", [2, 3, 4]), ("1-2-3", None), ("x", None), ("", None), ("1,,2", None),
    ("99999999999", None), ("1\t2", None), ("1-\t2", [1, 2]), ("1 2", [12]),
])
def test_page_ranges(spark, spec, expected):
    got = spark.createDataFrame([(spec,)], "s string").select(parse_page_ranges(F.col("s")).alias("p")).first().p
    assert got == expected
    if expected is not None:
        assert got == M.parse_ranges(spec)


@pytest.mark.parametrize("pages,size,labels", [
    (1, 15, ["1"]), (8, 15, ["1-5", "6-8"]), (11, 15, ["1-10", "11"]), (21, 15, ["1-10", "11-20", "21"]),
    (31, 15, ["1-15", "16-30", "31"]), (21, 4, ["1-4", "5-8", "9-12", "13-16", "17-20", "21"]), (0, 15, []),
])
def test_chunk_plans(spark, pages, size, labels):
    counts = spark.createDataFrame([(1, "job_x", pages)], "doc_id long, job_id string, total_pages long")
    plan = CH.chunk_plan(counts, size).orderBy("chunk_number").collect()
    assert [r.label for r in plan] == labels == M.chunk_labels(pages, size)
    if plan:
        assert plan[0].chunk_job_id == f"job_x_chunk_01_of_{len(labels):02d}"


def test_chunk_membership_equals_range_join(spark):
    pages = spark.range(1, 48).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page_no"))
    counts = spark.createDataFrame([(1, "j", 47)], "doc_id long, job_id string, total_pages long")
    plan = CH.chunk_plan(counts)
    arithmetic = CH.chunk_membership(pages, CH.chunk_sizes(counts)).select("doc_id", "page_no", "chunk_number")
    theta = pages.join(plan, (pages.doc_id == plan.doc_id) & pages.page_no.between(plan.start_page, plan.end_page)) \
        .select(pages.doc_id, "page_no", "chunk_number")
    assert sorted(arithmetic.collect()) == sorted(theta.collect())


def test_profile_zero_pages_and_zero_bytes(spark):
    pages = spark.createDataFrame([(1, 1, "a" * 10, 40), (1, 2, "", 0)], "doc_id long, page_no int, text string, images long")
    files = spark.createDataFrame([(1, 60 * 1024 * 1024), (2, 0)], "doc_id long, file_size_bytes long")
    rows = {r.doc_id: r for r in PR.document_profile(pages, files, text_limit=5, include_page_details=True).collect()}
    assert rows[1].total_pages == 2 and rows[1].total_images == 40 and rows[1].avg_images_per_page == 20.0
    assert rows[1].exceeds_limits.has_image_heavy_pages and rows[1].exceeds_limits.has_text_heavy_pages
    assert rows[1].recommendations == ["Remove images to reduce file size and processing time",
                                       "1 pages may exceed 64KB text limit"]
    assert [p.page for p in rows[1].page_details] == [1, 2]
    assert rows[2].total_pages == 0 and rows[2].avg_images_per_page == 0.0 and rows[2].recommendations == []
    routed = {r.doc_id: r.route for r in PR.optimize_routing(PR.document_profile(pages, files, 5)).collect()}
    assert routed == {1: "remove_images", 2: "skipped"}


def test_size_reduction_ties_round_half_even(spark):
    files = spark.createDataFrame([(1, 16384, 16384 - 8 * 128), (2, 0, 0)],
                                  "doc_id long, file_size_bytes long, optimized_size_bytes long")
    rows = {r.doc_id: r for r in PR.size_reduction(files).collect()}
    assert rows[1].size_reduction == "6.2%"       # 6.25 -> half-even, as '%.1f' in Python
    assert rows[2].status == "error" and rows[2].size_reduction == "N/A"


def test_stitch_pages_keeps_empty_documents(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, ""), (2, 1, "")],
                                  "doc_id long, page_no int, text string")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    out = {r.doc_id: r.markdown for r in PG.stitch_pages(pages, docs).collect()}
    assert out == {1: "a\n\n---\n\nb", 2: "", 3: ""}


def ledger(spark, rows):
    """Events from their first ten fields; the others are NULL."""
    from docpipe.schemas import JOB_EVENT_SCHEMA
    width = len(JOB_EVENT_SCHEMA.fields)
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], JOB_EVENT_SCHEMA)


def test_job_severity_edges(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [(1, "a", t0, "started", "waiting_for_chat_response", "/x/a.pdf", None, None, 1, 1),
            (2, "b", t0 + dt.timedelta(seconds=1), "started", None, "/x/b.pdf", None, None, 1, 1)]
    state = JB.latest_job_state(ledger(spark, rows))
    as_of = "2024-01-01 12:05:00"      # a: 300 s exactly, b: 299 s
    st = {r.job_id: r for r in JB.job_status(state, as_of).collect()}
    assert st["a"].severity == "cyan" and st["b"].severity == "cyan"
    assert st["a"].long_wait and st["a"].api_wait_seconds == 300.0
    st2 = {r.job_id: r for r in JB.job_status(state, "2024-01-01 12:10:01").collect()}
    assert st2["a"].severity == "yellow"          # > 600 s is still yellow: the red branch is shadowed
    hung = JB.hung_jobs(state, "2024-01-01 12:10:00").collect()
    assert hung == []                              # exactly 600 s is not hung
    assert [r.job_id for r in JB.hung_jobs(state, "2024-01-01 12:10:00.5").collect()] == ["a"]


def test_retry_routing_table(spark):
    rows = [("APITimeoutError", "x", None), ("SDKError", "HTTP 504", None), ("SDKError", "Read TIMEOUT", "1-3"),
            ("SDKError", "bad request", None), ("SDKError", "504", "1-3")]
    df = spark.createDataFrame(rows, "error_type string, error string, page_ranges string")
    got = [(r.next_route, r.final_stage) for r in JB.retry_routing(df, True).collect()]
    assert got == [("chunk", "api_timeout"), ("chunk", "api_error"), ("ocr_fallback", "api_error"),
                   ("fail", "api_error"), ("ocr_fallback", "api_error")]
    got_off = [r.next_route for r in JB.retry_routing(df, False).collect()]
    assert got_off == ["chunk", "chunk", "fail", "fail", "fail"]


def test_job_lookup_by_ids(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [(1, "a", t0, "completed", None, "/x/a.pdf", None, None, 3, 4)]
    state = JB.latest_job_state(ledger(spark, rows))
    ids = spark.createDataFrame([("a",), ("zzz",)], "job_id string")
    got = {r.job_id: (r.found, r.total_tokens) for r in JB.job_status(state, "2024-01-01 13:00:00", ids).collect()}
    assert got == {"a": (True, 7), "zzz": (False, None)}


def test_custom_prompt_file_and_fan_out(spark, tmp_path):
    from docpipe.sources.prompts import fan_out, prompt_catalog, read_prompt_file
    p = tmp_path / "prompt.txt"
    p.write_text("Convert, keeping every table.\nSecond line.")
    text = read_prompt_file(spark, str(p))
    assert text == "Convert, keeping every table.\nSecond line."
    cat = prompt_catalog(spark, text)
    assert cat.count() == 9 and cat.where("approach = 'custom'").first().prompt_length == len(text)
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    out = fan_out(docs, approaches=["default", "custom"], custom_prompt=text).collect()
    assert sorted((r.doc_id, r.approach, r.prompt_type) for r in out) == [
        (1, "custom", "custom"), (1, "default", "default"), (2, "custom", "custom"), (2, "default", "default")]


def test_random_page_ranges_match_sequential_model(spark):
    import random
    rnd = random.Random(11)
    specs = []
    for _ in range(300):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            a = rnd.randint(0, 30)
            parts.append(str(a) if rnd.random() < 0.5 else f"{a}-{a + rnd.randint(-3, 6)}")
        specs.append(",".join(parts))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i int, s string")
    got = [r.p for r in df.select("i", parse_page_ranges(F.col("s")).alias("p")).orderBy("i").collect()]
    for spec, pages in zip(specs, got):
        try:
            want = M.parse_ranges(spec)
        except ValueError:
            want = None
        assert pages == want, spec


def test_stitch_in_blocks_of_any_size(spark):
    rows = [(1, p, f"p{p}") for p in range(1, 8)] + [(2, 1, "only")] + [(3, 2, "b"), (3, 1, "a"), (5, 1, None), (5, 2, "")]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "doc_id long")
    want = {1: "\n\n---\n\n".join(f"p{p}" for p in range(1, 8)), 2: "only", 3: "a\n\n---\n\nb", 4: "", 5: ""}
    for block in (1, 2, 3, 1024):
        assert {r.doc_id: r.markdown for r in PG.stitch_pages(pages, docs, block_parts=block).collect()} == want


def test_stitched_chunks_of_one_job_id_stay_apart(spark):
    """Two files of one name share their job id; each keeps its own text and its own chunks."""
    counts = spark.createDataFrame([(1, "job_rules", 1), (2, "job_rules", 1)], "doc_id long, job_id string, total_pages long")
    outcomes = spark.createDataFrame([(1, 1, "success", "one", None, 1.0), (2, 1, "success", "two", None, 1.0)],
                                     "doc_id long, chunk_number int, status string, markdown string, error string, processing_time double")
    res = CH.chunk_results(CH.chunk_plan(counts), outcomes)
    assert res.count() == 2
    assert {r.doc_id: r.markdown for r in CH.stitch_chunks(res, block_parts=2).collect()} == {1: "one", 2: "two"}
    assert {r.doc_id: r.total_chunks for r in CH.chunk_summary(res).collect()} == {1: 1, 2: 1}
    runs = spark.createDataFrame([(1, 1, "job_a", "completed"), (2, 1, "job_a", "completed")],
                                 "doc_id long, chunk_number int, original_job_id string, status string")
    assert CH.chunk_job_link(res, runs).count() == 2


def test_parse_usage_from_raw_json(spark):
    rows = [('{"id": "x", "usage": {"prompt_tokens": 5, "completion_tokens": 7, "total_tokens": 12}}',),
            ('{"id": "y"}',), ('{"usage": {"total_tokens": 3}}',), ("not json",), (None,)]
    df = spark.createDataFrame(rows, "raw string")
    got = [tuple(r.u) if r.u is not None else None for r in df.select(JB.parse_usage(F.col("raw")).alias("u")).collect()]
    assert got == [(5, 7, 12), None, (None, None, 3), None, None]


def test_chunk_membership_from_row_page_count(spark):
    pages = spark.range(1, 48).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page_no"),
                                      F.lit(47).cast("long").alias("n"))
    counts = spark.createDataFrame([(1, "j", 47)], "doc_id long, job_id string, total_pages long")
    narrow = CH.chunk_membership(pages, size_col="n").select("doc_id", "page_no", "chunk_number")
    joined = CH.chunk_membership(pages.drop("n"), CH.chunk_sizes(counts)).select("doc_id", "page_no", "chunk_number")
    assert sorted(narrow.collect()) == sorted(joined.collect())
    assert "Exchange" not in narrow._jdf.queryExecution().executedPlan().toString()


def test_chunk_results_error_forms(spark):
    plan = spark.createDataFrame([(1, "j", 1, 3, "1-5", "j_chunk_01_of_03"), (1, "j", 2, 3, "6-10", "j_chunk_02_of_03"),
                                  (1, "j", 3, 3, "11", "j_chunk_03_of_03")],
                                 "doc_id long, job_id string, chunk_number int, total_chunks int, label string, chunk_job_id string")
    outcomes = spark.createDataFrame([(1, 1, "error", None, "HTTP 504", 0.0), (1, 2, "exception", None, "boom", 0.0)],
                                     "doc_id long, chunk_number int, status string, markdown string, error string, "
                                     "processing_time double")
    got = {r.chunk_number: r.content for r in CH.chunk_results(plan, outcomes).collect()}
    assert got == {1: "<!-- ERROR: Chunk 1-5 failed: HTTP 504 -->", 2: "<!-- ERROR: Chunk 6-10 error: boom -->",
                   3: "<!-- ERROR: Chunk 11 failed: Unknown error -->"}


def test_output_names(spark):
    from docpipe.operators.results import approach_output_name, job_ids
    files = spark.createDataFrame([(1, "/corpus/a/Rule Book.v2.pdf")], "doc_id long, path string")
    r = job_ids(files, F.lit("2024-01-30 12:00:05").cast("timestamp_ntz")).first()
    assert r.job_id == "job_20240130_120005_Rule Book.v2"
    assert r.output_markdown == "Rule Book.v2_job_20240130_120005_Rule Book.v2.md"
    assert r.error_metadata == "Rule Book.v2_error_job_20240130_120005_Rule Book.v2_error_metadata.json"
    name = spark.range(1).select(approach_output_name(F.lit("Rule Book.v2"), F.lit("minimal"), F.lit(r.job_id))).first()[0]
    assert name == "Rule Book.v2_minimal_job_20240130_120005_Rule Book.v2.md"


def test_page_ranges_clipped_to_document(spark):
    df = spark.createDataFrame([("1-1000000000", 5), ("0,3,9", 5), ("4-2", 5), ("x", 5)], "s string, n long")
    got = [r.p for r in df.select(parse_page_ranges(F.col("s"), F.col("n")).alias("p")).collect()]
    assert got == [[1, 2, 3, 4, 5], [3], [], None]


def test_pages_to_convert_are_those_that_exist(spark):
    """Gaps, far pages and huge ranges: equal to testing each page on its own."""
    have = {1: [1, 2, 4], 2: [1, 5, 1023, 1024, 1025, 5000, 2_000_000_000], 3: [1, 2], 4: [1], 5: [7], 6: [0, 1, 3]}
    pages = spark.createDataFrame([(d, p, f"{d}.{p}") for d, ps in have.items() for p in ps] + [(1, None, "no number")],
                                  "doc_id long, page_no int, text string").repartition(4)
    requests = [(1, None), (2, "5-1024,1999999999-2000000000,4"), (3, "2-1000000000"), (4, "x"), (5, ""), (6, "1-2"), (6, "1-2"), (9, None)]
    got = PG.pages_to_convert(pages, spark.createDataFrame(requests, "doc_id long, page_ranges string"))
    assert got.columns == pages.columns
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 1, "1.1"), (1, 2, "1.2"), (1, 4, "1.4"), (2, 5, "2.5"), (2, 1023, "2.1023"), (2, 1024, "2.1024"),
        (2, 2_000_000_000, "2.2000000000"), (3, 2, "3.2"), (5, 7, "5.7"), (6, 1, "6.1")]


def test_huge_ranges_are_never_expanded(spark):
    pages = spark.createDataFrame([(1, p, f"t{p}") for p in range(1, 6)], "doc_id long, page_no int, text string")
    req = spark.createDataFrame([(1, "4-1000000000,0,2"), (2, "7-9"), (3, None), (4, "x")], "doc_id long, page_ranges string")
    assert sorted(r.page_no for r in PG.select_pages(pages, req).collect()) == [2, 4, 5]
    assert sorted(tuple(r) for r in PG.missing_pages(pages, req).collect()) == [(1, 0, 0), (1, 6, 1000000000), (2, 7, 9)]
    named = {r.doc_id: r.n_pages for r in PG.parsed_requests(req).collect()}
    assert named == {1: 999_999_999, 2: 3, 3: None, 4: None}


def test_converter_rows_are_never_lost_or_sent_again(spark, tmp_path):
    """Short answers, missing statuses and exceptions become rows; each row is handed over once."""
    from docpipe.operators.convert import convert
    log = str(tmp_path)

    def odd():
        import os
        import uuid

        import pandas as pd

        def run(batch):
            for d in batch["doc_id"]:
                open(os.path.join(log, f"{d}-{uuid.uuid4().hex}"), "w").close()
            if (batch["doc_id"] == 5).any():
                raise ValueError("boom")
            out = pd.DataFrame({"status": "success", "markdown": "m", "error": None, "error_type": None, "processing_time": 0.1},
                               index=range(len(batch)))
            if (batch["doc_id"] == 2).any():
                out = out.iloc[:-1]
            if (batch["doc_id"] == 7).any():
                out.loc[0, "status"] = None
            return out
        return run

    df = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for call_rows in (1, 3):
        got = {r.doc_id: (r.status, r.error_type) for r in convert(df, odd, ["doc_id"], ["text"], call_rows=call_rows).collect()}
        assert set(got) == set(range(10))
        assert got[5] == ("exception", "ValueError")
        assert got[2] == ("exception", "ConverterContractError")
    import os
    calls = [f.split("-")[0] for f in os.listdir(log)]
    assert sorted(calls) == sorted([str(d) for d in range(10)] * 2)


def test_recorded_times_win_over_event_times(spark):
    import datetime as dt
    from docpipe.schemas import JOB_EVENT_SCHEMA
    t = dt.datetime(2024, 1, 1, 10, 0, 0)
    event = dict.fromkeys(f.name for f in JOB_EVENT_SCHEMA.fields)
    event |= {"event_id": 1, "job_id": "a", "event_ts": t + dt.timedelta(minutes=4), "status": "started",
              "current_stage": "waiting_for_chat_response", "start_time": t, "request_ts": t + dt.timedelta(minutes=4)}
    state = JB.latest_job_state(spark.createDataFrame([tuple(event.values())], JOB_EVENT_SCHEMA))
    row = JB.job_status(state, "2024-01-01 10:05:00").first()
    assert (row.elapsed_seconds, row.api_wait_seconds, row.long_wait, row.prompt_type) == (300.0, 60.0, False, "unknown")


def test_list_jobs_reads_the_state_of_the_top_ids_only(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, f"job_{k:03d}", t0 + dt.timedelta(seconds=k), "started", None, f"/x/{k}.pdf", None, None, 1, 1) for k in range(40)]
    got = JB.list_jobs(ledger(spark, rows), 3)
    assert sorted(r.job_id for r in got.collect()) == ["job_037", "job_038", "job_039"]
    assert "TakeOrderedAndProject" in got._jdf.queryExecution().executedPlan().toString()


def test_prompt_file_must_be_one(spark, tmp_path):
    from docpipe.sources.prompts import read_prompt_file
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "b.txt").write_text("b")
    with pytest.raises(ValueError):
        read_prompt_file(spark, str(tmp_path))
