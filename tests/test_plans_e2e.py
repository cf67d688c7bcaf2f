"""End-to-end plans and file/ledger sources with stand-in converters."""

import json
import os
import re
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from docpipe.plans.conversion import convert_ladder, single_pass
from docpipe.sources import fixtures as FX
from docpipe.sources import ledger as LG
from docpipe.sources import sinks as SK
from docpipe.sources.files import extract_pages, extracted, extraction_errors, list_files, read_files
from docpipe.operators.jobs import job_status, latest_job_state
from docpipe.constants import JOB_RECORD_API_KEY
from pyspark import cloudpickle
import sys

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # converters below run in tasks


def upper_pages():
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        n = len(batch)
        return pd.DataFrame({"status": ["success"] * n, "markdown": batch["text"].str.upper(),
                             "error": [None] * n, "error_type": [None] * n, "processing_time": [0.1] * n})
    return run


def scripted():
    """Times out on whole documents of odd id, on every third chunk; answers carry model chatter."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        doc, chunk = int(batch["doc_id"].iloc[0]), int(batch["chunk_number"].iloc[0])
        if chunk == 0 and doc % 2 == 1:
            raise TimeoutError("504 upstream")
        if chunk and chunk % 3 == 0:
            raise TimeoutError("504 upstream")
        if chunk == 0 and doc == 4:
            raise ValueError("rejected")
        return pd.DataFrame({"status": ["success"], "markdown": [batch["text"].iloc[0]], "error": [None], "error_type": [None],
                             "processing_time": [1.0]})
    return run


def scripted_fallback():
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        if int(batch["doc_id"].iloc[0]) == 7:
            raise OSError("no text layer")
        return pd.DataFrame({"status": ["success"], "markdown": ["OCR " + batch["text"].iloc[0]], "error": [None], "error_type": [None],
                             "processing_time": [2.0]})
    return run


LADDER_PAGES = [(1, 3), (2, 25), (3, 2), (4, 2), (5, 2), (6, 2), (7, 2), (9, 50), (10, 0)]


def ladder(spark, enabled=True, **options):
    pages = spark.createDataFrame([(d, p, f"d{d}p{p}") for d, n in LADDER_PAGES for p in range(1, n + 1)],
                                  "doc_id long, page_no int, text string")
    ranges = {3: "1-2", 5: "2", 6: "zzz", 7: "1"}
    jobs = spark.createDataFrame([(d, "job_same_name", ranges.get(d)) for d, _ in LADDER_PAGES],
                                 "doc_id long, job_id string, page_ranges string")
    return convert_ladder(pages, jobs, scripted, scripted_fallback, fallback_enabled=enabled, **options)


def test_ladder_takes_every_document_to_its_end(spark):
    out = ladder(spark)
    docs = {r.doc_id: r for r in out["documents"].collect()}
    assert set(docs) == {d for d, _ in LADDER_PAGES}
    # a time-out without a range is chunked: three pages are one chunk
    assert (docs[1].status, docs[1].route, docs[1].model) == ("success", "chunk", "converter (chunked: 1/1 chunks)")
    assert docs[1].markdown == "d1p1\nd1p2\nd1p3"
    # a long document goes to chunks at once; its third chunk falls back to OCR (chunks have a range)
    assert docs[2].status == "success" and "OCR d2p21" in docs[2].markdown and docs[2].processing_time >= 4.0
    # a time-out with a range goes to the fallback, raw text; its time holds both attempts
    assert (docs[3].route, docs[3].markdown, docs[3].fallback_used) == ("ocr_fallback", "OCR d3p1\nd3p2", True)
    assert docs[3].processing_time >= 2.0 and docs[3].model.endswith("(OCR fallback - formatting reduced)")
    # other errors stay failed, so does an unreadable range
    assert (docs[4].status, docs[4].error, docs[4].error_type, docs[4].route) == ("error", "rejected", "ValueError", "fail")
    assert (docs[6].status, docs[6].error) == ("error", "invalid page ranges: zzz")
    assert docs[5].markdown == "OCR d5p2"
    # a failing fallback leaves the first error and no model label
    assert (docs[7].status, docs[7].error, docs[7].error_type, docs[7].model, docs[7].fallback_used) == (
        "error", "504 upstream", "TimeoutError", None, False)
    assert (docs[10].status, docs[10].markdown) == ("success", "")
    chunks = {(r.doc_id, r.chunk_number): r for r in out["chunk_results"].collect()}
    assert chunks[9, 3].success and chunks[9, 3].content.startswith("OCR ")


def test_ladder_without_fallback_keeps_failures_as_comments(spark):
    out = ladder(spark, enabled=False)
    docs = {r.doc_id: r for r in out["documents"].collect()}
    assert docs[3].status == "error" and docs[3].route == "fail"
    chunks = {(r.doc_id, r.chunk_number): r for r in out["chunk_results"].collect()}
    assert chunks[9, 3].content == "<!-- ERROR: Chunk 31-45 error: 504 upstream -->" and not chunks[9, 3].success
    assert docs[9].model == "converter (chunked: 3/4 chunks)" and "<!-- Pages" not in docs[9].markdown
    lengths = {r.doc_id: r.markdown_length for r in ladder(spark, enabled=False, keep_text=False)["documents"].collect()}
    assert lengths == {d: r.markdown_length for d, r in docs.items()}


def test_late_chunks_that_all_fail_keep_the_first_error(spark):
    def never():
        def run(batch):
            raise TimeoutError(f"504 at {int(batch['chunk_number'].iloc[0])}")
        return run
    pages = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "doc_id long, page_no int, text string")
    jobs = spark.createDataFrame([(1, "j", None), (2, "j", None), (3, "j", None)], "doc_id long, job_id string, page_ranges string")
    docs = {r.doc_id: r for r in convert_ladder(pages, jobs, never, never)["documents"].collect()}
    assert {d: (r.status, r.error, r.model, r.markdown) for d, r in docs.items()} == {
        d: ("error", "504 at 0", None, None) for d in (1, 2, 3)}


def test_chunks_are_cleaned_before_they_are_stitched(spark):
    """A stray rule in one chunk must not pair with one of the next."""
    def answers():
        def run(batch):
            text = {1: "# A\n---\nbody", 2: "---\nAll formatting has been preserved as requested.\n---\n# B"}
            return pd.DataFrame({"status": ["success"], "markdown": [text[int(batch["chunk_number"].iloc[0])]], "error": [None],
                                 "error_type": [None], "processing_time": [1.0]})
        return run
    pages = spark.createDataFrame([(1, p, "x") for p in range(1, 23)], "doc_id long, page_no int, text string")
    jobs = spark.createDataFrame([(1, "j", None)], "doc_id long, job_id string, page_ranges string")
    doc = convert_ladder(pages, jobs, answers, answers, chunk_size=11)["documents"].first()
    assert doc.markdown == "# A\n---\nbody\n\n# B"


def test_gaps_in_page_numbers_lose_nothing(spark):
    def echo():
        return lambda batch: pd.DataFrame({"status": ["success"], "markdown": [batch["text"].iloc[0]], "error": [None], "error_type": [None],
                                           "processing_time": [1.0]})
    have = {1: [1, 2, 4], 2: [*range(1, 23), 40], 3: [3, 9]}
    pages = spark.createDataFrame([(d, p, f"p{p}") for d, ps in have.items() for p in ps], "doc_id long, page_no int, text string")
    jobs = spark.createDataFrame([(1, "j", None), (2, "j", None), (3, "j", "2-9")], "doc_id long, job_id string, page_ranges string")
    docs = {r.doc_id: r for r in convert_ladder(pages, jobs, echo, echo)["documents"].collect()}
    assert docs[2].route == "chunk"
    assert {d: [int(x) for x in re.findall(r"p([0-9]+)", r.markdown)] for d, r in docs.items()} == have
    files = spark.createDataFrame([(d, 10) for d in have], "doc_id long, file_size_bytes long")
    requests = jobs.select("doc_id", "page_ranges")
    shown = pages.withColumn("images", F.lit(0).cast("long"))
    once = {r.doc_id: r.pages_ok for r in single_pass(shown, files, requests, upper_pages)["documents"].collect()}
    assert once == {1: 3, 2: 23, 3: 2}


def test_ladder_over_prompt_variants(spark):
    from docpipe.sources.prompts import PROMPTS, fan_out

    def prompted():
        def run(batch):
            ok = int(batch["approach_no"].iloc[0]) != 3
            return pd.DataFrame({"status": ["success" if ok else "error"], "markdown": [batch["prompt"].iloc[0] + batch["text"].iloc[0]],
                                 "error": [None if ok else "refused"], "error_type": [None], "processing_time": [1.0]})
        return run
    pages = spark.createDataFrame([(1, 1, "one"), (2, 1, "two")] + [(3, p, f"p{p}") for p in range(1, 31)],
                                  "doc_id long, page_no int, text string")
    jobs = fan_out(spark.createDataFrame([(d, "j", None) for d in (1, 2, 3)], "doc_id long, job_id string, page_ranges string"))
    out = convert_ladder(pages, jobs, prompted, prompted, keys=["doc_id", "approach"])
    docs = {(r.doc_id, r.approach): r for r in out["documents"].collect()}
    assert len(docs) == 3 * len(PROMPTS)
    assert docs[1, "default"].markdown == (PROMPTS["default"] + "one").strip()
    assert docs[2, "minimal"].status == "error" and docs[2, "minimal"].error == "refused"
    assert docs[3, "default"].model == "converter (chunked: 3/3 chunks)"


def test_single_pass(spark):
    pages, files, req = FX.fx_pages(spark, SF_SMALL), FX.fx_files(spark, SF_SMALL), FX.fx_requests(spark, SF_SMALL)
    out = single_pass(pages, files, req, upper_pages, enhanced=True, call_rows=1000)
    docs = {r.doc_id: r for r in out["documents"].collect()}
    assert len(docs) == files.count()
    # doc 3 asks for page 1 only; its Markdown is that page, upper-cased
    first = pages.where("doc_id = 3 AND page_no = 1").first().text.upper()
    assert docs[3].pages_ok == 1 and docs[3].markdown.startswith(first[:20].strip()[:5]) and docs[3].status == "success"
    assert out["routed"].where("route = 'remove_images'").count() > 0
    # doc 8 has no page range: every page is converted; doc 6 has one that cannot be read
    assert docs[8].pages_ok == pages.where("doc_id = 8").count()
    assert (docs[6].status, docs[6].error, docs[6].markdown) == ("error", "invalid page ranges: x", None)


def test_single_pass_fails_a_document_with_a_failed_page(spark):
    def second_page_fails():
        def run(batch):
            if int(batch["page_no"].iloc[0]) == 2:
                raise ValueError("page 2 is damaged")
            return upper_pages()(batch)
        return run
    pages = spark.createDataFrame([(1, 1, "a", 0), (1, 2, "b", 0), (2, 1, "c", 0)], "doc_id long, page_no int, text string, images long")
    files = spark.createDataFrame([(1, 10), (2, 10)], "doc_id long, file_size_bytes long")
    req = spark.createDataFrame([(1, None), (2, None)], "doc_id long, page_ranges string")
    got = {r.doc_id: (r.status, r.error, r.markdown) for r in single_pass(pages, files, req, second_page_fails)["documents"].collect()}
    assert got == {1: ("error", "page 2 is damaged", None), 2: ("success", None, "C")}


def test_file_scan_and_extractor(spark):
    d = tempfile.mkdtemp(prefix="docpipe-files-")
    for i in range(3):
        with open(os.path.join(d, f"doc_{i}.pdf"), "wb") as f:
            f.write(("page one\fpage two" * (i + 1)).encode())
    listed = list_files(spark, d)
    assert sorted(r.file_size_bytes for r in listed.collect()) == [17, 34, 51]

    def split_pages(data: bytes):
        for n, part in enumerate(data.decode().split("\f"), start=1):
            yield n, part, 0

    pages = extract_pages(read_files(spark, d), split_pages)
    assert extracted(pages).groupBy("doc_id").count().orderBy("count").collect()[-1]["count"] == 4
    assert extraction_errors(pages).count() == 0

    def damaged(data: bytes):
        yield from split_pages(data)
        if len(data) > 40:
            raise ValueError("cut off")

    pages = extract_pages(read_files(spark, d), damaged)
    assert extracted(pages).count() == 5          # 2 + 3: the pages of a damaged file are not taken for the whole
    assert [r.error for r in extraction_errors(pages).collect()] == ["ValueError: cut off"]


def test_pages_of_one_file_are_read_by_many_tasks(spark):
    """Rows equal the whole-file extractor; a broken range, count or file gives one error row and no pages."""
    from docpipe.sources.files import extract_page_ranges
    d = tempfile.mkdtemp(prefix="docpipe-ranges-")
    sizes = {"long": 500, "short": 1, "none": 0, "broken": 30, "twice": 40, "uncounted": 5}
    for name, n in sizes.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write("\f".join(f"{name} page {k}" for k in range(1, n + 1)).encode())

    def pages_of(data):
        return data.decode().split("\f") if data else []

    def opened(path):
        return open(path.removeprefix("file:"), "rb")

    def count(handle):
        data = handle.read()
        if data.startswith(b"uncounted"):
            raise ValueError("no page tree")
        return len(pages_of(data))

    def reader(handle, first, last):
        for k, text in list(enumerate(pages_of(handle.read()), start=1))[first - 1:last]:
            if text in ("broken page 17", "twice page 9", "twice page 31"):
                raise ValueError(text)
            yield k, text, k % 3

    def whole(data: bytes):
        if data.startswith(b"uncounted"):
            raise ValueError("no page tree")
        for k, text in enumerate(pages_of(data), start=1):
            if text in ("broken page 17", "twice page 9", "twice page 31"):
                raise ValueError(text)
            yield k, text, k % 3

    files = list_files(spark, d)
    got = extract_page_ranges(files, opened, count, reader, pages_per_range=7, partitions=6, batch_pages=3)
    want = extract_pages(read_files(spark, d), whole)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert extraction_errors(got).count() == 3 and extracted(got).count() == 501


def test_job_record_ingest_and_sinks(spark):
    d = tempfile.mkdtemp(prefix="docpipe-jobs-")
    recs = [{"id": "job_1", "input_file": "/a/x.pdf", "status": "started", "start_time": "2024-01-01T10:00:00.5"},
            {"id": "job_2", "input_file": "/a/y.pdf", "status": "completed", "start_time": "2024-01-01T10:00:00",
             "end_time": "2024-01-01T10:01:00", JOB_RECORD_API_KEY: {"usage": {"prompt_tokens": 5, "completion_tokens": 7,
                                                                           "total_tokens": 12}}},
            {"id": "job_3", "input_file": "/a/z.pdf", "status": "started", "start_time": "2024-01-01T10:00:00",
             "current_stage": "waiting_for_chat_response",
             JOB_RECORD_API_KEY: {"chat_request_timestamp": "2024-01-01T10:04:00"}}]
    for r in recs:
        with open(os.path.join(d, r["id"] + ".json"), "w") as f:
            json.dump(r, f, indent=2)
    ev = LG.read_job_records(spark, d)
    state = {r.job_id: r for r in latest_job_state(ev).collect()}
    assert state["job_2"].prompt_tokens == 5 and state["job_1"].status == "started"
    assert str(state["job_2"].start_time) == "2024-01-01 10:00:00" and str(state["job_2"].end_time) == "2024-01-01 10:01:00"
    waiting = {r.job_id: r for r in job_status(latest_job_state(ev), "2024-01-01 10:05:00").collect()}["job_3"]
    assert waiting.api_wait_seconds == 60.0 and not waiting.long_wait and waiting.elapsed_seconds == 300.0
    out = tempfile.mkdtemp(prefix="docpipe-ledger-") + "/events"
    LG.append_job_events(ev, out)
    LG.append_job_events(ev, out)
    assert LG.read_job_events(spark, out).count() == 6
    md = tempfile.mkdtemp(prefix="docpipe-md-") + "/md"
    SK.write_markdown(spark.createDataFrame([(1, "a", "j", "x.md", "# t")],
                                            "doc_id long, approach string, job_id string, output_name string, markdown string"), md)
    assert spark.read.parquet(md).first().markdown == "# t"


def test_metadata_sink_round_trip(spark):
    from docpipe.plans.catalog import REGISTRY
    meta = REGISTRY["run_metadata"].run(spark, SF_SMALL)
    out = tempfile.mkdtemp(prefix="docpipe-meta-") + "/meta"
    SK.write_metadata(meta, out)
    back = spark.read.json(out)
    assert back.count() == meta.count()
    row = back.where("status = 'success'").first()
    assert row.optimization.size_reduction is not None and row.processing_time.total >= row.processing_time.ocr
    assert set(back.columns) >= {"source_pdf", "output_markdown", "job_id", "pages_processed", "optimization",
                                 "processing_time", "model", "status", "markdown_length"}
