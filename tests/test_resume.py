"""Resumable conversion: every request is paid for once."""

import os
import uuid

import pandas as pd
import pytest

from docpipe.operators import resume as R


def converter(log, fails=(), dies=()):
    """Upper-cases texts; each call leaves a file in ``log``, so calls can be counted."""
    def make():
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            for text in batch["text"]:
                if text in dies:
                    os._exit(3)                      # the worker is lost, not just the call
                with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(text))
            bad = batch["text"].isin(list(fails))
            return pd.DataFrame({"status": bad.map({True: "error", False: "success"}), "markdown": batch["text"].str.upper().where(~bad, None),
                                 "error": bad.map({True: "no", False: None}), "error_type": bad.map({True: "E", False: None}),
                                 "processing_time": 1.0})
        return run
    return make


def calls(log):
    return sorted(open(f"{log}/{f}").read() for f in os.listdir(log))


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "cache"), str(tmp_path / "log")


def docs(spark, texts, prompt="p"):
    return spark.createDataFrame([(k, t, prompt) for k, t in enumerate(texts)], "doc_id long, text string, prompt string")


def run(df, make, cache, version="1", **options):
    out = R.convert_resumable(df, make, ["doc_id"], ["text", "prompt"], cache, version, **options)
    return sorted((r["doc_id"], r["status"], r["markdown"], r["error"], r["cached"]) for r in out.collect())


def test_a_second_run_makes_no_calls(spark, folders):
    cache, log = folders
    df = docs(spark, ["a", "b", "a", None, "", "c"])
    first = run(df, converter(log), cache)
    assert [r[:3] for r in first] == [(0, "success", "A"), (1, "success", "B"), (2, "success", "A"), (3, "success", None), (4, "success", ""), (5, "success", "C")]
    assert calls(log) == ["", "None", "a", "b", "c"]                   # equal requests share a call; null is not ''
    assert [r[:4] for r in run(df, converter(log), cache)] == [r[:4] for r in first] and len(calls(log)) == 5
    assert all(r[4] for r in run(df, converter(log), cache)) and not any(r[4] for r in first)


def test_a_run_with_failures_repeats_only_those(spark, folders):
    cache, log = folders
    df = docs(spark, ["a", "b", "c", "d"])
    assert [r[1:4] for r in run(df, converter(log, fails=("b", "c")), cache)] == [
        ("success", "A", None), ("error", None, "no"), ("error", None, "no"), ("success", "D", None)]
    assert [r[1:] for r in run(df, converter(log, fails=("c",)), cache)] == [
        ("success", "A", None, True), ("success", "B", None, False), ("error", None, "no", False), ("success", "D", None, True)]
    assert calls(log) == ["a", "b", "b", "c", "c", "d"]


def test_a_run_that_dies_keeps_what_its_finished_tasks_paid_for(spark, folders):
    cache, log = folders
    df = docs(spark, [f"t{k}" for k in range(40)])
    with pytest.raises(Exception, match="."):
        run(df, converter(log, dies=("t7",)), cache, partitions=20)
    kept = R.cached_results(spark, cache).select("request").distinct().count()
    paid = len(calls(log))
    assert 0 < kept < 40
    out = run(df, converter(log), cache, partitions=20)
    assert [r[2] for r in out] == [f"T{k}" for k in range(40)] and sum(r[4] for r in out) == kept
    assert len(calls(log)) - paid == 40 - kept


def test_inputs_prompt_and_version_name_a_request(spark, folders):
    cache, log = folders
    run(docs(spark, ["a"]), converter(log), cache)
    run(docs(spark, ["a"], prompt="q"), converter(log), cache)
    run(docs(spark, ["a"], prompt=None), converter(log), cache)
    run(docs(spark, ["a"]), converter(log), cache, version="2")
    assert calls(log) == ["a"] * 4
    assert run(docs(spark, []), converter(log), cache) == [] and len(calls(log)) == 4
