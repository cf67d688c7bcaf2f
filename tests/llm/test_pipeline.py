"""The corpus pipeline stage by stage against plain Python over each stage's own input."""

import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, ROOT)

import corpus_pipeline as P  # noqa: E402
from test_simhash import plain_components, plain_fingerprint  # noqa: E402
from test_texts import plain_leaks, plain_lines  # noqa: E402

from docpipe.llm import quality  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF_SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality_rejects_by_score(spark, stages):
    model = quality.train(stages[0], P.table(spark, SF_SMALL, "labels").where(~quality.held_out()))
    keep = {r["doc_id"] for r in quality.score(stages[0], model).where("score >= 0.3").collect()}
    assert rows(stages[1]) == [x for x in rows(stages[0]) if x[0] in keep]
    assert 0 < stages[1].count() < stages[0].count()


def test_lines_near_copies_and_leaks(spark, stages):
    before = rows(stages[1])
    want = plain_lines(before)
    assert rows(stages[2]) == sorted((d, want[t][0]) for d, t in before)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())
    root = plain_components([(d, plain_fingerprint(t)) for d, t in rows(stages[2])])
    assert rows(stages[3]) == [x for x in rows(stages[2]) if root[x[0]] == x[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {d for d, _ in plain_leaks(rows(stages[3]), items)}
    assert rows(stages[4]) == [x for x in rows(stages[3]) if x[0] not in leaked]


def test_mix_takes_words_of_what_is_left(stages):
    texts = dict(rows(stages[4]))
    total = sum(len(t.split()) for t in texts.values())
    taken = {}
    for r in stages[5].collect():
        assert r["text"] == texts[r["doc_id"]]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["mix"]["taken"]
    assert all(t <= 2 * len(texts[d].split()) for d, t in taken.items())
    assert abs(sum(taken.values()) - 1.5 * total) <= 20


def test_run_is_the_stages_in_turn(spark, stages):
    got = sorted((r["doc_id"], r["mix"]["copy"], r["mix"]["taken"]) for r in P.run(spark, SF_SMALL).collect())
    assert got == sorted((r["doc_id"], r["mix"]["copy"], r["mix"]["taken"]) for r in stages[5].collect())


def test_stages_take_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names, and no rows at all."""
    long_text = " ".join(f"w{k % 5003}" for k in range(100_000))
    texts = [(1, None), (2, ""), (None, "alpha beta gamma delta epsilon"), (None, None), (3, "alpha beta gamma delta epsilon"),
             (4, long_text), (4, long_text), (5, "one\ntwo\n\nthree four five six"), (5, "another text of this id and its own words")]
    clash = ["k1", "k2", "doc", "score", "content", "n_lines", "n_dropped", "fp", "line", "size", "taken", "nth", "key_id", "block", "n"]
    docs = spark.createDataFrame([(d, t, None, None if d == 2 else "s", 3, *range(len(clash))) for d, t in texts],
                                 "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} int" for c in clash))
    want = {"quality": 9, "lines": 9, "near_copies": 5, "decontaminate": 9}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF_SMALL)
        got = out.collect()
        if name == "mix":
            assert out.columns == [*docs.columns, "mix"]
            assert all(r["mix"]["taken"] <= 2 * r["mix"]["size"] for r in got)
            assert {r["doc_id"] for r in got} == {None, 3, 4, 5}
        else:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert len(got) <= want[name] if name == "quality" else len(got) == want[name]
            assert all(r["n_lines"] == 5 and r["n"] == 14 for r in got)
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0


def test_lines_of_few_tokens_recur(spark):
    """Lines of one to three tokens are dropped when they stand in ten texts; nine texts keep theirs."""
    texts = [f"own words of text {'abcdefghijkl'[k]}\nAll rights reserved.\nLes.\n\nPage {k}" + ("\nin nine" if k < 9 else "") for k in range(12)]
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in P.without_recurring_lines(spark, docs, SF_SMALL).collect()}
    assert got[0]["text"] == texts[0]
    for k in range(1, 12):
        assert got[k]["text"] == "\n".join(x for x in texts[k].split("\n") if x not in ("All rights reserved.", "Les.", f"Page {k}"))
        assert got[k]["n_chars"] == len(got[k]["text"])
