"""Chat formatting, exact top-k and source mixing: edge cases and invariants beside the SQL."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from docpipe.llm import chat, mixing, topk

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def formatted(spark, rows):
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    return {r["conv_id"]: r for r in out.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("loss"), F.col("segments")).collect()}


def test_chat_round_trip_of_hard_texts(spark):
    rng = random.Random(2)
    bits = [*chat.CONTROL, "<", "[", "\\", "\\\\", "|im_end|>", "s>", "\n", "", " ", "é", "<\\|im_end|>", "[\\INST]", "$1"]
    rows, want = [], defaultdict(list)
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "<s>\n", "", None])
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
            rows.append((conv, turn, role, text, "x"))
            want[conv].append((role or "", text or ""))
    rng.shuffle(rows)
    got = formatted(spark, rows)
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv]["turns"]] == turns
        assert got[conv]["loss"] == "".join(t for r, t in turns if r == "assistant")
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))       # adjacent turns of a role are merged
        assert got[conv]["formatted"].count(chat.START) == blocks == got[conv]["formatted"].count(chat.END)


def test_chat_ties_nulls_and_empty(spark):
    rows = [(1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (1, None, "system", "s", ""),
            (None, 0, "assistant", None, "")]
    got = formatted(spark, rows)
    assert [tuple(t) for t in got[1]["turns"]] == [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[1]["formatted"] == ("<|im_start|>system<|im_body|>s<|im_end|>\n"
                                   "<|im_start|>user<|im_body|>a<|im_next|>a<|im_next|>b<|im_end|>\n")
    assert [tuple(t) for t in got[None]["turns"]] == [("assistant", "")]
    assert formatted(spark, []) == {}
    many = [(5, k, "user" if k % 3 else "assistant", f"text {k} " * 20, "") for k in range(6000)]
    assert len(formatted(spark, many)[5]["turns"]) == 6000


def test_topk_against_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), [float(x) for x in np.round(rng.normal(0, 1, 6), 1)]) for k in range(400)]
    rows += [(int(k), rows[0][1]) for k in range(400, 600)]                     # a hot vector
    rows += [(700, None), (800, []), (900, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1000, [float("nan")] * 6),
             (1100, [math.inf] * 6), (None, rows[1][1]), (1200, [1.0, 2.0]), (1300, [2.0, 1.0]), (7, rows[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    good = [(k, np.floor(1024 * np.array(v))) for k, v in rows
            if k is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, qv in good:
        if q % 100 == 0:
            best = sorted((-int(qv @ v), k) for k, v in good if k != q and len(v) == len(qv))[:10]
            want |= {(q, n + 1, k, -s) for n, (s, k) in enumerate(best)}
    got = topk.topk(df, df.where("vec_id % 100 = 0"), shard_rows=64, query_rows=3)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.topk(df.limit(0), df, 10).count() == 0
    assert topk.topk(df, df.limit(0), 10).count() == 0


def test_bounds_close_early_where_scores_differ():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(0, 10, (500, 4)))
    x[:15] += 500
    ids = np.arange(500)
    (place, found, scores), = topk.shard_topk(ids, x, np.array([900]), np.ones((1, 4)), 10)
    best = np.lexsort((ids, -x.sum(axis=1)))[:10]
    assert place == 0 and found.tolist() == best.tolist() and scores.tolist() == x.sum(axis=1)[best].tolist()


def test_topk_of_one_id_with_two_vectors(spark):
    """Each distinct vector of a query id is a query; a repeated row is none of its own."""
    schema = "vec_id long, embedding array<float>"
    base = spark.createDataFrame([(k, [float(k % 7), float(k % 5)]) for k in range(1, 40)], schema)
    asked = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, -1.0])]
    got = topk.topk(base, spark.createDataFrame(asked, schema), k=3).collect()
    assert len(got) == 6
    want = []
    for v in ([1.0, 0.0], [0.0, -1.0]):
        scores = sorted((-int(1024 * 1024 * (v[0] * (k % 7) + v[1] * (k % 5))), k) for k in range(1, 40))[:3]
        want += [(100, r, k, -s) for r, (s, k) in enumerate(scores, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_mix_reaches_targets_and_keeps_order(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    copies = mixing.mix(docs).collect()
    by_source = defaultdict(int)
    for r in copies:
        by_source[r["source"], r["target"]] += r["taken"]
        assert 0 <= r["taken"] <= r["size"]
    assert all(abs(taken - target) <= 1024 for (_, target), taken in by_source.items())       # packets of 256 words in service at the cut
    total = sum(r["size"] for r in copies) // 2
    assert sum(by_source.values()) == 3 * total // 2
    served = sorted((r for r in copies if r["taken"]), key=lambda r: r["mix_end"])
    assert [r["finish"] for r in served] == sorted(r["finish"] for r in served)
    ends = 0
    for r in served:
        ends += r["taken"]
        assert r["mix_end"] == ends
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copy"], r["taken"]) for r in again) == sorted((r["doc_id"], r["copy"], r["taken"]) for r in copies)


def plain_mix(rows, packet, weights=(5, 2, 1)):
    """(name, source, size) in queue order -> words taken: all packets of two passes, sorted by finish time and cut at the budget."""
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    queue = []
    for rank, source in enumerate(names):
        served = 0
        for _ in range(2):
            for name, _, size in (r for r in rows if r[1] == source):
                for at in range(0, size, packet):
                    words = min(packet, size - at)
                    served += words
                    queue.append((served / weights[rank % 3], rank, name, words))
    left, taken = 3 * sum(size for _, _, size in rows) // 2, Counter()
    for _, _, name, words in sorted(queue):
        taken[name] += min(words, left)
        left -= min(words, left)
    return taken


@pytest.mark.parametrize("cut_rows, packet", [(100_000, 256), (1, 256), (1, 1), (20, 7)])
def test_mix_is_cut_by_the_global_order(spark, monkeypatch, cut_rows, packet):
    """Against a plain sort of all packets, also where the cut is narrowed down step by step and sources tie."""
    monkeypatch.setattr(mixing, "CUT_ROWS", cut_rows)
    monkeypatch.setattr(mixing, "TIME_RANGES", 2048 if cut_rows > 1 else 8)
    rng = random.Random(11)
    rows = [(k, rng.choice(["a", "b", "c", "d", None]), rng.choice([0, 1, 40, 300, 700])) for k in range(60)] + [(99, "e", 5000)]
    df = spark.createDataFrame([(k, "w " * size, s) for k, s, size in rows], "doc_id long, text string, source string").repartition(3)
    order = {r["doc_id"]: r["key"] for r in df.select("doc_id", F.md5(F.concat(F.lit("mix:"), F.col("doc_id").cast("string"))).alias("key")).collect()}
    want = plain_mix(sorted(rows, key=lambda r: order[r[0]]), packet)
    got = {r["doc_id"]: r["taken"] for r in mixing.per_document(mixing.mix(df, packet=packet)).collect()}
    assert got == {k: want[k] for k, _, _ in rows}


def test_rows_without_ids_spread_over_blocks(spark):
    df = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('text ', id) AS text", "'s' AS source")
    blocks = mixing.mix(df).select("slot.block").distinct().count()
    assert blocks == 256


def test_targets_by_rounds_of_resharing(spark):
    rng = random.Random(8)
    for _ in range(3):
        sizes = {f"s{k}": rng.choice([0, 1, 3, 10, 1000, 50_000]) for k in range(rng.randint(1, 9))} | {None: 70}
        names = sorted((s for s in sizes if s is not None)) + [None]
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
        while free:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            full = {s for s in free if share[s] >= 2 * sizes[s]}
            if not full:
                target |= share
                break
            for s in full:
                target[s] = 2.0 * sizes[s]
                left -= target[s]
            free -= full
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        assert all(abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]]) for r in got)


def test_mix_edge_cases(spark):
    schema = "doc_id long, text string, source string, size int, mix int"
    rows = [(None, "a b", None, 1, 1), (1, None, "x", 1, 1), (2, "", "x", 1, 1), (3, "c d e", "x", 1, 1), (3, "c d e", "x", 1, 1),
            (4, "w " * 30_000, "y", 1, 1)]
    df = spark.createDataFrame(rows, schema)
    per = mixing.per_document(mixing.mix(df)).collect()
    assert len(per) == 6 and all(r["taken"] <= 2 * r["size"] for r in per)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == ["doc_id", "text", "source", "size", "mix"]
    assert sum(r["mix"]["taken"] for r in mixed.collect()) == sum(r["taken"] for r in per)
    assert mixing.per_document(mixing.mix(df.limit(0))).count() == 0
    assert mixing.mixed_documents(df.limit(0)).count() == 0
