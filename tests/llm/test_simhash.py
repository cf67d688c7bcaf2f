"""Near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from conftest import SF_ORACLE, SF_SMALL
from docpipe.llm import simhash
from docpipe.llm.queries import op1_simhash_dedup

SCHEMA = "doc_id long, text string, fingerprint string"


def plain_fingerprint(text, shingle=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    values = np.array([f for _, f in fps], dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= radius) + i + 1:
            a, b = find(fps[i][0]), find(fps[j][0])
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d, _ in fps}


@pytest.mark.parametrize("data_dir", [SF_SMALL, SF_ORACLE])
def test_whole_table_against_brute_force(spark, data_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    fps = [(d, plain_fingerprint(t)) for d, t in sorted(texts.items())]
    want_root = plain_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op1_simhash_dedup(spark, data_dir).collect()}
    assert got == {d: (f"{f:016x}", want_root[d]) for d, f in fps}


def test_chains_and_hot_buckets_split_into_chunks(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 150:                       # a dense cloud: all share most index keys
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = sorted(int(np.uint64(f).view(np.int64)) for f in fps)
    want = plain_components([(f, f & (1 << 64) - 1) for f in signed])
    for size in (5, 10_000):
        links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket_rows=size)
        assert {r["node"]: r["root"] for r in simhash.components(links).collect()} == {
            f: r for f, r in want.items() if sum(x == r for x in want.values()) > 1}


def test_index_finds_every_pair_within_the_radius(spark):
    rng = random.Random(1)
    for radius in (2, 3, 4, 6):
        pairs = []
        for flips in range(0, radius + 1):
            for _ in range(150):
                a = rng.getrandbits(64)
                pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), flips))))
        rows = [(k, int(np.uint64(x).view(np.int64))) for k, p in enumerate(pairs) for x in p]
        df = spark.createDataFrame(rows, "pair int, fp long")
        keys = df.select("pair", simhash.F.explode(simhash.signatures(simhash.F.col("fp"), radius)).alias("k"))
        met = keys.groupBy("pair", "k").count().where("count > 1")
        assert met.select("pair").distinct().count() == len(pairs)


def test_index_keys_are_short_code_whatever_their_number(spark, capsys):
    """Keys written out one by one took hundreds of MB of the driver to compile."""
    fps = spark.range(10).select(simhash.F.col("id").alias("fp"))
    lengths = []
    for radius in (2, 4, 6):
        capsys.readouterr()
        fps.select("fp", simhash.F.explode(simhash.signatures(simhash.F.col("fp"), radius)).alias("key")).explain("codegen")
        code = [line for line in capsys.readouterr().out.splitlines() if line.startswith("/* ")]
        lengths.append(len(code))
    assert 0 < lengths[0] and max(lengths) < 1.2 * min(lengths), lengths


def test_the_keys_are_never_broadcast(spark):
    """The fingerprints' shuffle is small enough for a broadcast, but 143 keys of each are not."""
    near = [k << 40 | k for k in range(1, 500)]
    fps = spark.createDataFrame([(f ^ flip,) for f in near for flip in (0, 1)], "fp long")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in ("-1", "10m"):                     # by sizes as they turn out, and by the estimate too
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            links = simhash.near_links(fps)
            found = {(r["a"], r["b"]) for r in links.collect()}
            plan = links._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        linked = {x for pair in found for x in pair}
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
        assert linked == {f ^ flip for f in near for flip in (0, 1)}


def test_keys_are_equal_where_the_bits_under_their_mask_are(spark):
    rng = random.Random(3)
    masks = simhash.key_masks(4)
    assert len(masks) == len(set(masks)) == 143 and min(m.bit_count() for m in masks) == 29
    pairs = [(a := rng.getrandbits(64), a ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7)))) for _ in range(200)]
    rows = [(k, *(int(np.uint64(x).view(np.int64)) for x in p)) for k, p in enumerate(pairs)]
    df = spark.createDataFrame(rows, "pair int, a long, b long")
    for r in df.select("pair", *[simhash.signatures(simhash.F.col(c), 4).alias(f"of_{c}") for c in "ab"]).collect():
        a, b = pairs[r["pair"]]
        assert [x == y for x, y in zip(r["of_a"], r["of_b"], strict=True)] == [not (a ^ b) & m for m in masks]


def test_edge_cases(spark):
    long_text = " ".join(f"word{k % 977}" for k in range(150_000))
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n\t", None), (4, "one two", "z"), (5, "ONE  two", "z"), (None, "one two", "q"),
            (6, long_text, ""), (6, long_text, ""), (7, "été Été", "w")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in out)
    want = {d: plain_fingerprint(t) for d, t, _ in rows}
    assert got == sorted((d or -1, f"{want[d]:016x}", c) for (d, _, _), c in zip(rows, (1, 1, 1, 4, 4, 4, 6, 6, 7)))
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = simhash.one_per_group(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fingerprint"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6, 7]
    assert simhash.one_per_group(spark.createDataFrame([(None, "a b"), (None, "c d e")], "doc_id long, text string")).count() == 2
