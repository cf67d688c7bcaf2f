"""Language ID and quality: held-out accuracy, contracts and edge cases."""

import zlib

from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL
from docpipe.llm import langid, quality
from docpipe.llm.queries import op2_quality, op4_language


def test_language_held_out(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect()}
    out = op4_language(spark, SF_ORACLE).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)


def test_language_scores_by_hand(spark):
    """A tiny model against naive Bayes over the same grams, counted in plain Python."""
    import math
    from collections import Counter
    rows = [(1, "abc abd", "x"), (2, "xyz", "y"), (3, None, "x"), (4, "ab", None), (5, "123 !", "y"), (6, "", "y")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=1 << 14)
    assert model.languages == ["x", "y"]

    def count(text):
        found = Counter()
        for points, owners in langid.pieces([text]):
            found.update(langid.grams(points, owners, 1 << 14)[0].tolist())
        return found
    counts = {"x": count("abc abd"), "y": count("xyz")}
    logs = {k: {g: math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * (1 << 14))) for g in count("abc")} for k, c in counts.items()}
    want = {k: math.log((n + 1) / 6) + sum(n2 * logs[k][g] for g, n2 in count("abc").items()) for k, n in (("x", 1), ("y", 3))}
    got = langid.predict(spark.createDataFrame([(9, "ABC")], "doc_id long, text string"), model).first()
    assert got["lang_pred"] == "x"
    assert abs(got["score"] - 1 / (1 + math.exp(want["y"] - want["x"]))) < 1e-9


def test_language_edge_cases(spark):
    schema = "doc_id long, text string, lang string, score string"
    long_text = "le chat dort " * 100_000
    rows = [(1, None, "fr", "s"), (2, "12 %", "fr", "s"), (None, "der hund", "de", "s"), (3, long_text, "fr", "s"), (3, long_text, "fr", "s")]
    df = spark.createDataFrame(rows, schema)
    out = langid.identify(df, F.lit(True))
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"] >= 0.5) for r in out.collect())
    assert got == [(0, "de", True), (1, "und", False), (2, "und", False), (3, "fr", True), (3, "fr", True)]
    assert langid.identify(df.limit(0), F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, F.lit(False)).collect()} == {"und"}


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()}
    out = op2_quality(spark, SF_ORACLE).collect()
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.93 * len(held)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good words here", "s"), (2, None, "s"), (3, "", "s"), (None, "bad!!", "s"), (1, "good words here", "s")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (77, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.accepted(docs, model).columns == docs.columns
    without = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, without).collect()} == {0.5}
    assert quality.accepted(docs, without).count() == 5
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def test_word_vectors_count_the_whole_corpus(spark):
    """Word vectors do not depend on how the corpus is dealt out."""
    import numpy as np
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert np.allclose(quality.word_vectors(docs.repartition(1)), quality.word_vectors(docs.repartition(7)))


def test_quality_pairs_words_across_pieces(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(3)
    long_text = " ".join(f"w{k}" for k in rng.integers(0, 3000, 2 * quality.CHUNK_TOKENS + 9))
    texts = ["one two three", long_text, "", None, "four five"]
    size, cache = quality.Size(), quality.Buckets(quality.Size().buckets)
    place, sign = quality.index_vectors(size)
    want = np.zeros((size.buckets, size.dims))
    for text in texts:
        ids = np.array([cache[t] for t in quality.TOKEN.findall(text or "")], dtype=np.int64)
        for step in range(1, size.window + 1):
            for word, near in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
                for k in range(size.marks):
                    np.add.at(want, (word, place[near, k]), sign[near, k])
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    vectors = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(vectors, want / np.where(norm > 0, norm, 1), rtol=0, atol=1e-7)
    short = [" ".join(long_text.split()[:50]), "one two", None, " ".join(long_text.split()[60:75])]
    whole = quality.pooled(short, vectors, cache)
    for chunk in (1, 2, 7, 25):
        monkeypatch.setattr(quality, "CHUNK_TOKENS", chunk)
        assert np.allclose(quality.pooled(short, vectors, cache), whole)
