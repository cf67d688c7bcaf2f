"""Repeat removal against brute force over all strings."""

import hashlib
import random
import re
from collections import Counter

import pytest

from conftest import SF_ORACLE
from docpipe.llm import repeats
from docpipe.llm.queries import op5_repeats


def plain(texts, length):
    """Per text: bytes kept, removed, runs; by counting every string."""
    data = [(t or "").encode() for t in texts]
    count = Counter()
    for d in data:
        for s in range(len(d) - length + 1):
            count[d[s:s + length]] += 1
    out = []
    for d in data:
        covered = bytearray(len(d))
        s = 0
        for s in range(len(d) - length + 1):
            if count[d[s:s + length]] > 1:
                covered[s:s + length] = b"\1" * length
        kept = bytes(c for c, x in zip(d, covered) if not x)
        out.append((len(d), sum(covered), len([r for r in bytes(covered).split(b"\0") if r]), hashlib.sha256(kept).hexdigest()))
    return out


def got(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = repeats.remove_repeats(rows, **options)
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest())
            for r in sorted(out.collect(), key=lambda r: r["doc_id"])]


def test_whole_table_against_brute_force(spark):
    rows = sorted(spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text").collect())
    want = plain([r["text"] for r in rows], 400)
    out = sorted(op5_repeats(spark, SF_ORACLE).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r)[:5] for r in out] == [(r["doc_id"], *w) for r, w in zip(rows, want)]
    assert all(r["n_kept"] == r["n_bytes"] - r["n_removed"] for r in out)
    untouched = {r["doc_id"]: r["text"] for r in rows}
    assert all(r["text"] == untouched[r["doc_id"]] for r in out if not r["n_removed"])


@pytest.mark.parametrize("hot_rows", [1, 50_000])
def test_made_up_texts_at_a_small_length(spark, hot_rows):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    passages = ["".join(word() + " " for _ in range(rng.randint(8, 30))) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(word() for _ in range(rng.randint(1, 25)))
                 for _ in range(rng.randint(1, 5))]
        text = "".join(parts)
        if rng.random() < 0.3:                     # a near copy
            cut = rng.randrange(len(text))
            text = text[:cut] + "X" + text[cut + 1:]
        texts.append(text)
    texts += ["a" * 300, "a" * 41, "a" * 40, "ab" * 100, "ab" * 20, "ab" * 20 + "c", "xyz" * 30, "b" * 39, "", None, texts[0], texts[0], "\0" * 90]
    assert got(spark, texts, length=40, gram=8, hot_rows=hot_rows) == plain(texts, 40)


def test_parts_of_long_texts_and_batches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 256)
    monkeypatch.setattr(repeats, "BATCH_TEXTS", 8)
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh") for _ in range(700))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 900))) + shared[rng.randrange(300):][:rng.randint(0, 500)]
             + rng.choice("xyz") for _ in range(40)] + ["q" * 1500]
    assert got(spark, texts, length=50, gram=16) == plain(texts, 50)


def test_edge_cases(spark):
    rows = spark.createDataFrame([(None, "x" * 500, 1), (1, "x" * 500, 2), (2, None, 3)], "doc_id long, text string, n_bytes int")
    out = repeats.remove_repeats(rows)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    assert sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()) == [
        (0, 500, 500, 1, b""), (1, 500, 500, 1, b""), (2, 0, 0, 0, b"")]
    assert repeats.remove_repeats(rows.limit(0)).count() == 0


def plain_shared(texts, n):
    """Per text: words under runs of n words that another text holds too; by counting every run in every row."""
    split = [re.split(r"[\x20\x09-\x0D]+", (t or "").strip(" \t\n\v\f\r")) for t in texts]
    split = [[w for w in s if w] for s in split]
    runs = [{tuple(w[i:i + n]) for i in range(len(w) - n + 1)} for w in split]
    rows = Counter(r for of in runs for r in of)
    out = []
    for w in split:
        covered = [False] * len(w)
        for i in range(len(w) - n + 1):
            if rows[tuple(w[i:i + n])] > 1:
                covered[i:i + n] = [True] * n
        out.append(sum(covered))
    return out


def shared(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = repeats.remove_repeats(rows, **options).collect()
    assert len(out) == len(texts)
    return {r["doc_id"]: r["n_shared_words"] for r in out}, {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in out}


def test_planted_passages_of_over_50_words(spark):
    """A passage of 51 words and more is told in both documents, though most are under 400 bytes; clean documents are not."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9)))
    prose = lambda n: [word() for _ in range(n)]
    texts, want = [], []
    for i in range(60):
        passage = prose(51 + i % 30)
        for gap in (" ", "\n"):                    # the white space may differ, and so the bytes
            around = prose(rng.randint(0, 60)), prose(rng.randint(0, 60))
            texts.append(" ".join(around[0]) + "\t" + gap.join(passage) + gap + " ".join(around[1]))
            want.append(len(passage))
    own = " ".join(prose(60))
    texts += [" ".join(prose(200)) for _ in range(60)] + [own + " x " + own]                       # repeats nothing of others
    almost = prose(50)
    texts += [" ".join([*prose(9), *almost, *prose(9)]) for _ in range(2)]                         # 50 words are not over 50
    want += [0] * 63
    got_words, rest = shared(spark, texts, length=400, passage=51)
    assert [got_words[i] for i in range(len(texts))] == want == plain_shared(texts, 51)
    assert any(w and not rest[i][0] for i, w in enumerate(want))                                   # the 400 bytes do not tell them
    assert [(rest[i][0], hashlib.sha256(rest[i][1]).hexdigest()) for i in range(len(texts))] == [(r, k) for _, r, _, k in plain(texts, 400)]


@pytest.mark.parametrize("hot_rows", [1, 50_000])
def test_shared_words_against_every_run(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 512)
    monkeypatch.setattr(repeats, "BATCH_TEXTS", 16)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 3)))
    passages = [[word() for _ in range(rng.randint(10, 40))] for _ in range(6)]
    texts = []
    for _ in range(150):
        parts = [p[rng.randrange(8):] if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 25))]
                 for p in rng.choices(passages, k=rng.randint(1, 5))]
        texts.append("".join(w + rng.choice(["  ", " ", "\n", "\r\n", "\t", "  "]) for part in parts for w in part))
    texts += ["a " * 300, "a " * 12, "a " * 11, "ab " * 100, "a b " * 50, "é " * 30, "b" * 2000, " \n ", "", None, texts[0], texts[0],
              "a b c d e f g h i j k", "a b c d e f g h i j k", "a b c d e f g h i j k l", "\0 " * 90]
    got_words, rest = shared(spark, texts, length=40, gram=8, hot_rows=hot_rows, passage=12)
    assert [got_words[i] for i in range(len(texts))] == plain_shared(texts, 12)
    assert [(rest[i][0], hashlib.sha256(rest[i][1]).hexdigest()) for i in range(len(texts))] == [(r, k) for _, r, _, k in plain(texts, 40)]


def test_query_tells_shared_words(spark):
    rows = sorted(spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text").collect())
    out = sorted(op5_repeats(spark, SF_ORACLE).select("doc_id", "n_shared_words").collect())
    assert [tuple(r) for r in out] == [(r["doc_id"], n) for r, n in zip(rows, plain_shared([r["text"] for r in rows], 51))]
