"""Phrase collocations against brute force, with chunks and tiles small enough to split."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import SF_SMALL
from docpipe.llm import collocations as C

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, top=2000, longest=3):
    """(lang, text) rows -> result rows, by counting every phrase."""
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(" ".join(w[i:i + m]) for i in range(len(w) - m + 1))
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if a >= least and " " in p}
        scored = []
        for p, a in candidates.items():
            inside = [b for q, b in candidates.items() if len(q) > len(p) and f" {p} " in f" {q} "] if len(candidates) < 3000 else [
                b for q, b in candidates.items() if q.startswith(p + " ") or q.endswith(" " + p)]
            if any(100 * b >= 50 * a for b in inside):
                continue
            w = p.split(" ")
            score, k = min((10 ** 6 * a * a // (counts[" ".join(w[:k])] * counts[" ".join(w[k:])]), k) for k in range(1, len(w)))
            scored.append((-score, -a, p.encode(), counts[" ".join(w[:k])], counts[" ".join(w[k:])]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, text string, phrase string, n long").repartition(3)
    return sorted(tuple(r[c] for c in COLUMNS) for r in C.collocations(docs, **options).collect())


@pytest.mark.parametrize("options", [{}, {"chunk_tokens": 700, "tile_load": 300}])
def test_whole_table(spark, options):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("lang", "text")
    want = plain([tuple(r) for r in docs.collect()])
    assert sorted(tuple(r[c] for c in COLUMNS) for r in C.collocations(docs, **options).collect()) == want and want


def test_edge_cases_and_hot_phrases(spark):
    hot = "New York City is big. " * 40 + "a b\tc\x0bd  e; A B C? A b c\n" * 12
    rows = [("en", hot), ("en", hot), (None, "x y " * 15), ("und", "x y z " * 15), ("fr", None), ("fr", ""), ("de", "\x1c\x00 é\xa0é É É " * 11),
            ("de", "kein Satz"), ("en", "." * 500), ("en", "York " * 30)]
    rows = [(*r, "clash", 7) for r in rows]
    for options in ({}, {"chunk_tokens": 20, "tile_load": 25}, {"tile_load": 1}):
        assert got(spark, rows, **options) == plain([r[:2] for r in rows])
    assert got(spark, rows, max_words=4, min_count=5, top=7) == plain([r[:2] for r in rows], 5, 7, 4)
    assert got(spark, []) == []
    assert got(spark, [("en", None, "", 1)]) == []


def test_long_text_is_cut_between_pieces():
    text = b"\n".join(b"w%d x y" % (k % 50) for k in range(3000))
    whole, C.SLICE_BYTES = C.SLICE_BYTES, 100
    try:
        assert b"\n".join(C.slices(text)) == text and len(list(C.slices(text))) > 100
        assert list(C.slices(b"no mark at all " * 50)) == [b"no mark at all " * 50]
    finally:
        C.SLICE_BYTES = whole


def test_dense_and_sparse_tiles_agree():
    rng = np.random.default_rng(3)
    for high in (8, 1 << 31):
        codes = rng.integers(1, high, 500).astype(np.uint64) << C.HALF | rng.integers(0, 40, 500).astype(np.uint64)
        codes = np.concatenate((codes, codes[:100]))
        want = Counter(codes.tolist())
        code, count = C.summed(codes)
        assert dict(zip(code.tolist(), count.tolist())) == want and (np.diff(code.astype(object)) > 0).all()
        weights = rng.integers(1, 9, len(codes))
        code, count = C.summed(codes, weights)
        assert count.sum() == weights.sum() and code.tolist() == sorted(want)
    assert len(C.summed(np.empty(0, dtype=np.uint64))[0]) == 0


def test_scores_beyond_64_bits(spark):
    """10^6 * a * a passes 64 bits; decimals keep it exact."""
    sql = ("SELECT (1000000BD * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) "
           "AS score FROM VALUES (99999999999999L, 99999999999999L, 100000000000003L) AS t(a, l, r)")
    a, left, right = 99999999999999, 99999999999999, 100000000000003
    assert spark.sql(sql).first()[0] == 10 ** 6 * a * a // (left * right)
