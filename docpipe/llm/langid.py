"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language over all training texts: each task sums its partition
into one vector per language, and Spark adds the vectors up by slice. The log-probability
matrix (languages x buckets, a size set by the parameters) is broadcast and batches are
scored in numpy from sparse document-by-bucket counts.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import saved

#: Characters of one numpy round, which bounds memory whatever the batch.
CHUNK_CHARS = 1 << 20
#: Buckets of one shuffled slice of a count vector.
SLICE = 1 << 11
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point: is it a letter (made once per worker)."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)),
                                    dtype=bool, count=0x110000))
    return _letters[0]


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of the lower-cased texts, with the document each belongs to, in bounded chunks.

    Non-letters become one blank and a blank ends every document. A long text spans chunks
    that overlap by two characters, so that each trigram is counted once.
    """
    points, owners, held = [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = np.where(letter_table()[code], code, 32).astype(np.uint32)
        code = np.concatenate(([32], code, [32, 32])).astype(np.uint32)
        keep = np.ones(len(code), dtype=bool)
        keep[1:-1] = (code[1:-1] != 32) | (code[:-2] != 32)      # runs of blanks shrink to one
        code = code[keep]
        for at in range(0, len(code) - 2, CHUNK_CHARS):
            part = code[at:at + CHUNK_CHARS + 2]
            points.append(part)
            owners.append(np.full(len(part), row, dtype=np.int64))
            held += len(part)
            if held >= CHUNK_CHARS:
                yield np.concatenate(points), np.concatenate(owners)
                points, owners, held = [], [], 0
    if held:
        yield np.concatenate(points), np.concatenate(owners)


def grams(points: np.ndarray, owners: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigram and trigram buckets and the document of each; grams of blanks only are left out."""
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    a, b, c = points[:-2], points[1:-1], points[2:]
    inside = owners[:-2] == owners[2:]
    two = (a * MIX[0]) ^ (b * MIX[1])
    three = (two ^ (c * MIX[2])) * MIX[0]
    two = two * MIX[2]
    letter = inside & (a != 32) | inside & (b != 32)
    found = np.concatenate((two[letter] >> shift, three[letter] >> shift))
    return found.astype(np.int64), np.tile(owners[:-2][letter], 2)


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray = field(repr=False)          # buckets x languages
    log_prior: np.ndarray = field(repr=False)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 14,
          smoothing: float = 0.5, max_languages: int = 2000) -> Model:
    """Counts all n-grams of all given texts with a non-null label.

    A model of over ``max_languages`` labels (262 MB of log-probabilities by default) raises an
    error before any of it is counted: such a column does not hold languages.

    Rows of null text or label teach nothing; without any there are no languages and every
    prediction is ``und``. What reaches the driver is languages x buckets counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            for name in langs:
                docs[name] = docs.get(name, 0) + 1
            for points, owners in pieces(texts):
                found, rows = grams(points, owners, buckets)
                counts = np.bincount(code[rows] * buckets + found, minlength=len(names) * buckets).reshape(-1, buckets)
                for name, row in zip(names, counts):
                    if row.any():
                        sums[name] = sums[name] + row if name in sums else row
        out = [(name, -1, np.array([n], dtype=np.int64)) for name, n in docs.items()]
        out += [(name, k, row[k * SLICE:(k + 1) * SLICE]) for name, row in sums.items() for k in range(-(-buckets // SLICE))]
        yield pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()),
            pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["lang", "slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, k, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                row = np.array(counts, dtype=np.int64)
                sums[lang, k] = sums[lang, k] + row if (lang, k) in sums else row
        yield pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in sums], pa.string()), pa.array([x[1] for x in sums], pa.int32()),
            pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["lang", "slice", "counts"])

    schema = "lang string, slice int, counts array<long>"
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = rows.where("lang IS NOT NULL").select("lang").distinct().limit(max_languages + 1).count()
    if found > max_languages:
        raise ValueError(f"more than {max_languages} distinct labels in {lang_col}: too many for a language model")
    parts = rows.where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(run, schema)
    rows = saved(parts.repartition("lang", "slice").mapInArrow(add, schema)).collect()
    languages = sorted({r["lang"] for r in rows})
    counts, docs = np.zeros((buckets, len(languages))), np.zeros(len(languages))
    for r in rows:
        at = languages.index(r["lang"])
        if r["slice"] < 0:
            docs[at] += r["counts"][0]
        else:
            counts[r["slice"] * SLICE:r["slice"] * SLICE + len(r["counts"]), at] += r["counts"]
    log_prob = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * buckets))
    return Model(languages, log_prob, np.log((docs + 1) / (docs.sum() + len(languages))))


def predict(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` without its text column, with ``lang_pred`` and ``score`` (posterior of the prediction).

    A null text or one without a letter is ``und`` with score 0. Ties go to the first
    language by name. Repeated rows repeat; an empty table gives no rows; other columns are
    passed through (``lang_pred`` and ``score`` of the input are replaced).
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, np.ascontiguousarray(model.log_prob.T), model.log_prior))
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", text_col.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, log_prob, prior = sent.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            total = np.zeros((len(languages), len(texts)))
            seen = np.zeros(len(texts), dtype=bool)
            for points, owners in pieces(texts):
                seen[np.unique(owners[points != 32])] = True
                found, rows = grams(points, owners, log_prob.shape[1])
                for k in range(len(languages)):
                    total[k] += np.bincount(rows, weights=log_prob[k][found], minlength=len(texts))
            if languages:
                total += prior[:, None]
                best = total.argmax(axis=0)
                share = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
                names = [languages[b] if s else "und" for b, s in zip(best, seen)]
                scores = np.where(seen, share, 0.0)
            else:
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*kept, "lang_pred", "score"])

    rows = docs.select(*kept, F.col(text_col).alias("text_to_read"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}{', ' if schema else ''}lang_pred string, score double")


def identify(docs: DataFrame, trained_on: Column, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Trains on the rows for which ``trained_on`` holds and predicts every row."""
    model = train(docs.where(trained_on), text_col, lang_col, **options)
    return predict(docs, model, text_col)
