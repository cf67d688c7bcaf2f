"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing: a word bucket's index vector is a fixed sparse vector of +1 and -1, and its
word vector is the sum of the index vectors of its neighbours over the whole corpus. Each
task sums its partition; Spark adds the sums slice by slice. A document is pooled from its
words' unit vectors (mean, mean of squares, likeness of neighbouring words, length), and a
two-layer numpy network, fitted on a bounded sample of labelled rows, scores it. A
temperature fitted on rows that the network was not trained on calibrates the probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import crc32_mod, saved

#: Runs of letters and digits, runs of other marks.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Tokens of one numpy round, which bounds memory whatever the batch.
CHUNK_TOKENS = 1 << 17
#: Word buckets of one shuffled slice of the sums.
SLICE = 1 << 9


@dataclass(frozen=True)
class Size:
    """Sizes of the model; all are independent of the corpus."""
    buckets: int = 1 << 14
    dims: int = 32
    marks: int = 4            # non-zero components of an index vector
    window: int = 2           # neighbours to each side
    hidden: int = 32
    max_labelled: int = 20_000  # labelled rows that the network is fitted on


def index_vectors(size: Size) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of each bucket's index vector."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, size.dims, (size.buckets, size.marks)), rng.choice((-1, 1), (size.buckets, size.marks)).astype(np.int8)


class Buckets(dict):
    """Token to bucket, remembered."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = found = zlib.crc32(token.encode("utf-8", "surrogatepass")) % self.n
        return found


def pieces(texts: list[str | None], buckets: Buckets, window: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Token buckets and the row each belongs to, in bounded pieces, and how many tokens are carried.

    A piece that goes on inside a text begins with the ``window`` tokens before it, which serve
    as left neighbours only; without those carried tokens the pieces hold every token once.
    """
    ids, owners, held, carried = [], [], 0, 0
    for row, text in enumerate(texts):
        tokens = np.array(list(map(buckets.__getitem__, TOKEN.findall(text or ""))), dtype=np.int64)
        for at in range(0, len(tokens), CHUNK_TOKENS):
            first = max(0, at - window)
            part = tokens[first:at + CHUNK_TOKENS]
            ids.append(part)
            owners.append(np.full(len(part), row, dtype=np.int64))
            if at:      # the text's tokens before this part have ended a piece, so it begins one
                carried = at - first
            held += len(part) - (at - first)
            if held >= CHUNK_TOKENS:
                yield np.concatenate(ids), np.concatenate(owners), carried
                ids, owners, held, carried = [], [], 0, 0
    if held:
        yield np.concatenate(ids), np.concatenate(owners), carried


def word_vectors(docs: DataFrame, text_col: str = "text", size: Size = Size()) -> np.ndarray:
    """Unit word vectors (buckets x dims) from all texts of ``docs``; unseen words are zero.

    What is shuffled is one matrix per task, what reaches the driver is one matrix.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(size)
        sums, cache = np.zeros(size.buckets * size.dims), Buckets(size.buckets)
        for batch in batches:
            for ids, owners, carried in pieces(batch.column(0).to_pylist(), cache, size.window):
                for step in range(1, size.window + 1):
                    same = owners[step:] == owners[:-step]
                    same[:max(0, carried - step)] = False       # both carried: paired in the piece before
                    left, right = ids[:-step][same], ids[step:][same]
                    for word, near in ((left, right), (right, left)):
                        for k in range(size.marks):
                            sums += np.bincount(word * size.dims + place[near, k], weights=sign[near, k],
                                                minlength=size.buckets * size.dims)
        sums = sums.astype(np.int64).reshape(-1, SLICE * size.dims)
        used = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([sums[k] for k in used], pa.list_(pa.int64()))],
                                         names=["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for k, row in zip(batch.column(0).to_pylist(), flat):
                sums[k] = sums[k] + row if k in sums else row
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))],
                                         names=["slice", "sums"])

    schema = "slice int, sums array<long>"
    parts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(run, schema)
    total = np.zeros((size.buckets // SLICE, SLICE * size.dims))
    for r in saved(parts.repartition("slice").mapInArrow(add, schema)).collect():
        total[r["slice"]] += r["sums"]
    total = total.reshape(size.buckets, size.dims)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray, cache: Buckets) -> np.ndarray:
    """Features of each text; an empty or null text has zeros."""
    n, d = len(texts), vectors.shape[1]
    total, squares, near, count = np.zeros((n, d)), np.zeros((n, d)), np.zeros(n), np.zeros(n)
    for ids, owners, carried in pieces(texts, cache):
        v = vectors[ids]
        likeness = np.einsum("ij,ij->i", v[1:], v[:-1]) * (owners[1:] == owners[:-1])
        near += np.bincount(owners[1:], weights=likeness, minlength=n)
        v, owners = v[carried:], owners[carried:]
        start = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
        rows = owners[start]
        total[rows] += np.add.reduceat(v, start, axis=0)
        squares[rows] += np.add.reduceat(v * v, start, axis=0)
        count += np.bincount(owners, minlength=n)
    some = np.maximum(count, 1)[:, None]
    mean = total / some
    return np.hstack((mean, squares / some, near[:, None] / some, np.linalg.norm(mean, axis=1, keepdims=True),
                      np.log1p(count)[:, None])).astype(np.float64)


@dataclass
class Model:
    size: Size
    vectors: np.ndarray = field(repr=False)
    layers: tuple | None = field(repr=False)      # None: no labelled row of either kind
    temperature: float = 1.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(logits(self.layers, x) / self.temperature, -50, 50)))


def logits(layers: tuple, x: np.ndarray) -> np.ndarray:
    mean, scale, w1, b1, w2, b2 = layers
    return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2


def fit(x: np.ndarray, y: np.ndarray, hidden: int, rounds: int = 40, batch: int = 128, seed: int = 7) -> tuple[tuple, float]:
    """Two-layer network by Adam on four fifths of the rows, temperature on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    rest, own = order[:len(x) // 5], order[len(x) // 5:]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    z = (x - mean) / scale
    for _ in range(rounds):
        for at in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            h = np.tanh(z[at] @ w[0] + w[1])
            err = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[at]) / len(at)
            back = np.outer(err, w[2]) * (1 - h * h)
            slopes = [z[at].T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ err + 1e-4 * w[2], err.sum()]
            t += 1
            for k, g in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    layers = (mean, scale, *w)
    raw, truth = logits(layers, x[rest]), y[rest]
    grid = np.exp(np.linspace(np.log(0.25), np.log(16), 97))
    loss = [np.mean(np.logaddexp(0, np.where(truth > 0, -raw, raw) / g)) for g in grid]
    return layers, float(grid[int(np.argmin(loss))]) if len(rest) else 1.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          size: Size = Size()) -> Model:
    """Word vectors from all of ``docs``; the network from the given ``labels`` (0/1, null: unused).

    Of the labelled ids the ``size.max_labelled`` of smallest hash are used, a bounded
    sample; an id labelled twice counts with its larger label, an id on several rows of
    ``docs`` with one of its texts.
    """
    vectors = word_vectors(docs, text_col, size)
    sample = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label"))
    sample = sample.where("label_id IS NOT NULL AND label IS NOT NULL").groupBy("label_id").agg(F.max("label").alias("label"))
    sample = saved(sample.orderBy(F.xxhash64("label_id"), "label_id").limit(size.max_labelled))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Buckets(size.buckets)
        for batch in batches:
            x = pooled(batch.column(2).to_pylist(), sent.value, cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))],
                                             names=["label_id", "label", "x"])

    # An id that stands on several rows teaches once, by its text of least hash: the sample is bounded by rows, not ids.
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(sample.select("label_id")), "label_id", "left_semi").groupBy("label_id").agg(
        F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"))
    rows = texts.join(F.broadcast(sample), "label_id").select("label_id", "label", "text").mapInArrow(
        run, "label_id long, label int, x array<double>").toPandas().sort_values("label_id", kind="stable")
    if rows["label"].nunique() < 2:
        return Model(size, vectors, None)
    layers, temperature = fit(np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(dtype=np.float64), size.hidden)
    return Model(size, vectors, layers, temperature)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, content, score`` for every row: the calibrated probability of label 1.

    Empty and null texts have a score too (of no words); without usable labels every score is
    0.5. Repeated rows repeat, an empty table gives no rows, only the two columns are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        cache = Buckets(model.size.buckets)
        for batch in batches:
            found = model.probability(pooled(batch.column(2).to_pylist(), model.vectors, cache))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())],
                                             names=["doc_id", "content", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("content"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, content long, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns kept; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        model = sent.value
        return pd.Series(model.probability(pooled(texts.tolist(), model.vectors, Buckets(model.size.buckets))))

    return docs.where(probability(F.col(text_col).cast("string")) >= least)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are kept for measuring."""
    return F.coalesce(crc32_mod(F.col(id_col), 5) == 0, F.lit(False))
