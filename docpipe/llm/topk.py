"""Exact top-k search by inner product without random access.

Vectors are dealt into shards; inside a shard every component has a list of all vectors
sorted by value. The lists are read from the end that a query's coefficient favours,
equally deep in all of them. A vector's score is bounded from below and above by what has
been read of it and, for the rest, by the worst value of a list and the value at which
reading stands. A query is done when no vector outside its candidates can reach the k-th
best lower bound; the candidates' scores are then resolved to the end. The best k of all
shards are merged by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shares of the lists read before the bounds are compared, the last one everything.
DEPTHS = (0.25, 0.5, 0.75, 1.0)


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) per component as array of long; null if the vector cannot take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), ints)


def shard_topk(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple]:
    """The k best vectors of one shard for every query: (query's place, ids, scores)."""
    n = len(ids)
    order = np.sort(x, axis=0)                                   # the lists, ascending
    rank = np.empty(x.shape, dtype=np.int64)                     # a vector's place in each list
    np.put_along_axis(rank, np.argsort(x, axis=0, kind="stable"), np.arange(n)[:, None], axis=0)
    low, high = order[0], order[-1]
    up, down = np.maximum(q, 0).T, np.minimum(q, 0).T            # coefficients that favour large / small values
    open_queries = np.arange(len(query_ids))
    for share in DEPTHS:
        depth = max(min(n, k), math.ceil(share * n))
        from_top, from_bottom = rank >= n - depth, rank < depth  # what has been read of each list
        top = np.where(from_top, x, low)                         # unread: not below the list's last value
        bottom = np.where(from_bottom, x, high)
        lower = top @ up[:, open_queries] + bottom @ down[:, open_queries]
        if depth < n:
            top = np.where(from_top, x, order[n - depth])        # unread: not above where reading stands
            bottom = np.where(from_bottom, x, order[depth - 1])
            upper = top @ up[:, open_queries] + bottom @ down[:, open_queries]
        else:
            upper = lower
        own = ids[:, None] == query_ids[open_queries][None, :]
        lower[own] = -np.inf
        upper[own] = -np.inf
        kth = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(open_queries), -np.inf)
        candidate = (upper >= kth) & ~own
        done = (candidate.sum(axis=0) <= k) if depth < n else np.ones(len(open_queries), dtype=bool)
        for j in np.flatnonzero(done):
            rows = np.flatnonzero(candidate[:, j])
            scores = x[rows] @ q[open_queries[j]]                # read the candidates' lists to the end
            best = np.lexsort((ids[rows], -scores))[:k]
            yield open_queries[j], ids[rows[best]], scores[best]
        open_queries = open_queries[~done]
        if not len(open_queries):
            return


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
         scale: int = 1024, shard_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """The k vectors of highest integer inner product for each row of ``queries``.

    Both frames have ``id_col`` and ``vector_col``; a query does not find rows with its own
    id. Vectors meet queries of the same number of components only. Returns ``query_id``,
    ``rank`` (from 1; ties go to the smaller id), ``vec_id``, ``score``; fewer than k rows if
    there are fewer candidates. Null ids, null or empty vectors and vectors with null, NaN or
    infinite components take no part; repeated rows are separate candidates; a repeated query
    row is no further query, but each distinct vector of a query id is one, with ranks of
    its own; empty tables give no rows.

    Vectors go to shards of about ``shard_rows`` and queries to blocks of about
    ``query_rows`` by hash, and each (shard, block) is one task's work, so a task's memory
    does not grow with the input. Products are exact while below 2^53.
    """
    def prepared(df: DataFrame) -> DataFrame:
        out = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"))
        return out.where("id IS NOT NULL AND v IS NOT NULL").withColumn("dim", F.size("v"))

    base, asked = prepared(vectors), prepared(queries).dropDuplicates(["id", "v"]).withColumn("which", F.xxhash64("v"))
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / query_rows))
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    # every row of a hot vector has its own id, so shards fill evenly
    left = base.withColumn("shard", part(shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", part(blocks, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(x) and len(q):
            found = list(shard_topk(x["id"].to_numpy(), np.stack(x["v"].to_numpy()).astype(np.float64),
                                    q["id"].to_numpy(), np.stack(q["v"].to_numpy()).astype(np.float64), k))
        place = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
        return pd.DataFrame({
            "query_id": q["id"].to_numpy()[place].astype(np.int64), "which": q["which"].to_numpy()[place].astype(np.int64),
            "vec_id": np.concatenate([f[1] for f in found] or [np.empty(0)]).astype(np.int64),
            "score": np.concatenate([f[2] for f in found] or [np.empty(0)]).astype(np.int64)})

    local = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInPandas(
        search, "query_id long, which long, vec_id long, score long")
    best = W.partitionBy("query_id", "which").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
