"""Benchmark decontamination with native DataFrame operators.

A window of an item's size is laid over a document wherever a word shingle of the item
stands in it, once so that the shingle falls on its place and once so that the window starts
at the shingle, which reaches reordered items too: no other window can reach the similarity
asked for. Windows and items get SimHash fingerprints of their shingles, and a multi-index
makes the pairs: fingerprints are cut into one block more than the radius, so those within it
have an equal block, and windows meet the items of their size by (block, value). The
distance is checked, and the exact weighted similarity of the shingles decides.

Matching shingles needs no shuffle while the benchmark's shingles are few (counted first);
a larger benchmark is joined by shingle hash. A document's text is shuffled only once, to
cut its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import bounded, saved, words
from docpipe.llm.linetemplates import content_key

#: Benchmarks of up to this many distinct shingles are broadcast as hashes.
MAX_BROADCAST_SHINGLES = 1_000_000
BITS = 64


def shingle_words(tokens: Column, size: Column) -> Column:
    """All shingles of ``size`` words, each a string, repeats included."""
    places = F.sequence(F.lit(1), F.size(tokens) - size + 1)
    return F.when(F.size(tokens) >= size, F.transform(places, lambda i: F.array_join(F.slice(tokens, i, size), " "))).otherwise(
        F.array().cast("array<string>"))


def simhash(shingles: Column) -> Column:
    """64-bit fingerprint: a bit is set if it is set in over half of the shingles' hashes."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    bit = lambda b: F.when(
        2 * F.size(F.filter(hashes, lambda h: F.shiftright(h, b).bitwiseAND(F.lit(1)) == 1)) > F.size(hashes),
        F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    out = bit(0)
    for b in range(1, BITS):
        out = out.bitwiseOR(bit(b))
    return out


def blocks(fp: Column, radius: int) -> Column:
    """The fingerprint cut into radius + 1 blocks, as an array of long."""
    cuts = [round(BITS * k / (radius + 1)) for k in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])])


def prepared_items(benchmark: DataFrame, item_col: str, text_col: str, shingle: int) -> DataFrame:
    """``item, n, size, shingles`` of the items that have words; equal rows count once."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.lower(F.col(text_col))).alias("w")).distinct()
    items = items.withColumn("n", F.size("w")).where("n > 0").withColumn("size", F.least("n", F.lit(shingle)))
    return items.select("item", "n", "size", shingle_words(F.col("w"), F.col("size")).alias("shingles"),
                        F.xxhash64("w").alias("variant"))


def starts_at_hits(least: float) -> Column:
    """Those of the sorted hits ``ats`` from which a window can reach ``least``.

    A window shares at most as many shingles as hits stand in it, so the last of the hits that
    ``least`` needs must stand in the window too. Any window of ``least`` can be moved right
    to its first hit (or to the text's end) without losing one, so none is missed.
    """
    n_item = F.col("n") - F.col("size") + 1
    n_window = F.least("n", "n_words") - F.col("size") + 1
    need = F.greatest(F.lit(1), F.ceil(least * (n_item + n_window) / (1 + least) - 1e-9).cast("int"))
    first = F.sequence(F.lit(1), F.size("ats") - need + 1)
    near = F.filter(first, lambda i: F.element_at("ats", i + need - 1) - F.element_at("ats", i) < n_window)
    return F.when(F.size("ats") >= need, F.transform(near, lambda i: F.element_at("ats", i))).otherwise(F.array().cast("array<int>"))


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 20) -> DataFrame:
    """``k1, k2, item, start, n, similarity``: the most similar window for each text and item that leaks into it.

    ``k1, k2`` is the text's content hash, ``start`` the window's first word (0-based; the
    first of equals). Words are lower-cased runs of non-blanks. The similarity is the sum of
    the smaller over the sum of the larger shingle counts, ``least`` or more. Items of fewer
    words than a shingle are one shingle as a whole; items and texts without words match
    nothing, nor do nulls; repeated rows and an empty table are no special case; a null item
    id is an item like others. Two items of one id count as one.
    """
    items = saved(prepared_items(benchmark, item_col, item_text_col, shingle))
    sizes = [r["size"] for r in items.select("size").distinct().collect()]     # at most `shingle` numbers
    places = saved(items.select("item", "variant", "n", "size", F.posexplode("shingles").alias("place", "s")).select(
        "item", "variant", "n", "size", "place", F.xxhash64("s").alias("h")))
    hashes = bounded(saved(places.select(F.col("h").alias("item_h"), F.col("size").alias("item_size")).distinct()),
                     MAX_BROADCAST_SHINGLES)

    texts = docs.where(F.col(text_col).isNotNull()).select(*content_key(F.col(text_col)), words(F.lower(F.col(text_col))).alias("w"))
    hits = None
    for size in sizes:
        at = texts.where(F.size("w") >= size).select("k1", "k2", "w", F.explode(F.sequence(F.lit(1), F.size("w") - (size - 1))).alias("at"))
        joined = F.element_at("w", F.col("at")) if size == 1 else F.concat_ws(
            " ", *[F.element_at("w", F.col("at") + j) for j in range(size)])
        at = at.select("k1", "k2", F.size("w").alias("n_words"), (F.col("at") - 1).alias("at"), F.xxhash64(joined).alias("h"))
        at = at.join(hashes, (F.col("h") == F.col("item_h")) & (F.col("item_size") == size), "left_semi").withColumn("size", F.lit(size))
        hits = at if hits is None else hits.union(at)
    if hits is None:
        hits = texts.where("false").select("k1", "k2", F.lit(0).alias("n_words"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("h"),
                                           F.lit(0).alias("size"))
    last = F.greatest(F.lit(0), F.col("n_words") - F.col("n"))
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("place"), last))
    met = hits.join(places, ["h", "size"]).groupBy("k1", "k2", "item", "variant", "n", "size", "n_words").agg(
        F.collect_set(start).alias("on_place"), F.sort_array(F.collect_set("at")).alias("ats"))
    starts = F.array_union("on_place", F.transform(starts_at_hits(least), lambda at: F.least(at, last)))
    laid = saved(met.select("k1", "k2", "n", "size", F.explode(starts).alias("start")).distinct())

    wanted = laid.groupBy("k1", "k2").agg(F.collect_list(F.struct("n", "size", "start")).alias("windows"))
    lean = docs.where(F.col(text_col).isNotNull()).select(*content_key(F.col(text_col)), F.col(text_col).alias("t"))
    # Copies of a text become one row in their own task, before the shuffle.
    once = lean.groupBy("k1", "k2").agg(F.first("t").alias("t"))
    cut = once.join(wanted, ["k1", "k2"]).select("k1", "k2", words(F.lower(F.col("t"))).alias("w"), "windows").select("k1", "k2", "w", F.explode("windows").alias("x"))
    cut = cut.select("k1", "k2", "x.*", F.slice("w", F.col("x.start") + 1, F.col("x.n")).alias("w"))
    cut = cut.select("k1", "k2", "n", "start", shingle_words(F.col("w"), F.col("size")).alias("shingles"))
    windows = saved(cut.withColumn("fp", simhash(F.col("shingles"))))

    def cells(fp: str, prefix: str) -> Column:
        return F.posexplode(blocks(F.col(fp), radius)).alias(f"{prefix}block", f"{prefix}value")

    indexed = items.select("item", "variant", F.col("n").alias("i_n"), F.size("shingles").alias("n_item"),
                           simhash(F.col("shingles")).alias("i_fp"))
    indexed = indexed.select("*", cells("i_fp", "i_"))
    # Equal fingerprints of one size are looked up once; a common one makes no more pairs.
    probe = windows.select("n", "fp").distinct().select("n", "fp", cells("fp", ""))
    near = probe.join(indexed, (F.col("n") == F.col("i_n")) & (F.col("block") == F.col("i_block")) & (F.col("value") == F.col("i_value"))
                      & (F.bit_count(F.col("fp").bitwiseXOR(F.col("i_fp"))) <= radius))
    near = saved(near.select("n", "fp", "item", "variant", "n_item").distinct())

    window = ["k1", "k2", "item", "variant", "start", "n"]
    verified = windows.join(near, ["n", "fp"])
    in_window = verified.select(*window, "n_item", F.size("shingles").alias("n_window"), F.explode("shingles").alias("s"))
    in_window = in_window.groupBy(*window, "n_item", "n_window", "s").agg(F.count("*").alias("c"))
    in_item = items.select("item", "variant", F.explode("shingles").alias("s")).groupBy("item", "variant", "s").agg(
        F.count("*").alias("c_item")).toDF("j_item", "j_variant", "j_s", "c_item")
    shared = in_window.join(in_item, F.col("item").eqNullSafe(F.col("j_item")) & (F.col("variant") == F.col("j_variant"))
                            & (F.col("s") == F.col("j_s"))).groupBy(*window, "n_item", "n_window").agg(
        F.sum(F.least("c", "c_item")).alias("both"))
    similarity = F.col("both") / (F.col("n_item") + F.col("n_window") - F.col("both"))
    best = F.struct(F.col("similarity"), (-F.col("start")).alias("from_start"), "n")
    return shared.withColumn("similarity", similarity).where(F.col("similarity") >= least).groupBy("k1", "k2", "item").agg(
        F.max(best).alias("b")).select("k1", "k2", "item", (-F.col("b.from_start")).alias("start"), "b.n", "b.similarity")


def leaking_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity`` for every row and item that leaks into it."""
    found = leaks(docs, benchmark, text_col, **options)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), *content_key(F.col(text_col)))
    return rows.join(found, ["k1", "k2"]).select(
        "doc_id", F.col("item").alias("item_id"), F.col("start").alias("start_word"), F.col("n").alias("n_words"), "similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, all columns kept."""
    found = leaks(docs, benchmark, text_col, **options).select(F.col("k1").alias("f1"), F.col("k2").alias("f2")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), *content_key(F.col(text_col)))
    return rows.join(saved(found), (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left_anti").select("doc.*")
