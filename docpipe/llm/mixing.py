"""Mixing sources to target weights with weighted fair queueing (native DataFrame operators).

Every source is a queue of documents in a keyed random order that may be served up to
``max_repeats`` times. Service goes in packets of at most ``packet`` words, so a long document
holds up no other source. A packet's virtual finish time is the number of words that its source
has served when the packet ends, divided by the source's weight. All packets of all sources,
sorted by virtual finish time, are the mix, and it is cut where the running total of words
reaches the budget: the cut alone decides what is taken. A source that has served all its
repeats has no more packets, so the others share the rest by weight.

Running totals never gather a source or the whole sequence in one task. A source is split into
blocks by the leading digits of the shuffle key, block totals give each block its offset,
and the window runs inside one block. The cut is narrowed down by totals over ranges of virtual
time; only the packets of the last narrow range are put in order one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docpipe.llm.common import bounded, saved, words

#: Virtual time is cut into this many ranges for the global order, and for each step that narrows the cut.
TIME_RANGES = 2048
#: Packets of the last range around the cut that are put in order one by one, ties apart.
CUT_ROWS = 100_000
#: Source tables of up to this many rows are broadcast.
MAX_BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget_share: float = 1.5,
                   max_repeats: int = 2) -> DataFrame:
    """Target words per source.

    ``sizes`` has ``source`` and ``size``. Sources sorted by code point, null last, take the
    weights in turn. The budget is ``budget_share`` of all words; a target stops at
    ``max_repeats`` times its source's size and what it leaves goes to the others by weight.
    Sorted by size per weight, source i is full exactly when the share left for it, with all
    earlier ones full, reaches its cap, so one running sum replaces the rounds of resharing.
    Returns ``source, source_rank, source_size, weight, target``; empty input: no rows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("source_rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", max_repeats * F.col("source_size"))
    everything = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("weight"), "source_rank").rowsBetween(W.unboundedPreceding, -1)
    budget = budget_share * F.sum("source_size").over(everything).cast("double")
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("level", left / weight_left)
    full = F.col("level") * F.col("weight") >= F.col("cap")
    final = F.max(F.when(~full, F.col("level"))).over(everything)
    target = F.when(full, F.col("cap").cast("double")).otherwise(final * F.col("weight"))
    return level.select("source", "source_rank", "source_size", "weight", target.alias("target"))


def packets_of(copies: DataFrame, packet: int) -> DataFrame:
    """The packets of each copy: its columns, ``packet_words`` and ``packet_finish``."""
    count = F.ceil(F.col("size") / packet).cast("int")
    split = copies.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("packet"))
    end = F.least((F.col("packet") + 1).cast("long") * packet, F.col("size"))
    return split.withColumn("packet_words", end - F.col("packet").cast("long") * packet).withColumn(
        "packet_finish", (F.col("served") + end) / F.col("weight"))


def cut_range(copies: DataFrame, budget: int, horizon: float, packet: int) -> tuple[float, float, int]:
    """Virtual times lo and hi, and the words of the budget that are left at lo, such that the cut lies from lo to before hi.

    Each step adds up the packets by ``TIME_RANGES`` ranges (that many totals reach the driver)
    and goes on inside the range in which the running total reaches the budget, until few
    packets are in it or all of them end at one time.
    """
    lo, hi, left = 0.0, math.inf, budget
    step = horizon / (TIME_RANGES // 2)                          # the first ranges reach to twice the expected cut
    near = copies
    while True:
        cell = F.least(F.floor((F.col("packet_finish") - lo) / step), F.lit(TIME_RANGES)).cast("int")
        inside = packets_of(near, packet).where((F.col("packet_finish") >= lo) & (F.col("packet_finish") < hi))
        totals = inside.groupBy(cell.alias("cell")).agg(
            F.sum("packet_words").alias("words"), F.count("*").alias("rows"), F.min("packet_finish").alias("first"),
            F.max("packet_finish").alias("last"))
        rows = sorted(totals.collect(), key=lambda r: r["cell"])
        for k, row in enumerate(rows):
            if row["words"] >= left:
                break
            left -= row["words"]
        else:
            return math.inf, math.inf, left                     # the budget outlasts all packets
        lo, hi = row["first"], rows[k + 1]["first"] if k + 1 < len(rows) else hi
        if row["rows"] <= CUT_ROWS or row["first"] == row["last"]:
            return lo, hi, left
        step = (row["last"] - row["first"]) / (TIME_RANGES - 1)
        near = in_service(copies, lo, hi)


def in_service(copies: DataFrame, lo: float, hi: float) -> DataFrame:
    """Copies that may have a packet that ends from lo to before hi."""
    return copies.where((F.col("copy_finish") >= lo) & (F.col("served") / F.col("weight") < hi))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), budget_share: float = 1.5, max_repeats: int = 2,
        seed: str = "mix", block_digits: int = 2, packet: int = 256) -> DataFrame:
    """One row per document and copy, in the order of the mix.

    Columns: ``slot`` (struct that names the input row), ``doc_id``, ``content`` (hash of the
    text), ``size`` (words of the text; null text: 0), ``source``, ``source_size``, ``target`` (of the
    source: what its weight gives it, from which the mix is off by the packets in service at
    the cut), ``copy`` (0-based), ``taken`` (words of this copy in the mix, 0 if it is not part
    of it), ``finish`` (virtual time at which the copy's taken words end; null if none are
    taken), ``mix_end`` (words of the mix up to and with this copy, in the order of finish).

    ``block_digits`` hex digits of the shuffle key split a source into blocks; a document
    without an id takes its place by its text. Null sources form one source, null ids are
    documents like others, repeated rows are separate documents, an empty table gives no
    rows; only the named columns are read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.size(words(F.col(text_col))).cast("long").alias("size"),
                       F.xxhash64(F.col(text_col)).alias("content"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("no id:"), F.col("content").cast("string")))
    base = saved(base.withColumn("order_key", F.md5(F.concat(F.lit(seed + ":"), key)))
                 .withColumn("block", F.substring("order_key", 1, block_digits)))
    targets = saved(source_targets(base, weights, budget_share, max_repeats))
    total = targets.agg(F.sum("source_size").alias("all"), F.max(F.col("target") / F.col("weight")).alias("horizon")).first()
    targets = bounded(targets, MAX_BROADCAST_SOURCES)
    rows = base.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        "b.doc_id", "b.content", "b.source", "b.size", "b.order_key", "b.block", "t.source_rank", "t.source_size", "t.weight", "t.target")

    block_offset = F.coalesce(F.sum("block_size").over(
        W.partitionBy("source_rank").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy("source_rank", "block").agg(F.sum("size").alias("block_size")).select(
        "source_rank", "block", block_offset.alias("block_offset"))
    in_block = W.partitionBy("source_rank", "block").orderBy("order_key", "doc_id", "size", "content")
    queue = rows.join(blocks, ["source_rank", "block"]).withColumn("n", F.row_number().over(in_block)).withColumn(
        "start", F.col("block_offset") + F.sum("size").over(in_block.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    copies = queue.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("copy"))
    copies = copies.withColumn("served", F.col("copy") * F.col("source_size") + F.col("start"))
    copies = saved(copies.withColumn("copy_finish", (F.col("served") + F.col("size")) / F.col("weight")).drop("order_key", "start"))

    budget = math.floor(budget_share * (total["all"] or 0))
    lo, hi, left = cut_range(copies, budget, total["horizon"] or 1.0, packet) if budget else (0.0, 0.0, 0)
    # whole copies end before the cut's range; of those in service there the running total decides
    ordered = W.orderBy("packet_finish", "source_rank").rowsBetween(W.unboundedPreceding, 0)
    last = packets_of(in_service(copies, lo, hi), packet)
    before = last.where(F.col("packet_finish") < lo).withColumn("taken", F.col("packet_words"))
    around = last.where((F.col("packet_finish") >= lo) & (F.col("packet_finish") < hi)).withColumn("end", F.sum("packet_words").over(ordered))
    around = around.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least(
        F.col("packet_words"), F.lit(left) - F.col("end") + F.col("packet_words")))).drop("end")
    named = ["source_rank", "block", "n", "copy"]
    part = before.unionByName(around).groupBy(*named).agg(F.sum("taken").alias("part"))
    taken = F.when(F.col("copy_finish") < lo, F.col("size")).otherwise(F.coalesce("part", F.lit(0).cast("long")))
    copies = copies.join(part, named, "left").withColumn("taken", taken)
    finish = F.when(F.col("taken") > 0, (F.col("served") + F.col("taken")) / F.col("weight"))
    copies = copies.withColumn("finish", finish).withColumn(
        "range", F.floor(F.col("finish") / (total["horizon"] or 1.0) * TIME_RANGES).cast("int"))

    range_offset = F.coalesce(F.sum("range_words").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = copies.where("taken > 0").groupBy("range").agg(F.sum("taken").alias("range_words")).select(
        F.col("range"), range_offset.alias("range_offset"))
    ranges = bounded(saved(ranges), 2 * TIME_RANGES)
    in_range = W.partitionBy("range", F.when(F.col("range").isNull(), F.col("block"))).orderBy(
        "finish", "source_rank", "block", "n", "copy")
    ordered = copies.join(ranges, "range", "left").withColumn(
        "mix_end", F.col("range_offset") + F.sum("taken").over(in_range.rowsBetween(W.unboundedPreceding, 0)))
    slot = F.struct("source_rank", "block", "n").alias("slot")
    return ordered.select(slot, "doc_id", "content", "size", "source", "source_size", "target", "copy", "taken",
                          "finish", "mix_end")


def per_document(copies: DataFrame) -> DataFrame:
    """The mix summed over the copies of each document: one row per input row."""
    return copies.groupBy("slot").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.sum("taken").alias("taken")).drop("slot")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix with all their columns: one row per copy of which words are taken.

    Adds ``mix`` (struct of ``copy``, ``size``, ``target``, ``taken``, ``finish``,
    ``mix_end``); a column of that name in ``docs`` is replaced. Rows that agree in id and
    text are one document here: it appears once per copy number with the words taken of all.
    The text is shuffled once, by id and content hash.
    """
    copies = mix(docs, id_col=id_col, text_col=text_col, **options).where("taken > 0")
    plan = copies.groupBy("doc_id", "content", "copy").agg(
        F.first("size").alias("size"), F.first("target").alias("target"), F.sum("taken").alias("taken"),
        F.min("finish").alias("finish"), F.min("mix_end").alias("mix_end"))
    plan = plan.select(F.col("doc_id").alias("plan_id"), F.col("content").alias("plan_content"),
                       F.struct("copy", "size", "target", "taken", "finish", "mix_end").alias("plan_mix"))
    keyed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("key_id"), F.xxhash64(F.col(text_col)).alias("key_content"))
    same = W.partitionBy("key_id", "key_content").orderBy("key_content")
    keyed = keyed.withColumn("nth", F.row_number().over(same)).where("nth = 1")
    joined = keyed.join(plan, F.col("key_id").eqNullSafe(F.col("plan_id")) & (F.col("key_content") == F.col("plan_content")))
    others = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() != "mix"]
    return joined.select(*others, F.col("plan_mix").alias("mix"))
