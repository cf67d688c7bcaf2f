"""The prefix trie of conversations, built as a distributed burst trie.

A conversation is a sequence of turn ids (128-bit hashes of role and text), laid end to end
in one binary value. Equal sequences are one row with their number and smallest conversation.
At first all sequences lie in one container under the root. In every round a container of
too many sequences bursts: its top becomes a trie head, and each sequence moves on to the
container of its next turn id. What remains is small: every container is sorted and swept
into nodes by one task. The heads' own sums come from the containers and heads below them.

Copies never fill a container, since they are one row; a first turn that a third of all
conversations share is a head whose sequences lie in the containers of their second turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docpipe.llm.common import bounded, saved

#: Bytes of a turn id.
ID = 16
#: Trie heads of one round, and of all, that are broadcast; more are joined.
MAX_BROADCAST_HEADS = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ("head string, top boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends string, heads array<string>")


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """``conv_id, ids, chars``: the turn ids of every conversation and the code points of each turn's text.

    Turns sort by number (null first), then role and text, so ties and repeated rows have one
    result; null roles and texts are empty; rows of a null conversation id belong to none.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    named = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    rows = rows.select("conv_id", F.row_number().over(order).alias("at"), named.alias("id"), F.length("text").alias("chars"))
    t = F.sort_array(F.collect_list(F.struct("at", "id", "chars")))
    whole = rows.groupBy("conv_id").agg(t.alias("t"))
    return whole.select("conv_id", F.unhex(F.array_join("t.id", "")).alias("ids"), F.col("t.chars").alias("chars"))


def with_common_starts(convs: DataFrame, group: int = 100, turns: int = 6) -> DataFrame:
    """The rebuilt conversations: the first h turns of conversation c - c % ``group``, then c's own after its first h.

    h is the unsigned crc32 of c in decimal, modulo ``turns``; c % group has the sign of c.
    """
    starts = convs.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.substring("ids", 1, ID * (turns - 1)).alias("start_ids"),
        F.slice("chars", 1, turns - 1).alias("start_chars"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % turns).cast("int")
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h)
    joined = own.join(starts, "base", "left")
    ids = F.concat(F.coalesce(F.substring(F.col("start_ids"), F.lit(1), F.col("h") * ID), F.lit(b"")),
                   F.substring(F.col("ids"), F.col("h") * ID + 1, F.octet_length("ids")))
    chars = F.concat(F.coalesce(F.slice("start_chars", F.lit(1), F.col("h")), F.array().cast("array<int>")),
                     F.slice("chars", F.col("h") + 1, F.greatest(F.lit(0), F.size("chars"))))
    return joined.select("conv_id", ids.alias("ids"), chars.alias("chars"))


def end_digests(members: DataFrame) -> DataFrame:
    """``ends, ends_sha256``: the digest of the ascending, comma-joined ids of each sequence (rows ``ends, conv_id``).

    Ranges of the sorted rows are joined in parts; a digest reads the parts in order, so a
    sequence of any number of copies takes a part's memory.
    """
    cut = members.repartitionByRange("ends", "conv_id").withColumn("part", F.spark_partition_id())
    parts = cut.groupBy("ends", "part").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for ends, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ends != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = ends, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)],
                                             names=["ends", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["ends", "ends_sha256"])

    return parts.repartition("ends").sortWithinPartitions("ends", "part").select("ends", "ids").mapInArrow(
        run, "ends string, ends_sha256 string")


def swept(group: pa.Table) -> pa.Table:
    """The nodes of one container: its sequences in order, and a stack of the nodes that are open."""
    rows = sorted(group.to_pylist(), key=lambda r: r["ids"])
    head, at, heads = rows[0]["head"], rows[0]["at"], rows[0]["heads"]
    out: list[list] = []                 # depth, conv_id, parent, n_convs, n_children, n_leaves, saved, ends
    stack: list[list] = []               # the same from depth on, with the places of the children in out
    ids, chars = b"", []

    def close() -> None:
        node = stack.pop()
        depth, conv, _, n, n_children, n_leaves, saved_tokens, ends, children = node
        n_leaves = n_leaves or 1
        saved_tokens += (n - 1) * (chars[depth - 1] if depth else 0)
        for child in children:
            out[child][2] = conv
        if stack:
            above = stack[-1]
            above[1] = conv if above[1] is None else min(above[1], conv)
            above[3] += n
            above[4] += 1
            above[5] += n_leaves
            above[6] += saved_tokens
            above[8].append(len(out))
        out.append([depth, conv, None, n, n_children, n_leaves, saved_tokens, ends])

    for row in rows:
        mine, length = row["ids"], len(row["ids"]) // ID
        common = at
        while common < length and mine[common * ID:(common + 1) * ID] == ids[common * ID:(common + 1) * ID]:
            common += 1
        while stack and stack[-1][0] > common:
            close()
        ids, chars = mine, row["chars"]
        for depth in range(stack[-1][0] + 1 if stack else at, length + 1):
            stack.append([depth, None, None, 0, 0, 0, 0, None, []])
        node = stack[-1]
        node[1] = row["first"] if node[1] is None else min(node[1], row["first"])
        node[3] += row["n"]
        node[7] = row["ends"]
    while stack:
        close()
    m = len(out)
    cols = [pa.array([x[i] for x in out], pa.int64()) for i in range(7)]
    top = [x[0] == at for x in out]
    return pa.Table.from_arrays(
        [pa.array([head] * m, pa.string()), pa.array(top), *cols, pa.array([x[7] for x in out], pa.string()),
         pa.array([heads if t else None for t in top], pa.list_(pa.string()))],
        names=["head", "top", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
               "ends", "heads"])


def burst(rows: DataFrame, container_rows: int, container_turns: int) -> tuple[DataFrame, DataFrame | None]:
    """The containers that stay (all sequences with their head), and the trie heads that burst (None: none did).

    A round moves the sequences of oversized containers one turn on; there are as many
    rounds as turns are shared by too many different sequences.
    """
    live = rows.select("*", F.substring("ends", 1, 0).alias("head"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("heads"))
    kept, tops = [], []
    while True:
        following = F.substring(F.col("ids"), F.col("at") * ID + 1, F.lit(ID))
        own = F.when(F.col("at") > 0, F.element_at("chars", F.greatest(F.col("at"), F.lit(1)))).otherwise(0)
        branches = live.groupBy("head", following.alias("next")).agg(
            F.count("*").alias("rows"), F.sum(F.octet_length("ids") / ID - F.col("at")).alias("turns"), F.sum("n").alias("n_convs"),
            F.min("first").alias("conv_id"), F.min(own).alias("chars"), F.min("at").alias("depth"), F.max("heads").alias("heads"),
            F.max(F.when(F.octet_length("ids") == F.col("at") * ID, F.col("ends"))).alias("ends"))
        sizes = branches.groupBy("head").agg(
            F.sum("rows").alias("rows"), F.sum("turns").alias("turns"), F.sum("n_convs").alias("n_convs"),
            F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("depth").alias("depth"),
            F.max("heads").alias("heads"), F.max("ends").alias("ends"), F.count_if(F.octet_length("next") > 0).alias("n_children"))
        big = saved(sizes.where((F.col("rows") > 1) & ((F.col("rows") > container_rows) | (F.col("turns") > container_turns))))
        names = bounded(big.select("head"), MAX_BROADCAST_HEADS)
        kept.append(live.join(names, "head", "left_anti"))
        if not big.limit(1).count():
            break
        tops.append(big)
        moved = live.join(names, "head").withColumn("next", following).where(F.octet_length("next") > 0)
        live = saved(moved.select(
            *rows.columns, F.md5(F.concat(F.col("head"), F.hex("next"))).alias("new_head"), (F.col("at") + 1).alias("at"),
            F.concat("heads", F.array("head")).alias("heads")).withColumnRenamed("new_head", "head"))
    whole = kept[0]
    for more in kept[1:]:
        whole = whole.unionByName(more)
    heads = None
    for more in tops:
        heads = more if heads is None else heads.unionByName(more)
    return whole, heads


def trie(convs: DataFrame, container_rows: int = 5_000, container_turns: int = 200_000) -> DataFrame:
    """The nodes of the trie over ``convs`` (conv_id, ids, chars of ``sequences``).

    One row per distinct sequence of first turns, named by its smallest member and its depth:
    ``conv_id, depth, parent_conv_id`` (null for the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes of the subtree, itself included),
    ``saved_tokens`` (sum over the subtree, itself included, of (members - 1) times the code
    points of the last text) and ``ends_sha256`` (of the conversations that end there). A
    conversation without turns ends at the root; without any conversation there is no node.
    A conversation is one row of 20 bytes a turn, so its length is bounded by Spark's rows.
    """
    members = saved(convs.select(F.md5("ids").alias("ends"), "conv_id", "ids", "chars"))
    rows = saved(members.groupBy("ends").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"),
                                             F.first("ids").alias("ids"), F.first("chars").alias("chars")))
    containers, heads = burst(rows, container_rows, container_turns)
    nodes = saved(containers.select("head", "at", "heads", "ends", "n", "first", "ids", "chars").groupBy("head").applyInArrow(swept, NODE))
    named = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    if heads is None:
        out = nodes.select(*named)
    else:
        above = bounded(saved(heads.select(F.col("head").alias("up"), F.col("conv_id").alias("up_id"))), MAX_BROADCAST_HEADS)
        path = F.element_at("heads", F.when(F.size("heads") > 0, F.lit(-1)))
        tops = nodes.where("top")
        linked = tops.withColumn("up", path).join(above, "up", "left").withColumn("parent_conv_id", F.col("up_id"))
        own = (F.col("n_convs") - 1) * F.col("chars")
        below = tops.select(F.explode("heads").alias("head"), "n_leaves", "saved_tokens").union(
            heads.select(F.explode(F.concat("heads", F.array("head"))), F.lit(0).cast("long"), own))
        sums = below.groupBy("head").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        burst_nodes = heads.join(sums, "head").withColumn("up", path).join(above, "up", "left").select(
            "conv_id", F.col("depth").cast("long").alias("depth"), F.col("up_id").alias("parent_conv_id"), "n_convs", "n_children",
            "n_leaves", "saved_tokens", "ends")
        out = nodes.where("NOT top").select(*named).union(linked.select(*named)).union(burst_nodes)
    ended = out.where("ends IS NOT NULL").join(end_digests(members.select("ends", "conv_id")), "ends").drop("ends")
    return ended.unionByName(out.where("ends IS NULL").drop("ends").withColumn("ends_sha256", F.lit(NO_ENDS)))
