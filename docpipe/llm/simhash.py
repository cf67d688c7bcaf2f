"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two fingerprints within the radius
have one segment differing in at most one bit. Every fingerprint is indexed under its
segments with single bits wildcarded, equal index keys make candidates, and the full
distance is verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docpipe.llm.common import release, saved
from docpipe.llm.components import components

BITS = 64
#: Shingles of one unpacked block, which bounds memory on long texts.
BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int) -> int:
    """Fingerprint of a text's word shingles: a bit is set if it is set in over half the hashes."""
    words = text.lower().split()                     # bytes: lower-cases A-Z, splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist())], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, BLOCK):
        bits = np.unpackbits(hashes[at:at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id, content, fp`` per row: a hash of the whole text and the 64-bit fingerprint, both in a long.

    A text without words (or null) has fingerprint 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = np.array([fingerprint(t or b"", shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())],
                                             names=["doc_id", "content", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("content"),
                       F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, content long, fp long")


def key_masks(radius: int) -> list[int]:
    """The bits that each index key of a fingerprint reads, as 64-bit masks.

    With radius 2d and d + 1 segments, one segment differs in at most one bit. Its key is
    made longer by what must be equal besides, which keeps chance candidates rare:

    - a segment is equal: of the other bits, cut into radius + 1 pieces, one piece is equal;
    - no segment is equal: two segments differ in exactly one bit each (were it one, the
      others would differ in 1 + 2d bits). One has that bit wildcarded, and of the halves of
      the other one is equal.

    At radius 4 that is 143 keys of 29 or more bits. An odd radius counts as the next even.
    """
    radius += radius % 2
    segments = radius // 2 + 1
    cuts = [round(BITS * k / segments) for k in range(segments + 1)]
    spans = list(zip(cuts, cuts[1:]))

    def mask(places: Iterable[int]) -> int:
        return sum(1 << k for k in places)

    masks: list[int] = []
    for a, b in spans:
        others = [k for k in range(BITS) if not a <= k < b]
        edges = [round(len(others) * k / (radius + 1)) for k in range(radius + 2)]
        masks += [mask(range(a, b)) | mask(others[i:j]) for i, j in zip(edges, edges[1:])]
    for (a, b), (c, d) in itertools.combinations(spans, 2):
        for bit in range(a, b):
            one_wild = mask(range(a, b)) ^ (1 << bit)
            masks += [one_wild | mask(range(c, (c + d) // 2)), one_wild | mask(range((c + d) // 2, d))]
    return masks


def signatures(fp: Column, radius: int) -> Column:
    """All index keys of a fingerprint, as an array of long: 56 bits of a hash of the bits under each mask.

    Keys that meet by chance cost a comparison only, as distances are verified. One expression
    over the masks' array: written out key by key, the code generated for it took hundreds of
    MB of the driver's heap to compile.
    """
    masks = F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("long") for m in key_masks(radius)])
    return F.transform(masks, lambda mask, n: F.shiftrightunsigned(F.xxhash64(n, fp.bitwiseAND(mask)), 8))


def spanning_links(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect exactly the fingerprints connected within the radius: never all pairs."""
    left = fps
    while left.size > 1:
        front, left = [left[0]], left[1:]
        while front and left.size:
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found, left = left[near], left[~near]
                front.extend(found)
                yield from ((x, y) for y in found)


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Verified links inside the buckets of a partition sorted by bucket."""
    def links(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.any(bucket[1:] != bucket[:-1], axis=1)) + 1 if len(fp) else np.empty(0, dtype=np.int64)
        start, stop = np.concatenate(([0], edge)), np.concatenate((edge, [len(fp)]))
        size = stop - start
        first = start[size == 2]
        x, y = fp[first], fp[first + 1]
        near = np.bitwise_count(x ^ y) <= radius
        more = [p for a, b in zip(start[size > 2], stop[size > 2]) for p in spanning_links(np.unique(fp[a:b]), radius)]
        more = np.array(more, dtype=np.uint64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((x[near], more[:, 0])).view(np.int64)),
             pa.array(np.concatenate((y[near], more[:, 1])).view(np.int64))], names=["a", "b"])

    buckets, fps = np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.uint64)
    for batch in batches:
        new = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        buckets = np.concatenate((buckets, new))
        fps = np.concatenate((fps, batch.column(2).to_numpy().view(np.uint64)))
        if len(fps):
            open_from = int(np.argmax(np.all(buckets == buckets[-1], axis=1)))  # the last bucket may go on
            if open_from:
                yield links(buckets[:open_from], fps[:open_from])
                buckets, fps = buckets[open_from:], fps[open_from:]
    yield links(buckets, fps)


def near_links(fps: DataFrame, radius: int = 4, bucket_rows: int = 20_000) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints (column ``fp``) within the radius.

    Buckets of one fingerprint are dropped by a count that is summed before the shuffle. A
    bucket of over ``bucket_rows`` fingerprints is cut into chunks, and every pair of chunks
    is a bucket of its own, so no task takes a hot bucket whole and no pair is lost.
    """
    # The keys are many times the size of what they are made from, so that is spread first. Spark
    # takes them for about as small (an explode counts as one row a row) and would broadcast them.
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = fps.select("fp").repartition(spread).select("fp", F.explode(signatures(F.col("fp"), radius)).alias("key"))
    counts = signed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / bucket_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                         lambda c: F.least(c, F.col("own")).cast("long") * F.col("chunks") + F.greatest(c, F.col("own")))
    rows = signed.join(counts.hint("merge"), "key").withColumn("chunks", chunks).withColumn("own", own)
    rows = rows.select("key", F.explode(blocks).alias("block"), "fp")
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block")
    return rows.mapInArrow(lambda it: bucket_links(it, radius), "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id, component_fp, content`` for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits. Fingerprints within ``radius`` bits link;
    ``component_id`` is the smallest id reachable over links, ``component_fp`` the smallest
    fingerprint, ``content`` a hash of the text. Null and wordless texts have fingerprint
    zero and link like others; a null id takes its group's component id (null if no row of
    the group has an id) and repeated rows give repeated rows; an empty table gives no rows.
    Only the two named columns are read. Nothing is joined by id: copies meet as one
    fingerprint, counted before the shuffle.
    """
    rows = saved(fingerprints(docs, id_col, text_col, shingle))
    groups = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(groups, radius))
    release(docs.sparkSession)      # the keys' shuffle files, before the caller moves texts
    groups = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = groups.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = groups.join(smallest, "root").select("fp", "component_id", F.col("root").alias("component_fp"))
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_fp", "content")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, all columns kept.

    It is the row of the smallest id (rows without an id come last), of rows that share the
    id the one of smallest content hash; of wholly equal rows any one. The text is shuffled
    once, by id and content hash.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")
    kept = near_duplicates(docs, id_col, text_col, **options).groupBy("component_fp").agg(F.min(key).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.content").alias("kept_content"))
    keyed = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("key_id"),
                        F.xxhash64(text_col).alias("key_content"))
    keyed = keyed.join(kept, F.col("key_id").eqNullSafe(F.col("kept_id"))
                       & (F.col("key_content") == F.col("kept_content")), "left_semi")
    same = W.partitionBy("key_id", "key_content").orderBy("key_content")
    return keyed.withColumn("nth", F.row_number().over(same)).where("nth = 1").select("doc.*")
