"""Phrase collocations by direct-address tiling.

Texts become streams of word ids, cut into chunks of bounded size. The ids are ranked by
frequency and the ranked left words are cut into tiles of equal load: a tile's words occur
``tile_load`` times at most together (a more frequent word is a tile of its own and is split
into bands by the right word). Every chunk counts its pairs and sends each tile one packed
block of (pair code, count); the tile adds the blocks up, with a dense ``bincount`` over
left x right where that area is small, else as sorted coordinates (COO). Pairs that are
frequent enough are ranked again inside their tile, cut into tiles of equal load in turn,
and sent back to the chunks that hold them, where (pair, next word) makes the next round.

What a task holds is bounded by the chunk size or by the tile load, whatever the corpus;
a language, word or pair that makes up a third of all rows is one entry of every chunk.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docpipe.llm.common import release, saved

#: A-Z become lower case, the marks that end a piece become line feeds, tabs become blanks.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0b\x0c\r" + b"\t",
                       b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Cells of a dense tile, and bytes of a text that are split into words at once.
DENSE_CELLS = 1 << 22
SLICE_BYTES = 1 << 22
#: Shares of a language's phrases that are ranked apart before they are ranked together.
SHARES = 32
#: Rows of one Arrow batch.
ROWS = 1 << 16
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)


def pack(values: np.ndarray) -> bytes:
    """An array as compressed bytes."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type = np.uint32) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=kind)


# -- chunks of word codes ----------------------------------------------------------------

def slices(text: bytes) -> Iterator[bytes]:
    """A folded text in parts that end where a piece ends."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        stop = text.find(b"\n", at + SLICE_BYTES)
        if stop < 0:
            break
        yield text[at:stop]
        at = stop + 1
    yield text[at:]


class Shelf:
    """The words of one language that a task has read since the last chunk."""

    def __init__(self):
        self.codes: dict[bytes, int] = defaultdict(itertools.count(2).__next__, {b"\n": 0, b"": 1})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        for part in slices(text.translate(FOLD)):
            words = part.replace(b"\n", b" \n ").split(b" ")
            words.append(b"\n")
            codes = np.fromiter(map(self.codes.__getitem__, words), dtype=np.uint32, count=len(words))
            codes = codes[codes != 1]
            self.parts.append(codes)
            self.size += len(codes)

    def chunk(self, number: int, lang: str) -> pa.RecordBatch:
        stream = np.concatenate(self.parts)
        counts = np.bincount(stream, minlength=len(self.codes))[2:]
        words = np.frombuffer(b"\n".join(itertools.islice(self.codes, 2, None)), dtype=np.uint8)
        stream = np.where(stream > 1, stream - 1, 0).astype(np.uint32)      # 0: end of a piece, k: word k of the chunk
        row = [pa.array([number], pa.int64()), pa.array([lang]), pa.array([int(counts.sum())], pa.int64()),
               *(pa.array([pack(x)], pa.binary()) for x in (words, counts, stream))]
        return pa.RecordBatch.from_arrays(row, names=["chunk", "lang", "tokens", "words", "counts", "stream"])


def chunked(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """``chunk, lang, tokens, words, counts, stream``: the texts (columns lang, text) as word codes, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelves: dict[str, Shelf] = defaultdict(Shelf)
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shelf = shelves[lang]
                held -= shelf.size
                shelf.add(text)
                held += shelf.size
                while held >= chunk_tokens:
                    largest = max(shelves, key=lambda x: shelves[x].size)
                    shelf = shelves.pop(largest)
                    held -= shelf.size
                    yield shelf.chunk(next(numbers), largest)
        for lang, shelf in shelves.items():
            yield shelf.chunk(next(numbers), lang)

    return docs.mapInArrow(run, "chunk long, lang string, tokens long, words binary, counts binary, stream binary")


def chunk_words(chunks: DataFrame) -> DataFrame:
    """``chunk, lang, at, word, n``: the distinct words of every chunk and their counts there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                found, n = unpack(words, np.uint8).tobytes().decode().split("\n"), unpack(counts, np.int64)
                for at in range(0, len(n), ROWS):
                    m = len(n[at:at + ROWS])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, chunk)), pa.array([lang] * m, pa.string()), pa.array(np.arange(at, at + m, dtype=np.int32)),
                         pa.array(found[at:at + m], pa.string()), pa.array(n[at:at + m])], names=["chunk", "lang", "at", "word", "n"])

    return chunks.select("chunk", "lang", "words", "counts").mapInArrow(run, "chunk long, lang string, at int, word string, n long")


# -- frequency ranks ---------------------------------------------------------------------

def ranked_words(words: DataFrame, tile_load: int) -> DataFrame:
    """``lang, word, a, id, tile, bands`` of the words (lang, word, a), the most frequent first from id 1.

    A global sort by ranges, and per range and language the totals that come before it: no
    language is gathered in one task.
    """
    order = ("lang", F.col("a").desc(), "word")
    cut = saved(words.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    earlier = W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy("lang", "part").agg(F.count("*").alias("rows"), F.sum("a").alias("load"))
    offsets = totals.select("lang", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
                            F.coalesce(F.sum("load").over(earlier), F.lit(0)).alias("load_before"))
    inside = W.partitionBy("lang", "part").orderBy(F.col("a").desc(), "word")
    before = F.col("load_before") + F.sum("a").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("a")
    return cut.join(offsets, ["lang", "part"]).select(
        "lang", "word", "a", (F.col("rows_before") + F.row_number().over(inside)).alias("id"),
        F.floor(before / tile_load).cast("int").alias("tile"), F.ceil(F.col("a") / tile_load).cast("int").alias("bands"))


# -- a chunk's items -----------------------------------------------------------------------

#: ``words`` is the stream of word ids (null in the first round, whose items are words) and
#: ``items`` that of phrases of the round, as numbers from 1 into ``tile_of``, ``rank`` and
#: ``bands`` (0: none); ``tiles`` names the tiles.
CHUNK = "chunk long, lang string, words binary, items binary, tiles array<string>, tile_of binary, rank binary, bands binary"
BLOCK = "chunk long, lang string, tile string, band int, codes binary, counts binary"


def word_ids(chunk: dict, items: np.ndarray) -> np.ndarray:
    if chunk["words"] is not None:
        return unpack(chunk["words"])
    return np.concatenate((np.zeros(1, dtype=np.uint32), unpack(chunk["rank"])))[items]


def coded(chunk: dict, length: int) -> np.ndarray:
    """At each place of a chunk, the item that starts there (high half) and the word behind it (low half); 0: no phrase."""
    items = unpack(chunk["items"])
    words = word_ids(chunk, items)
    left, right = items[:-length], words[length:]
    there = (left > 0) & (right > 0)
    if length > 1:
        there &= items[1:len(items) - length + 1] > 0
    return np.where(there, left.astype(np.uint64) << HALF | right, 0).astype(np.uint64)


def summed(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sum of their counts: a dense tile, or sorted coordinates."""
    if not len(codes):
        return codes, np.empty(0, dtype=np.int64)
    left, right = (codes >> HALF).astype(np.int64), (codes & LOW).astype(np.int64)
    first, width = left.min(), int(right.max()) + 1
    area = (int(left.max()) - int(first) + 1) * width
    if area <= min(DENSE_CELLS, 16 * len(codes)):
        cells = (left - first) * width + right
        dense = np.bincount(cells, weights=counts, minlength=area)      # float64 sums are exact below 2^53
        full = np.flatnonzero(dense)
        return (full // width + first).astype(np.uint64) << HALF | (full % width).astype(np.uint64), dense[full].astype(np.int64)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    start = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    if counts is None:
        return codes[start], np.diff(np.append(start, len(codes)))
    return codes[start], np.add.reduceat(counts[order], start)


def blocks(chunk: dict, length: int) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Tile, band, the chunk's own codes, the tile's codes and counts of the phrases of a chunk, always in the same order."""
    codes = coded(chunk, length)
    own, counts = summed(codes[codes > 0])
    if not len(own):
        return
    tile_of, rank, bands = (unpack(chunk[x]) for x in ("tile_of", "rank", "bands"))
    item, word = (own >> HALF).astype(np.int64) - 1, own & LOW
    tile, band = tile_of[item], (word % bands[item]).astype(np.uint32)
    code = rank[item].astype(np.uint64) << HALF | word
    order = np.lexsort((code, band, tile))
    own, counts, tile, band, code = own[order], counts[order], tile[order], band[order], code[order]
    start = np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]) | (band[1:] != band[:-1]))))
    for a, b in itertools.pairwise(np.append(start, len(own))):
        yield chunk["tiles"][tile[a]], int(band[a]), own[a:b], code[a:b], counts[a:b]


def first_items(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The chunks with word ids; a word that is too rare for any phrase is 0, like the end of a piece."""
    known = chunk_words(chunks).select("chunk", "lang", "at", "word").join(
        vocabulary, ["lang", "word"]).select(F.col("chunk").alias("of"), "at", F.col("id").cast("int").alias("id"), "tile", "bands")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for chunk in left.to_pylist():
            at, ids, bands = (right.column(x).to_numpy().astype(np.int64) for x in ("at", "id", "bands"))
            stream = unpack(chunk["stream"])
            number = np.zeros(int(max(stream.max(initial=0), at.max(initial=-1) + 1)) + 1, dtype=np.uint32)
            number[at + 1] = np.arange(1, len(at) + 1)
            tiles, tile_of = np.unique(right.column("tile").to_numpy(), return_inverse=True)
            rows.append((chunk["chunk"], chunk["lang"], None, pack(number[stream]), [str(t) for t in tiles],
                         pack(tile_of.astype(np.uint32)), pack(ids.astype(np.uint32)), pack(bands.astype(np.uint32))))
        return table(rows, CHUNK_TYPES)

    return chunks.select("chunk", "lang", "stream").groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(run, CHUNK)


CHUNK_TYPES = {"chunk": pa.int64(), "lang": pa.string(), "words": pa.binary(), "items": pa.binary(),
               "tiles": pa.list_(pa.string()), "tile_of": pa.binary(), "rank": pa.binary(), "bands": pa.binary()}
BLOCK_TYPES = {"chunk": pa.int64(), "lang": pa.string(), "tile": pa.string(), "band": pa.int32(), "codes": pa.binary(),
               "counts": pa.binary()}
COUNTED_TYPES = {"chunk": pa.int64(), "lang": pa.string(), "tile": pa.string(), "band": pa.int32(), "at": pa.binary(),
                 "codes": pa.binary(), "a": pa.binary(), "rank": pa.binary(), "part": pa.binary(), "bands": pa.binary()}
COUNTED = ("chunk long, lang string, tile string, band int, at binary, codes binary, a binary, rank binary, "
           "part binary, bands binary")


def table(rows: list[tuple], types: dict) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], names=list(types))


# -- a round -------------------------------------------------------------------------------

def counted(items: DataFrame, length: int, min_count: int, tile_load: int, back: bool) -> DataFrame:
    """Frequent phrases of ``length + 1`` words.

    A row without ``chunk`` holds a tile band's phrases: their codes, counts, ranks, and the
    part and bands each has in the next round. With ``back``, a row with ``chunk`` says which
    of the chunk's codes of that tile band are frequent (``at``) and the same of each.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                rows = [(chunk["chunk"], chunk["lang"], tile, band, pack(np.diff(code, prepend=np.uint64(0))), pack(counts))
                        for tile, band, _, code, counts in blocks(chunk, length)]
                yield from table(rows, BLOCK_TYPES).to_batches()

    def add(group: pa.Table) -> pa.Table:
        lang, tile, band = (group.column(x)[0].as_py() for x in ("lang", "tile", "band"))
        codes = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in group.column("codes").to_pylist()]
        counts = [unpack(x, np.int64) for x in group.column("counts").to_pylist()]
        code, a = summed(np.concatenate(codes), np.concatenate(counts))
        code, a = code[a >= min_count], a[a >= min_count]
        order = np.lexsort((code, -a))
        rank = np.empty(len(code), dtype=np.uint32)
        rank[order] = np.arange(1, len(code) + 1)
        part = np.empty(len(code), dtype=np.uint32)
        part[order] = (np.cumsum(a[order]) - a[order]) // tile_load
        bands = -(-a // tile_load)
        rows = [(None, lang, tile, band, None, pack(code), pack(a), pack(rank), pack(part), pack(bands))] if len(code) else []
        for chunk, mine in zip(group.column("chunk").to_pylist(), codes) if back and len(code) else ():
            place = np.minimum(np.searchsorted(code, mine), len(code) - 1)
            at = np.flatnonzero(code[place] == mine)
            if len(at):
                place = place[at]
                rows.append((chunk, lang, tile, band, pack(at.astype(np.uint32)), None, None, pack(rank[place]),
                             pack(part[place]), pack(bands[place].astype(np.uint32))))
        return table(rows, COUNTED_TYPES)

    return items.mapInArrow(send, BLOCK).groupBy("lang", "tile", "band").applyInArrow(add, COUNTED)


def tile_name(tile: str, band: int, part: int) -> str:
    return f"{tile}.{band}/{part}"


def next_items(items: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The chunks with the frequent phrases of ``length + 1`` words as their items."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = {(r["tile"], r["band"]): r for r in right.to_pylist()}
        rows = []
        for chunk in left.to_pylist():
            own, rank, bands, tile_of, names = [], [], [], [], []
            for tile, band, codes, _, _ in blocks(chunk, length):
                if (tile, band) in told:
                    r = told[tile, band]
                    part = unpack(r["part"])
                    parts, where = np.unique(part, return_inverse=True)
                    own.append(codes[unpack(r["at"])])
                    rank.append(unpack(r["rank"]))
                    bands.append(unpack(r["bands"]))
                    tile_of.append((where + len(names)).astype(np.uint32))
                    names += [tile_name(tile, band, int(p)) for p in parts]
            if not own:
                continue
            own, rank, bands, tile_of = (np.concatenate(x) for x in (own, rank, bands, tile_of))
            order = np.argsort(own)
            own = own[order]
            code = coded(chunk, length)
            place = np.minimum(np.searchsorted(own, code), len(own) - 1)
            phrase = np.where(own[place] == code, place + 1, 0).astype(np.uint32)
            stream = np.zeros(len(code) + length, dtype=np.uint32)
            stream[:len(code)] = phrase
            words = pack(word_ids(chunk, unpack(chunk["items"])))
            rows.append((chunk["chunk"], chunk["lang"], words, pack(stream), names, pack(tile_of[order]),
                         pack(rank[order]), pack(bands[order])))
        return table(rows, CHUNK_TYPES)

    told = found.where("chunk IS NOT NULL").select(F.col("chunk").alias("of"), "tile", "band", "at", "rank", "part", "bands")
    return items.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(run, CHUNK)


def phrases(found: DataFrame) -> DataFrame:
    """``lang, tile, item, word, a, next_tile, rank``: the frequent phrases of a round, one a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                code, part = unpack(r["codes"], np.uint64), unpack(r["part"])
                n = len(code)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["lang"]] * n, pa.string()), pa.array([r["tile"]] * n, pa.string()),
                     pa.array((code >> HALF).astype(np.int64)), pa.array((code & LOW).astype(np.int64)),
                     pa.array(unpack(r["a"], np.int64)), pa.array([tile_name(r["tile"], r["band"], int(p)) for p in part], pa.string()),
                     pa.array(unpack(r["rank"]).astype(np.int64))],
                    names=["lang", "tile", "item", "word", "a", "next_tile", "rank"])

    return found.where("chunk IS NULL").mapInArrow(
        run, "lang string, tile string, item long, word long, a long, next_tile string, rank long")


# -- the operator --------------------------------------------------------------------------

def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3,
                     min_count: int = 10, chunk_tokens: int = 1 << 21, tile_load: int = 1 << 22) -> DataFrame:
    """``lang, words, phrase, a, n`` of all phrases of 1 to ``max_words`` words found ``min_count`` times or more.

    ``words`` is the number of words, ``phrase`` the words joined by blanks, ``n`` the words
    of the language. ``chunk_tokens`` and ``tile_load`` bound a task's memory and change no
    result.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.col(text_col).cast("binary").alias("text")).where("octet_length(text) > 0")
    chunks = saved(chunked(texts, chunk_tokens))
    sizes = saved(chunks.groupBy("lang").agg(F.sum("tokens").alias("n")))
    counts = chunk_words(chunks).groupBy("lang", "word").agg(F.sum("n").alias("a"))
    vocabulary = saved(ranked_words(counts.where(F.col("a") >= min_count), tile_load))
    items = saved(first_items(chunks, vocabulary))
    del chunks, counts
    release(docs.sparkSession)
    # the phrases of a round, named by tile and rank, for the next round's left parts
    known = vocabulary.select("lang", F.col("tile").cast("string").alias("tile"), F.col("id").alias("rank"),
                              F.col("word").alias("phrase"), "a")
    out = known.select("lang", F.lit(1).alias("words"), "phrase", "a")
    for length in range(1, max_words):
        last = length == max_words - 1
        found = saved(counted(items, length, min_count, tile_load, back=not last))
        left = known.select("lang", "tile", F.col("rank").alias("item"), F.col("phrase").alias("start"))
        right = vocabulary.select("lang", F.col("id").alias("word"), F.col("word").alias("end"))
        known = saved(phrases(found).join(left, ["lang", "tile", "item"]).join(right, ["lang", "word"]).select(
            "lang", F.col("next_tile").alias("tile"), "rank", F.concat_ws(" ", "start", "end").alias("phrase"), "a"))
        out = out.union(known.select("lang", F.lit(length + 1), "phrase", "a"))
        if not last:
            items = saved(next_items(items, found, length))
        del found
        release(docs.sparkSession)
    return out.join(sizes, "lang")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10,
                 top: int = 2000, inside_percent: int = 50, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` best phrases of two or more words of each language.

    A phrase found ``a`` times is cut after its first k words into parts found l and r times;
    its score is floor(1000000 * a * a / (l * r)) of the cut that gives least (least k of
    equals), in exact decimals. A phrase goes if a longer one that contains it is found at
    least ``inside_percent`` percent as often. Best first by score, then by ``a``, then by
    the phrase's bytes.

    Null texts hold no words, a null language is ``und`` (one language with texts so
    labelled), repeated rows count again, an empty table gives no rows; only the two named
    columns are read. A language may have 2^31 - 1
    words of ``min_count`` or more; beyond, the cast of their ids fails.
    """
    found = saved(frequent_phrases(docs, text_col, lang_col, max_words, min_count, **options))
    part = found.select("lang", "phrase", "a")
    candidates = found.where("words >= 2")
    words = F.split("phrase", " ", -1)

    def joined(first, count):
        return F.array_join(F.slice("w", first, count), " ")

    cuts = candidates.withColumn("w", words).select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "n", "k", joined(F.lit(1), F.col("k")).alias("first"),
        joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    square = "1000000BD * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))"
    cuts = cuts.withColumn("score", F.expr(f"({square}) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"),
                                                F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    lengths = F.sequence(F.lit(2), F.col("words") - 1)
    inner = candidates.where("words > 2").withColumn("w", words).select(
        "lang", "a", "words", "w", F.explode(lengths).alias("size")).select(
        "lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at")).select(
        "lang", "a", joined(F.col("at"), F.col("size")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    # The best of each of SHARES shares of a language, then the best of those: no task takes all its phrases.
    order = (F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    first = kept.withColumn("place", F.row_number().over(W.partitionBy("lang", share).orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
                         F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
