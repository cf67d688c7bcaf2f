"""Removal of byte strings that occur twice, by column-wise multi-document construction.

Every string of ``length`` bytes picks one anchor inside itself: the gram of least hash
(leftmost of equals). Equal strings pick the same anchor, so strings are compared only with
strings of the same anchor gram, aligned at it. The aligned texts of a gram are a
collection, built one column at a time: each round inserts the next symbol of every text,
updates the collection's order (sorted by reversed prefix: the column's part of its
Burrows-Wheeler transform) and the common lengths of neighbours. A text whose longest
common run with a neighbour spans ``length`` bytes at a column holds a repeated string.
Columns are written to, and read in turn from, a sequential temporary file of the task.

Only grams that occur at two places get that far. Grams over ``hot_rows`` places, too many
for one task, take an exact way without a collection: their strings are counted by hash,
summed before the shuffle.

Passages that texts share word by word are found in the same way, with a word (its 64-bit
hash) in the place of a byte: a passage of 51 words is often shorter than 400 bytes. Here
each text sends only the first of its equal passages, so that equals are in two texts.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docpipe.llm.common import release, saved

#: Bytes of one numpy round and texts of one collection, which bound a task's memory.
CHUNK_BYTES = 1 << 21
BATCH_TEXTS = 1 << 15
#: Texts whose columns are written to the external file at once.
PART_TEXTS = 1 << 12
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Low bits of a gram's rank that give its place, so that the leftmost of equals is least (a text has under 2^31 symbols).
POSITION = np.uint64((1 << 31) - 1)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Words of a passage's anchor gram.
WORD_GRAM = 8
Texts = list[bytes]


class Unit(NamedTuple):
    """Symbols of the strings that are compared and of their grams, and bytes of a symbol."""

    length: int
    gram: int
    item: int

    @property
    def dtype(self) -> type:
        return np.uint8 if self.item == 1 else np.uint64


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left ^ (left >> np.uint64(29))) * FACTOR) + right


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every string of ``length`` bytes or word hashes, built from strings of doubled length."""
    level, size, done, out = SYMBOLS[data] if data.dtype == np.uint8 else data, 1, 0, None
    n = len(data) - length + 1
    while True:
        if length & size:
            part = level[done:done + n]
            out = part if out is None else _join(out, part)
            done += size
        if done == length:
            out = (out ^ (out >> np.uint64(32))) * FACTOR
            return out ^ (out >> np.uint64(29))
        level = _join(level[:-size], level[size:])
        size *= 2


def word_starts(data: np.ndarray) -> np.ndarray:
    """First byte of every word."""
    gap = SPACE[data]
    return np.flatnonzero(~gap & np.concatenate(([True], gap[:-1]))) if len(data) else np.empty(0, np.int64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and 64-bit hash of every word, in bounded rounds that end at white space."""
    gap, at, first, out = SPACE[data], 0, [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        if end < len(data):
            end += int(np.argmax(gap[end:])) if gap[end:].any() else len(data) - end
        inside = ~gap[at:end]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        begin = np.flatnonzero(edge == 1)
        if len(begin):
            size = np.flatnonzero(edge == -1) - begin
            lead = np.cumsum(size) - size
            place = (np.arange(size.sum()) - np.repeat(lead, size)).astype(np.uint64)
            value = SYMBOLS[data[at:end][inside]] + place * FACTOR
            value = (value ^ (value >> np.uint64(32))) * FACTOR
            first.append(begin + at)
            out.append(np.add.reduceat(value ^ (value >> np.uint64(29)), lead))
        at = end
    return np.concatenate(first), np.concatenate(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width``."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - width + 1], before[width - 1:n])


def anchor_runs(text: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int, gram: int, distinct: bool = False) -> tuple:
    """Runs of strings with one anchor, for texts laid end to end.

    Returns row, gram hash, anchor, first and last string start of each run (all places
    relative to ``text``), then row, first and last start of runs of strings that occur
    twice inside their own text. Where a text repeats itself so much that anchors crowd,
    its repeated strings are found at once, and only the first of equals goes on. With
    ``distinct`` the first of equals goes on of every text, and no own repeats are returned.
    """
    grams = string_hashes(text, gram)
    at = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams & ~POSITION) | at, length - gram + 1)
    own = stops - starts >= length
    rows = np.flatnonzero(own)
    sizes = (stops - starts)[rows] - length + 1
    string = np.arange(sizes.sum()) + np.repeat(starts[rows] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    row = np.repeat(rows, sizes)
    anchor = (least[string] & POSITION).astype(np.int64)

    first = np.concatenate(([True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]))) if len(row) else np.empty(0, bool)
    crowded = np.bincount(row[first], minlength=len(starts)) > 8 + 8 * (stops - starts) // (length - gram + 1)
    local = []
    if distinct and len(string):
        lead = np.unique(_join(string_hashes(text, length)[string], row.astype(np.uint64)), return_index=True)[1]
        lead.sort()
        string, row, anchor = string[lead], row[lead], anchor[lead]
        first = np.concatenate(([True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (np.diff(string) != 1)))
    elif crowded.any():
        keep = np.ones(len(string), dtype=bool)
        for r in np.flatnonzero(crowded):
            mine = np.flatnonzero(row == r)
            _, lead, count = np.unique(string_hashes(text[starts[r]:stops[r]], length), return_index=True, return_counts=True)
            again = np.ones(len(mine), dtype=bool)
            again[lead] = False
            keep[mine[again]] = False
            again[lead[count > 1]] = True
            local += [(r, a, b) for a, b in zip(*_true_runs(again))]
        string, row, anchor = string[keep], row[keep], anchor[keep]
        first = np.concatenate(([True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (np.diff(string) != 1)))
    begin = np.flatnonzero(first)
    end = np.concatenate((begin[1:], [len(string)])).astype(np.int64) - 1
    local = np.array(local, dtype=np.int64).reshape(-1, 3)
    return ((row[begin], grams[anchor[begin]], anchor[begin], string[begin], string[end] if len(begin) else string[begin]),
            (local[:, 0], local[:, 1] + starts[local[:, 0]], local[:, 2] + starts[local[:, 0]]))


def _true_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def laid_out(texts: Texts, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts end to end in bounded rounds: bytes, starts, stops, row and offset of each part.

    A longer text comes in parts that overlap by length - 1 bytes: each string is in one part.
    """
    parts, held = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK_BYTES):
            part = text[at:at + CHUNK_BYTES + length - 1]
            if len(part) >= length:
                parts.append((part, row, at))
                held += len(part)
            if held >= CHUNK_BYTES:
                yield _lay(parts)
                parts, held = [], 0
    if parts:
        yield _lay(parts)


def _lay(parts: list) -> tuple:
    stops = np.cumsum([len(p[0]) for p in parts])
    return (np.frombuffer(b"".join(p[0] for p in parts), dtype=np.uint8), stops - [len(p[0]) for p in parts], stops,
            np.array([p[1] for p in parts]), np.array([p[2] for p in parts]))


def laid_words(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Word hashes of texts end to end in rounds of whole texts: hashes, starts, stops and row of each text."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) < CHUNK_BYTES):
            held += len(texts[end]) + 1
            end += 1
        first, hashes = word_hashes(np.frombuffer(b" ".join(texts[at:end]), dtype=np.uint8))
        begin = np.cumsum([0, *(len(t) + 1 for t in texts[at:end])])
        bounds = np.searchsorted(first, begin)
        yield hashes, bounds[:-1], bounds[1:], np.arange(at, end)
        at = end


ANCHORS = "unit int, h long, k1 long, k2 long, pos int, lo int, hi int, own boolean"


def anchors(rows: DataFrame, units: list[Unit]) -> DataFrame:
    """Anchor runs of all texts (columns k1, k2, text); ``own``: strings that their own text repeats.

    Besides, a row of unit 2 for every text: h tells the text, hi has its number of words (if ``units`` has words).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, gram, _ = units[0]
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            texts = batch.column(2).to_pylist()
            for text, starts, stops, row, offset in laid_out(texts, length):
                (r, h, a, lo, hi), (lr, llo, lhi) = anchor_runs(text, starts, stops, length, gram)
                shift, lshift = offset[r] - starts[r], offset[lr] - starts[lr]
                mixed = ((k1[row[lr]].view(np.uint64) ^ (llo + lshift).astype(np.uint64)) * FACTOR).view(np.int64)
                both = lambda x, y: np.concatenate((x, y))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(len(r) + len(lr), dtype=np.int32)),
                    pa.array(both(h.view(np.int64), mixed), pa.int64()), pa.array(k1[row[both(r, lr)]]), pa.array(k2[row[both(r, lr)]]),
                    pa.array(both(a + shift, llo + lshift).astype(np.int32)), pa.array(both(lo + shift, llo + lshift).astype(np.int32)),
                    pa.array(both(hi + shift, lhi + lshift).astype(np.int32)),
                    pa.array(both(np.zeros(len(r), dtype=bool), np.ones(len(lr), dtype=bool)))],
                    names=["unit", "h", "k1", "k2", "pos", "lo", "hi", "own"])
            size = np.zeros(len(texts), dtype=np.int32)
            for length_w, gram_w, _ in units[1:]:
                for hashes, starts, stops, row in laid_words(texts):
                    size[row] = stops - starts
                    if len(hashes) < length_w:
                        continue
                    r, h, a, lo, hi = anchor_runs(hashes, starts, stops, length_w, gram_w, distinct=True)[0]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.ones(len(r), dtype=np.int32)), pa.array(h.view(np.int64)), pa.array(k1[row[r]]), pa.array(k2[row[r]]),
                        *(pa.array((x - starts[r]).astype(np.int32)) for x in (a, lo, hi)), pa.array(np.zeros(len(r), dtype=bool))],
                        names=["unit", "h", "k1", "k2", "pos", "lo", "hi", "own"])
            none = pa.array(np.zeros(len(texts), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(texts), 2, dtype=np.int32)), pa.array(k1 ^ k2), pa.array(k1), pa.array(k2), none, none, pa.array(size),
                pa.array(np.zeros(len(texts), dtype=bool))], names=["unit", "h", "k1", "k2", "pos", "lo", "hi", "own"])

    return rows.mapInArrow(run, ANCHORS)


def column_wise(group: np.ndarray, before: np.ndarray, texts: Texts, unit: Unit) -> np.ndarray:
    """Which strings of the aligned texts of each group occur in another text of the group.

    ``group`` is sorted; ``before`` is the number of symbols of a text in front of its anchor.
    Returns a matrix of flags, texts by places: place j is the string that starts
    length - gram - j symbols in front of the anchor.
    """
    length, gram, item = unit
    reach = length - gram                            # most symbols in front of an anchor
    width, m = reach + length, len(texts)
    begin = reach - before
    end = begin + np.fromiter(map(len, texts), dtype=np.int64, count=m) // item
    flags = np.zeros((m, width - length + 1), dtype=bool)
    with tempfile.TemporaryFile() as columns:
        for at in range(0, m, PART_TEXTS):              # the file is written by parts of texts, and read by columns
            part = np.zeros((width, min(PART_TEXTS, m - at)), dtype=unit.dtype)
            for i, text in enumerate(texts[at:at + PART_TEXTS]):
                part[begin[at + i]:end[at + i], i] = np.frombuffer(text, dtype=unit.dtype)
            for c in range(width):
                columns.seek((c * m + at) * item)
                columns.write(part[c].tobytes())
        columns.seek(0)
        order, since = np.arange(m), np.zeros(m, dtype=np.int64)    # since: first column shared with the one before
        groups = group.astype(np.int64) << (9 if item == 1 else m.bit_length() + 1)
        for c in range(width):
            symbol = np.frombuffer(columns.read(m * item), dtype=unit.dtype)[order]
            if item > 1:                                            # words by their rank in the column
                symbol = np.unique(symbol, return_inverse=True)[1]
            symbol = symbol.astype(np.int64) + 1
            symbol[(begin[order] > c) | (end[order] <= c)] = 0      # outside its text a symbol equals no other
            key = groups + symbol
            same = np.zeros(len(order), dtype=bool)
            if (key[1:] >= key[:-1]).all():
                same[1:] = (key[1:] == key[:-1]) & (symbol[1:] > 0)
                since = np.where(same, since, c + 1)
            else:
                sort = np.argsort(key, kind="stable")
                key, symbol = key[sort], symbol[sort]
                same[1:] = (key[1:] == key[:-1]) & (symbol[1:] > 0)
                now = np.where(same, since[sort], c + 1)
                apart = np.flatnonzero(same)
                apart = apart[sort[apart] != sort[apart - 1] + 1]
                if len(apart):                                      # others stood between: the worst of them counts
                    ranges = np.stack((sort[apart - 1] + 1, sort[apart] + 1), axis=1).ravel()
                    now[apart] = np.maximum.reduceat(np.append(since, 0), ranges)[::2]
                since, order = now, order[sort]
            if c + 1 >= length:
                longest = np.minimum(since, np.append(since[1:], c + 1))
                flags[order[longest <= c + 1 - length], c + 1 - length] = True
                if c % 16 == 0:                                     # texts that no longer share their anchor with any
                    alive = np.flatnonzero(longest <= reach)
                    if len(alive) < 0.8 * len(order):
                        if not len(alive):
                            break
                        since = np.maximum.reduceat(since[:alive[-1] + 1], np.append(0, alive[:-1] + 1))
                        order, groups = order[alive], groups[alive]
    return flags


SPANS = "unit int, k1 long, k2 long, a int, b int"


def collection_spans(batches: Iterator[pa.RecordBatch], units: list[Unit]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of a partition of aligned texts sorted by unit and gram hash."""
    def both(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        cut = int(np.searchsorted(t.column(0).to_numpy(), 1))
        for unit, part in enumerate((t.slice(0, cut), t.slice(cut))):
            if part.num_rows:
                yield spans(part.combine_chunks(), unit)

    def spans(t: pa.Table, unit: int) -> pa.RecordBatch:
        length, gram, item = units[unit]
        texts = t.column(6).to_pylist()
        if item > 1:
            texts = [hashes[a:b].tobytes() for hashes, starts, stops, _ in laid_words(texts) for a, b in zip(starts, stops)]
        h, k1, k2, pos, lo = (t.column(i).to_numpy() for i in range(1, 6))
        group = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
        flags = column_wise(group, (pos - lo).astype(np.int64), texts, units[unit])
        edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        r, a = np.nonzero(edge == 1)
        b = np.nonzero(edge == -1)[1]
        base = pos[r] - (length - gram)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(r), unit, dtype=np.int32)), pa.array(k1[r]), pa.array(k2[r]), pa.array((base + a).astype(np.int32)),
            pa.array((base + b - 1 + length).astype(np.int32))], names=["unit", "k1", "k2", "a", "b"])

    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= BATCH_TEXTS:
            h = batch.column(1).to_numpy()
            cut = int(np.argmax(h == h[-1]))         # the last gram may go on in the next batch
            if cut:
                yield from both([*held[:-1], batch.slice(0, cut)])
                held, count = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield from both(held)


def repeated_spans(texts: DataFrame, found: DataFrame, units: list[Unit], hot_rows: int) -> DataFrame:
    """``unit, k1, k2, a, b``: spans (bytes, or words) of the distinct texts that are covered by repeated strings."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, text, runs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                word = word_starts(np.frombuffer(text, dtype=np.uint8)) if any(r["unit"] for r in runs) else None
                for r in runs:
                    lo, hi = r["lo"], r["hi"] + units[r["unit"]].length
                    part = text[word[lo]:word[hi] if hi < len(word) else None] if r["unit"] else text[lo:hi]
                    out.append((r["unit"], r["h"], k1, k2, r["pos"], lo, part))
            for at in range(0, len(out), 4096):
                cols = list(zip(*out[at:at + 4096]))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=["unit", "h", "k1", "k2", "pos", "lo", "part"])

    def aligned(of: DataFrame) -> DataFrame:
        runs = of.groupBy("k1", "k2").agg(F.collect_list(F.struct("unit", "h", "pos", "lo", "hi")).alias("runs"))
        # all columns of texts are taken along, so that this and the last step read one shuffle
        joined = texts.join(runs, ["k1", "k2"]).select("k1", "k2", "text", "runs", "copies", "doc_id")
        return joined.mapInArrow(cut, "unit int, h long, k1 long, k2 long, pos int, lo int, part binary")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, h, k1, k2, pos, lo, part in zip(*(c.to_pylist() for c in batch.columns)):
                data, length = np.frombuffer(part, dtype=np.uint8), units[unit].length
                data = word_hashes(data)[1] if unit else data
                w1, w2 = string_hashes(data, length), string_hashes(data[::-1], length)[::-1]
                n = len(w1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, unit, dtype=np.int32)),
                    pa.array(w1.view(np.int64)), pa.array(np.ascontiguousarray(w2).view(np.int64)), pa.array(np.full(n, k1)),
                    pa.array(np.full(n, k2)), pa.array(np.arange(lo, lo + n, dtype=np.int32))], names=["unit", "w1", "w2", "k1", "k2", "a"])

    found = found.where("unit < 2")
    own = found.where("own").select("unit", "k1", "k2", F.col("lo").alias("a"), (F.col("hi") + units[0].length).alias("b"))
    cold = aligned(found.where(f"NOT own AND n <= {hot_rows}"))
    cold = cold.repartition("h").sortWithinPartitions("unit", "h").mapInArrow(lambda it: collection_spans(it, units), SPANS)
    spans = own.union(cold)
    hot = found.where(f"NOT own AND n > {hot_rows}")
    if hot.limit(1).count():
        hot = aligned(hot).mapInArrow(strings, "unit int, w1 long, w2 long, k1 long, k2 long, a int")
        twice = hot.groupBy("unit", "w1", "w2").agg(F.count("*").alias("times")).where("times > 1")
        length = F.element_at(F.array(*(F.lit(u.length) for u in units)), F.col("unit") + 1)
        hot = hot.join(twice, ["unit", "w1", "w2"]).select("unit", "k1", "k2", "a", (F.col("a") + length).alias("b"))
        spans = spans.union(hot)
    return spans


def shared_words(text: bytes, first: list, length: int) -> int:
    """Words under passages of ``length`` words; ``first``: word spans of the first of equal passages each."""
    hashes = string_hashes(word_hashes(np.frombuffer(text, dtype=np.uint8))[1], length)
    marked = np.zeros(len(hashes), dtype=bool)
    for s in first:
        marked[s["a"]:s["b"] - length + 1] = True
    edge = np.zeros(len(hashes) + length, dtype=np.int64)
    again = np.flatnonzero(np.isin(hashes, hashes[marked]))
    edge[again] += 1
    edge[again + length] -= 1
    return int((np.cumsum(edge) > 0).sum())


def without_spans(batches: Iterator[pa.RecordBatch], passage: int | None) -> Iterator[pa.RecordBatch]:
    """Bytes that stay of each text (columns doc_id, text, spans, words; null spans: all), and the number of maximal removed runs."""
    for batch in batches:
        kept, removed, runs, shared = [], [], [], []
        for text, spans, first in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            merged: list[list[int]] = []
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            ends = [0, *(x for s in merged for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
            removed.append(sum(b - a for a, b in merged))
            runs.append(len(merged))
            shared.append(shared_words(text, first, passage) if first else 0)
        sizes = [len(k) + n for k, n in zip(kept, removed)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), pa.array(kept, pa.binary()),
             pa.array(shared, pa.int64())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_shared_words"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 64,
                   hot_rows: int = 50_000, passage: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary, the remaining bytes) for every row.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in
    this text or another. Null texts count as empty, texts under ``length`` bytes keep all,
    copies of a text of that size keep nothing; null ids and repeated rows are rows like
    others (a repeated row is a copy); an empty table gives no rows. Only the two named
    columns are read. Equal texts are one text, told by a 128-bit hash and not by id; a text
    without copies takes its id along, so the texts are shuffled once and not brought
    together with the rows again. Texts are limited to 2^31 bytes by Spark's rows.

    With ``passage``, a further column ``n_shared_words`` counts the words that lie in a run
    of that many words which stands in another row's text too, whatever its bytes and the
    white space between; nothing is removed for it. A text's word hashes are held whole.
    """
    units = [Unit(length, gram, 1)] + ([Unit(passage, min(WORD_GRAM, passage), 8)] if passage else [])
    least = min(length, 2 * passage - 1) if passage else length      # bytes of the shortest text that can repeat anything
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"),
        F.octet_length("text").cast("long").alias("n_bytes"))
    long_rows = rows.where(F.col("n_bytes") >= least)
    found = anchors(long_rows.select("k1", "k2", "text"), units)
    place = F.xxhash64("k1", "k2", F.when(F.col("unit") == 0, F.col("pos")))     # a passage counts in another text only
    same = Window.partitionBy("unit", "h")
    found = found.select("*", F.min(place).over(same).alias("p"), F.max(place).over(same).alias("q"), F.max("own").over(same).alias("o"),
                         F.count("*").over(same).alias("n")).where("p <> q OR o OR unit = 2 AND n > 1")
    found = saved(found.drop("p", "q", "o").distinct())
    release(docs.sparkSession)                  # the anchors' shuffle files, before texts are moved

    texts = long_rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"), F.first("doc_id").alias("doc_id"))
    spans = repeated_spans(texts, found, units, hot_rows)
    span = F.struct("a", "b")
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.when(F.col("unit") == 0, span)).alias("spans"),
                                          F.collect_list(F.when(F.col("unit") == 1, span)).alias("words"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(of: DataFrame) -> DataFrame:
        return of.select("doc_id", "text", "spans", "words").mapInArrow(
            lambda it: without_spans(it, passage),
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_shared_words long")

    def whole(of: DataFrame, removed, runs, kept, shared) -> DataFrame:
        return of.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.lit(runs).cast("long").alias("n_spans"),
                         kept.alias("kept"), shared.cast("long").alias("n_shared_words"))

    copied = found.where("unit = 2 AND n > 1").select("k1", "k2", F.col("hi").alias("n_words"))
    copies = long_rows.join(copied, ["k1", "k2"])
    n_shared = F.when(F.col("n_words") >= passage, F.col("n_words")).otherwise(0) if passage else F.lit(0)
    removed = whole(copies.where(F.col("n_bytes") >= length), F.col("n_bytes"), 1, F.lit(b""), n_shared)
    short = whole(rows.where(F.col("n_bytes") < least), F.lit(0), 0, F.col("text"), F.lit(0))
    out = cut(texts.where("copies = 1").join(spans, ["k1", "k2"], "left")).union(removed).union(short)
    if passage:
        out = out.union(whole(copies.where(F.col("n_bytes") < length), F.lit(0), 0, F.col("text"), n_shared))
    return out if passage else out.drop("n_shared_words")
