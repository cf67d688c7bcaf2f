"""Secret scans: patterns, and guess-cost segmentation of values in a credential's place.

Three patterns give the base findings. Beside them, what stands in a credential's place (after
``password is``, ``auth_key:``, in ``scheme://user:value@`` ...) is a finding if it is dear to
guess. Its cost is that of the cheapest segmentation, found by dynamic programming over
the value: dictionary words (cost by rank, doubled for capitals and look-alike characters),
dates, repeats of a shorter string, walks over a keyboard, and brute-force spans between
them. Costs are decimal logarithms of guesses. The dictionary is the most frequent words of
the scanned corpus, a table of bounded size.

A document is scanned where it is read: nothing but word counts is shuffled.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import saved

#: Kinds of finding, in the order in which those of one start are listed.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
#: A greedy run of the pattern's characters from its first place on, of the least length or more.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

#: A credential's place: a name that ends in one of these words and a mark, or a URL's user part.
NAMES = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth|secret)[ _-]?key|auth(?:orization)?"
PLACE = re.compile(rf"""(?:{NAMES})["'`]?[\x20\t]{{0,4}}(?:[:=]{{1,2}}>?|\x20is\x20)[\x20\t]{{0,4}}(?:bearer\x20|basic\x20)?["'`]?([^\s"'`<>,;(){{}}\[\]]{{8,}})""", re.A | re.I)
URL = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s:/@"'<>]{1,64}:([^\s/@"'<>]{8,})@""", re.A | re.I)
PLACE_WORDS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "://")

#: Keyboard rows, each shifted to the right of the one above by half a key.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
KEYS = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
#: Steps from a key to its neighbours: left, right, up left, up right, down left, down right.
STEPS = ((-1, 0), (1, 0), (0, -1), (1, -1), (-1, 1), (0, 1))
ALIKE = str.maketrans("@4301!5$7+", "aaeoiisstt")
DATES = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\3(?:19|20)\d\d))", re.A)
YEARS = re.compile(r"(?=((?:19|20)\d\d))", re.A)
#: Guesses of a date (days of a hundred years, years), and of the choice of one more segment's kind.
DATE_COST, YEAR_COST, KIND_COST = math.log10(36525), 2.0, math.log10(5)
LONGEST_WORD = 24
LONGEST_UNIT = 16


@dataclass
class Dictionary:
    """Words by rank (1: most frequent)."""
    ranks: dict[str, int] = field(default_factory=dict, repr=False)


def word_counts(docs: DataFrame, text_col: str = "text", flush: int = 200_000) -> DataFrame:
    """``word, n``: lower-case runs of three or more of a-z in all texts (A-Z folded), counted before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        find = re.compile(rf"(?<![a-z])[a-z]{{3,{LONGEST_WORD}}}(?![a-z])").findall

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                               names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(find(text.lower()) if text else ())
                if len(counts) > flush:
                    yield told()
        yield told()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", max_words: int = 30_000) -> Dictionary:
    """The most frequent words of all texts, at most ``max_words``: whole classes of like frequency, from the top.

    A class is an eighth of an octave of counts. The classes' sizes reach the driver, then
    the words of the classes that fit, so neither grows with the corpus or its partitions.
    """
    counts = saved(word_counts(docs, text_col).withColumn("class", F.floor(8 * F.log2("n")).cast("int")))
    sizes = sorted(((r["class"], r["count"]) for r in counts.groupBy("class").count().collect()), reverse=True)
    total, least = 0, None
    for k, size in sizes:
        total += size
        if total > max_words:
            break
        least = k
    best = counts.where(F.lit(False) if least is None else F.col("class") >= least).select("n", "word").collect()
    return Dictionary({word: k for k, (_, word) in enumerate(sorted((-r["n"], r["word"]) for r in best), 1)})


# -- segments of a value: (start, end, cost) -----------------------------------------------

def word_segments(value: str, dictionary: Dictionary) -> Iterator[tuple[int, int, float]]:
    plain = "".join(c.lower() if c.isascii() else c for c in value)
    alike = plain.translate(ALIKE)
    for i in range(len(value)):
        for j in range(i + 3, min(i + LONGEST_WORD, len(value)) + 1):
            rank = dictionary.ranks.get(alike[i:j])
            if rank:
                changed = sum(a != b for a, b in zip(plain[i:j], alike[i:j]))
                capital = value[i:j] != plain[i:j]
                yield i, j, math.log10(rank) + math.log10(2) * (changed + capital)


def date_segments(value: str) -> Iterator[tuple[int, int, float]]:
    for pattern, cost in ((DATES, DATE_COST), (YEARS, YEAR_COST)):
        for m in pattern.finditer(value):
            yield m.start(), m.start() + len(m[1]), cost


def walk_segments(value: str) -> Iterator[tuple[int, int, float]]:
    """Every walk of three keys or more from key to neighbouring key; a turn costs the choice of a direction."""
    place = [KEYS.get(c.lower()) if c.isascii() else None for c in value]
    for i in range(len(value) - 2):
        cost, step = math.log10(len(KEYS)), None
        for j in range(i + 1, len(value)):
            a, b = place[j - 1], place[j]
            now = (b[0] - a[0], b[1] - a[1]) if a and b else None
            if now not in STEPS or j - i >= 64:
                break
            cost += math.log10(2) if now == step else math.log10(2 * len(STEPS))
            step = now
            if j - i >= 2:
                yield i, j + 1, cost


def repeat_segments(value: str) -> Iterator[tuple[int, int, int, int]]:
    """Start, end, length of the unit and its number, for the longest repeat of each unit length from each start."""
    n = len(value)
    for unit in range(1, min(LONGEST_UNIT, n // 2) + 1):
        run = 0                                       # characters from here on that equal the one a unit later
        for i in range(n - unit - 1, -1, -1):
            run = run + 1 if value[i] == value[i + unit] else 0
            times = run // unit + 1
            if times >= 2 and times * unit >= 3:
                yield i, i + times * unit, unit, times


def alphabet(value: str) -> int:
    """Characters that a brute-force search of the value would try."""
    size = 0
    for kind, count in ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^A-Za-z0-9]", 33)):
        size += count if re.search(kind, value) else 0
    return size


def guess_cost(value: str, dictionary: Dictionary, longest_exact: int = 4096) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` takes.

    A value of over ``longest_exact`` characters is cut into parts of that length whose costs
    add up: a segment never spans two of them.
    """
    if len(value) > longest_exact:
        return sum(guess_cost(value[k:k + longest_exact], dictionary) for k in range(0, len(value), longest_exact))
    n = len(value)
    per_char = math.log10(max(2, alphabet(value)))
    ending: list[list] = [[] for _ in range(n + 1)]
    for i, j, cost in (*word_segments(value, dictionary), *date_segments(value), *walk_segments(value)):
        ending[j].append((i, cost))
    for i, j, unit, times in repeat_segments(value):
        ending[j].append((i, cheapest(value[i:i + unit], dictionary) + math.log10(times)))
    best, brute = [0.0] * (n + 1), [math.inf] * (n + 1)
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1], best[j - 1] + KIND_COST) + per_char
        best[j] = min([brute[j], *(best[i] + KIND_COST + cost for i, cost in ending[j])])
    return best[n]


def cheapest(unit: str, dictionary: Dictionary) -> float:
    """Cost of a repeated unit: one word, or brute force."""
    brute = len(unit) * math.log10(max(2, alphabet(unit)))
    return min([brute, *(cost for i, j, cost in word_segments(unit, dictionary) if j - i == len(unit))])


# -- findings ------------------------------------------------------------------------------

def base_spans(text: str, least: int = 12) -> list[tuple[int, str, int]]:
    """Start, kind and end of the base findings."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= least]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def guessed_spans(text: str, base: list[tuple[int, str, int]], dictionary: Dictionary, min_cost: float) -> list[tuple[int, str, int]]:
    """Values in a credential's place, apart from all base findings and each other, that cost ``min_cost`` or more."""
    low = text.lower()
    if not any(w in low for w in PLACE_WORDS):
        return []
    taken: list[tuple[int, int]] = []
    for a, _, b in base:                              # sorted by start; overlapping ones become one
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    found: list[tuple[int, str, int]] = []
    for a, b in sorted({m.span(1) for p in (PLACE, URL) for m in p.finditer(text)}):
        while b > a and text[b - 1] in ".:!?":        # the end of a sentence
            b -= 1
        k = bisect.bisect_left(taken, (b, 0))
        free = (not k or taken[k - 1][1] <= a) and (not found or found[-1][2] <= a)
        if free and b - a >= 8 and guess_cost(text[a:b], dictionary) >= min_cost:
            found.append((a, "guess", b))
    return found


def find_secrets(docs: DataFrame, dictionary: Dictionary, id_col: str = "doc_id", text_col: str = "text",
                 min_cost: float = 10.0) -> DataFrame:
    """``doc_id`` and ``spans`` of every row: kind, start, end (code points, end exclusive) and value of each finding.

    Base findings are leftmost and non-overlapping within their kind: ``assign`` (the whole
    assignment, its value 12 characters or more), ``access`` (18 or more), ``hex`` (16 or more).
    ``guess`` adds values of 8 characters or more in a credential's place that cost
    10 ** ``min_cost`` guesses or more and touch no base finding. Spans sort by start, then
    kind in that order. Null and empty texts have none; null ids and repeated rows are rows
    like others; an empty table gives no rows; only the two named columns are read. Whole
    texts are scanned, whatever their length.
    """
    words = docs.sparkSession.sparkContext.broadcast(dictionary.ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(words.value)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                spans = sorted(base + (guessed_spans(text, base, known, min_cost) if text else []),
                               key=lambda s: (s[0], KINDS.index(s[1])))
                out.append([{"kind": kind, "start": a, "end": b, "value": text[a:b]} for a, kind, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, SPANS)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long, value: string>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def listed(spans, base_only: bool = False):
    """``kind:start:end`` of the spans (Column), comma-joined."""
    chosen = F.filter(spans, lambda s: s.kind != "guess") if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(
        ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")
