"""PII surrogates: detected entities get keyed replacements of the same type and format.

Entities are found by pattern, brought to a canonical form (so that two spellings of one
number are one entity), and every distinct entity of the corpus gets one surrogate: a keyed
pseudorandom value of the same type, so mentions stay coreferent. A person's first and family
names are entities of their own, so a family name has one surrogate with and without a first
name before it. Surrogates that two
entities share, or that equal a real entity, are drawn again until none is left; the check
is a distributed aggregate over the distinct entities.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import saved
from docpipe.llm.linetemplates import content_key

#: Titles that tell a name's gender, by gender (fixed values).
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
    "n": ("Dr", "Prof", "Professor"),
}
#: First names and syllables of family names by script, first names by gender (fixed values).
NAMES = {
    "latin": {"f": "Anna Clara Elena Irene Julia Laura Maria Nora Sofia Vera",
              "m": "Adrian Bruno David Emil Hugo Leon Martin Oscar Paul Viktor",
              "parts": "ba do fen gar hol jan ker lin mor nau per ros sel tor vin wel"},
    "cyrillic": {"f": "Анна Вера Елена Ирина Мария Нина Ольга София Татьяна Юлия",
                 "m": "Антон Борис Виктор Денис Иван Кирилл Максим Олег Павел Роман",
                 "parts": "ба вол гор дем ер жар зим кал лес мор нов пет рос сол тар"},
    "greek": {"f": "Άννα Ελένη Ειρήνη Ζωή Κατερίνα Μαρία Νίκη Σοφία",
              "m": "Ανδρέας Γιάννης Δημήτρης Κώστας Νίκος Παύλος Πέτρος Σπύρος",
              "parts": "βα γαλ δημ ζαν θεο καρ λου μαν νικ παπ ρος σιν τσα φωτ"},
}
#: Endings of made-up first names by script and gender (fixed values; "n": a title that tells none).
ENDINGS = {"latin": {"f": "a", "m": "o", "n": "e"}, "cyrillic": {"f": "а", "m": "", "n": "е"}, "greek": {"f": "α", "m": "ος", "n": "ι"}}
ALL_TITLES = sorted((t for group in TITLES.values() for t in group), key=len, reverse=True)
#: Detectors in order of precedence. Group 1 is the entity.
DETECTORS = [
    ("email", re.compile(r"(?<![\w.+-])([A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?![\w-])", re.A)),
    ("key", re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9+/_.-]{8,})")),
    ("ip", re.compile(r"(?<![\d.])((?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3})(?![\d]|\.\d)")),
    ("card", re.compile(r"(?<![\d-])(\d(?:[ -]?\d){12,18})(?![\d-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)", re.A)),
    ("name", re.compile(r"(?<!\w)(?:" + "|".join(ALL_TITLES) + r")\.? ([^\W\d_]+(?: [^\W\d_]+)?)")),
]
#: Any text with an entity matches this; others are not sent to Python.
MAY_HOLD = r"[0-9@=:]|\b(?:" + "|".join(ALL_TITLES) + r")\b"


def luhn(digits: str) -> int:
    """Check sum of a card number; 0 if it is valid."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10


def iban_ok(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def looks_secret(value: str) -> bool:
    """The value is no plain word: it mixes kinds of characters, or is long, and is not monotonous."""
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    word = re.fullmatch("[A-Z]?[a-z]+|[A-Z]+", value) or re.fullmatch("[A-Za-z]+([._/-][A-Za-z]+)+", value)
    bits = -sum(n * math.log2(n / len(value)) for n in Counter(value).values())
    return bits >= 16 and (kinds > 1 and not word or len(value) >= 24 and not word)


def script_of(word: str) -> str:
    first = ord(word[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 or 0x1F00 <= first < 0x2000 else "latin"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Entities of a text in order, not overlapping: start, end, type, canonical form."""
    taken: list[tuple[int, int, str, str]] = []
    for kind, pattern in DETECTORS:
        for m in pattern.finditer(text):
            a, b = m.span(1)
            value = m[1]
            if kind in ("card", "ssn", "phone"):
                canonical = re.sub(r"\D", "", value)
                if kind == "card" and luhn(canonical) or kind == "phone" and not 7 <= len(canonical) <= 15:
                    continue
            elif kind == "iban":
                canonical = value.replace(" ", "")
                if not 15 <= len(canonical) <= 34 or not iban_ok(canonical):
                    continue
            elif kind == "name":
                words = value.split(" ")
                words = words[:2] if len(words) > 1 and words[1][:1].isupper() else words[:1]
                if not words[0][:1].isupper():
                    continue
                title = m[0].split(" ")[0].rstrip(".")
                gender = next(g for g, titles in TITLES.items() if title in titles)
                end = a + len(" ".join(words))
                if all(end <= x or a >= y for x, y, _, _ in taken):
                    if len(words) == 2:
                        taken.append((a, a + len(words[0]), "first", f"{gender}:{words[0].lower()}"))
                    taken.append((end - len(words[-1]), end, "family", words[-1].lower()))
                continue
            elif kind == "secret" and not looks_secret(value):
                continue
            else:
                canonical = value.lower() if kind == "email" else value
            if all(b <= x or a >= y for x, y, _, _ in taken):
                taken.append((a, b, kind, canonical))
    return sorted(taken)


class Draw:
    """Numbers drawn from a keyed hash of an entity."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.seed = hashlib.blake2b(f"{kind}\0{canonical}\0{attempt}".encode(), key=key, digest_size=32).digest()
        self.pool, self.n = 0, 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 64:
            self.pool = int.from_bytes(hashlib.blake2b(self.seed, salt=self.n.to_bytes(8, "big"), digest_size=64).digest(), "big")
            self.n += 1
        self.pool, found = divmod(self.pool, n)
        return found

    def like(self, c: str) -> str:
        """A character of the same class."""
        for first, size in (("0", 10), ("a", 26), ("A", 26)):
            if first <= c < chr(ord(first) + size):
                return chr(ord(first) + self.below(size))
        return c


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """A canonical value of the same type, format, gender and script."""
    d = Draw(key, kind, canonical, attempt)
    if kind == "email":
        local, domain = canonical.split("@", 1)
        labels = domain.split(".")
        fixed = 2 if labels[-2] == "example" else 1          # the top level, or a reserved domain, stays
        return "".join(map(d.like, local)) + "@" + ".".join(["".join(map(d.like, x)) for x in labels[:-fixed]] + labels[-fixed:])
    if kind == "key":
        return canonical[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[d.below(36)] for _ in canonical[4:])
    if kind == "ip":
        low_high = {1: (0, 10), 2: (10, 100), 3: (100, 256)}
        ranges = [low_high[len(x)] for x in canonical.split(".")]
        return ".".join(str(a + d.below(b - a)) for a, b in ranges)
    if kind == "card":
        body = canonical[0] + "".join(map(d.like, canonical[1:-1]))
        return body + str((10 - luhn(body + "0")) % 10)
    if kind == "iban":
        body = "".join(map(d.like, canonical[4:]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97
        return f"{canonical[:2]}{check:02d}{body}"
    if kind == "phone":
        keep = max(0, len(canonical) - 10)                   # the country code stays
        rest = "".join(map(d.like, canonical[keep:]))
        return canonical[:keep] + str(2 + d.below(8)) + rest[1:]
    if kind == "family":
        parts = NAMES[script_of(canonical)]["parts"].split(" ")
        return "".join(parts[d.below(len(parts))] for _ in range(3 + attempt // 4))
    if kind == "first":                                      # known names first, then made-up ones
        gender, value = canonical.split(":", 1)
        script = script_of(value)
        names, parts = NAMES[script].get(gender, "").split(), NAMES[script]["parts"].split(" ")
        if not attempt and names:
            return f"{gender}:" + names[d.below(len(names))].lower()
        return f"{gender}:" + "".join(parts[d.below(len(parts))] for _ in range(2 + attempt // 4)) + ENDINGS[script][gender]
    if re.fullmatch("[0-9a-f]+", canonical):                 # hexadecimal stays hexadecimal
        return "".join("0123456789abcdef"[d.below(16)] for _ in canonical)
    return "".join(map(d.like, canonical))


def in_format(original: str, kind: str, canonical: str) -> str:
    """The surrogate written as the original is: its separators, its letter case."""
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(canonical)
        return "".join(next(rest, "") if c.isalnum() else c for c in original)
    if kind in ("first", "family"):
        word = canonical.split(":", 1)[-1]
        return word.upper() if original.isupper() and len(original) > 1 else word.title()
    if kind == "email":
        return canonical.upper() if original.isupper() else "".join(
            s.upper() if len(canonical) == len(original) and o.isupper() else s for s, o in zip(canonical, original))
    return canonical


def assigned(entities: DataFrame, key: bytes, rounds: int = 30) -> DataFrame:
    """``kind, canonical, surrogate`` for every distinct entity; surrogates are distinct within a kind and no entity.

    In each round the smallest of the entities that share a surrogate keeps it and the
    others draw again, as do those whose surrogate is a real entity. Where a format has too
    few values left after ``rounds`` rounds, the rest get ``[KIND-hash]``, which is unique.
    """
    @F.pandas_udf("string")
    def draw(kind: pd.Series, canonical: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, *x) for x in zip(kind, canonical, attempt)], dtype=object)

    real = entities.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
    done = saved(entities.select("kind", "canonical", F.lit(0).alias("attempt")).withColumn("surrogate", draw("kind", "canonical", "attempt")))
    for _ in range(rounds):
        first = done.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"), F.count("*").alias("n"))
        first = first.join(real, ["kind", "surrogate"], "left").where("n > 1 OR real")
        clash = done.join(first, ["kind", "surrogate"]).where("real OR canonical <> first").select(
            "kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        clash = saved(clash)
        if not clash.limit(1).count():
            return done.select("kind", "canonical", "surrogate")
        again = clash.withColumn("surrogate", draw("kind", "canonical", "attempt"))
        done = saved(done.join(clash.select("kind", "canonical"), ["kind", "canonical"], "left_anti").unionByName(again))
    unique = F.concat(F.lit("["), F.upper("kind"), F.lit("-"), F.substring(F.sha2(F.concat(F.lit(key.hex()), "canonical"), 256), 1, 32), F.lit("]"))
    return done.join(clash.select("kind", "canonical", F.lit(True).alias("left")), ["kind", "canonical"], "left").select(
        "kind", "canonical", F.when(F.col("left"), unique).otherwise(F.col("surrogate")).alias("surrogate"))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every detected entity replaced, plus ``n_replaced`` (a first and a family name count as two).

    ``key`` is the caller's secret: who has it can compute an entity's surrogate. Names are
    found behind a title only, secrets behind a credential's name if they are no plain word.

    All other columns stay (``n_replaced`` of the input is replaced). Null and empty texts
    stay with 0; repeated rows and null ids are rows like others; an empty table gives no
    rows. Texts meet their surrogates by content hash; texts that can hold no entity (a
    native pattern tells) are neither shuffled nor sent to Python.
    """
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    may = F.coalesce(F.col(text_col).rlike(MAY_HOLD), F.lit(False))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k1, k2, kind, value)
                   for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns))
                   for kind, value in dict.fromkeys((x[2], x[3]) for x in detect(text))]
            cols = list(zip(*out)) or [(), (), (), ()]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["k1", "k2", "kind", "canonical"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                new = {(p["kind"], p["canonical"]): p["surrogate"] for p in pairs}
                out, at = [], 0
                found = detect(text)
                for a, b, kind, value in found:
                    s = new[kind, value]
                    out += [text[at:a], s if s.startswith("[") else in_format(text[a:b], kind, s)]
                    at = b
                texts.append("".join(out) + text[at:])
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())],
                                             names=["doc", "new_text", "n_replaced"])

    held = docs.where(may).select(*content_key(F.col(text_col)), F.col(text_col).alias("t"))
    mentions = saved(held.mapInArrow(find, "k1 long, k2 long, kind string, canonical string").distinct())
    names = assigned(mentions.select("kind", "canonical").distinct(), secret)
    per_text = mentions.join(names, ["kind", "canonical"]).groupBy("k1", "k2").agg(
        F.collect_list(F.struct("kind", "canonical", "surrogate")).alias("pairs")).toDF("p1", "p2", "pairs")

    columns = [c for c in docs.columns if c.lower() != "n_replaced"]
    rows = docs.where(may).select(F.struct(*columns).alias("doc"), F.col(text_col).alias("t"), *content_key(F.col(text_col)))
    rows = rows.join(per_text, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")), "left")
    doc_type = rows.schema["doc"].dataType.simpleString()
    changed = rows.where("pairs IS NOT NULL").select("doc", "t", "pairs").mapInArrow(
        write, f"doc {doc_type}, new_text string, n_replaced int")
    new = [F.col("new_text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in columns]
    same = [F.col("doc").getField(c).alias(c) for c in columns]
    none = F.lit(0).alias("n_replaced")
    return changed.select(*new, "n_replaced").union(rows.where("pairs IS NULL").select(*same, none)).union(
        docs.where(~may).select(*columns, none))
