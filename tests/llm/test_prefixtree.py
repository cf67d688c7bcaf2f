"""The prefix trie against brute force, with containers small enough to burst."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from conftest import SF_ORACLE
from docpipe.llm import prefixtree as P
from docpipe.llm.queries import op12_prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, ids string, head string, ends long"


def plain(rows, rebuild=True):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [t[2:] for t in sorted(turns)] for c, turns in by.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in by}
        base = {c: c - (c % 100 if c >= 0 else -(-c % 100)) for c in by}
        by = {c: by.get(base[c], [])[:h[c]] + by[c][h[c]:] for c in by}
    nodes = defaultdict(list)
    for c in sorted(by):
        for d in range(len(by[c]) + 1):
            nodes[tuple(by[c][:d])].append(c)
    children = Counter(k[:-1] for k in nodes if k)
    leaves, tokens = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            tokens[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    return sorted((m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), children[k], leaves[k], tokens[k],
                   hashlib.sha256(",".join(str(c) for c in m if len(by[c]) == len(k)).encode()).hexdigest())
                  for k, m in nodes.items())


def key(row):
    return (row[0], row[1])


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=key)


def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF_ORACLE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got(op12_prefix_trie(spark, SF_ORACLE)) == sorted(plain([tuple(r) for r in rows]), key=key)


ROWS = [(c, t, "user" if t % 2 == 0 else "assistant", f"{'é' * (t + 1)}{c % (2 + t)}") for c in range(100, 160) for t in range(c % 9)]
ROWS += [(c, t, "user", "same") for c in range(300, 340) for t in range(4)]                 # a hot group of copies
ROWS += [(c, t, "user", "same") for c in range(400, 410) for t in range(c - 398)]           # each a prefix of the next
ROWS += [(500, None, None, "n"), (500, 0, "user", None), (500, 0, "user", None), (500, 0, None, "b"), (None, 0, "user", "x"),
         (-7, 0, "user", "same"), (-150, 0, "user", "same"), (7, 0, "user", "a"), (7, 1, "x", "a"), (8, 0, "usera", "")]


@pytest.mark.parametrize("limits", [{}, {"container_rows": 4, "container_turns": 30}, {"container_rows": 1, "container_turns": 1}])
def test_edge_cases(spark, limits):
    turns = spark.createDataFrame([(*r, "x", "y", 1) for r in ROWS], SCHEMA).repartition(5)
    convs = P.sequences(turns)
    assert got(P.trie(convs, **limits)) == sorted(plain(ROWS, rebuild=False), key=key)
    assert got(P.trie(P.with_common_starts(convs), **limits)) == sorted(plain(ROWS), key=key)


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(P.trie(P.with_common_starts(P.sequences(none)))) == []
    # the base 100 is missing and h >= 1 takes the only turn: members of the root that end there
    lone = [c for c in range(101, 120) if zlib.crc32(str(c).encode()) % 6 >= 1][:3]
    rows = [(c, 0, "user", "gone") for c in lone]
    turns = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    assert got(P.trie(P.with_common_starts(P.sequences(turns)))) == plain(rows) and len(plain(rows)) == 1


def test_digest_of_many_ends_comes_from_parts(spark):
    members = spark.range(0, 5000).selectExpr("'k' AS ends", "id AS conv_id").union(spark.sql("SELECT 'z', 3L"))
    out = {r["ends"]: r["ends_sha256"] for r in P.end_digests(members.repartition(7)).collect()}
    assert out == {"k": hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(), "z": hashlib.sha256(b"3").hexdigest()}
