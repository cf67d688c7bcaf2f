"""Line templates, decontamination and surrogates against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from conftest import SF_ORACLE
from docpipe.llm import decontam, linetemplates, surrogates
from docpipe.llm.queries import op6_line_templates, op8_decontaminate, op9_surrogates

GAP = re.compile(r"[\x20\x09-\x0D]+")


def plain_lines(rows, depth=3, slots=8, alike=0.75, min_docs=10, min_tokens=1):
    """doc text -> text without recurring lines, by the rules over distinct texts."""
    first_id = {}
    for d, t in rows:
        if t is not None:
            first_id[t] = min(first_id.get(t, (True, 0)), (d is None, d or 0))
    parsed = {}
    for text in first_id:
        for n, line in enumerate(text.split("\n")):
            tokens = ["<*>" if re.search("[0-9]", x) else x for x in GAP.split(line) if x]
            if len(tokens) >= min_tokens:
                lead = min(depth, len(tokens))
                rest = len(tokens) - lead
                cuts = [lead + rest * j // slots for j in range(slots + 1)]
                parsed[text, n] = ((len(tokens), *tokens[:lead]), tuple(tuple(tokens[a:b]) for a, b in zip(cuts, cuts[1:])))
    leaf_docs, slot_docs = defaultdict(set), defaultdict(set)
    for (text, _), (leaf, values) in parsed.items():
        leaf_docs[leaf].add(text)
        for j, v in enumerate(values):
            slot_docs[leaf, j, v].add(text)
    template_docs, template_of = defaultdict(set), {}
    for at, (leaf, values) in parsed.items():
        if len(leaf_docs[leaf]) >= min_docs:
            general = tuple(v if len(slot_docs[leaf, j, v]) >= min_docs else None for j, v in enumerate(values))
            constant = sum(v is not None and v != () for v in general)
            filled = sum(v != () for v in values)
            template_of[at] = (leaf, general) if constant >= alike * filled else (leaf, "own", values)
            template_docs[template_of[at]].add(at[0])
    keeper = {t: min(first_id[x] for x in texts) for t, texts in template_docs.items()}
    out = {}
    for text in first_id:
        drop = {n for n in range(text.count("\n") + 1) if (text, n) in template_of
                and len(template_docs[template_of[text, n]]) >= min_docs and first_id[text] != keeper[template_of[text, n]]}
        out[text] = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop), len(drop)
    return out


def test_lines_whole_table_against_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_lines(rows)
    texts = dict(rows)
    got = op6_line_templates(spark, SF_ORACLE).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert (r["text"], r["n_dropped"]) == want[texts[r["doc_id"]]]
    assert sum(r["n_dropped"] for r in got) > 0


def test_lines_templates_generalise_fields(spark):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        name = "".join(rng.choice("abcdef") for _ in range(6))
        rows.append((k, f"intro {name} {k} of its own\nUser {name} logged in from host {k}.{k} at gate three of hall\n{name} tail " + " ".join(
            "".join(rng.choice("ghijkl") for _ in range(5)) for _ in range(6))))
    rows += [(100, "User zed logged in from host 7 at gate three of hall"), (None, None), (101, ""), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_lines int")
    want = plain_lines(rows, min_docs=5, depth=1)
    got = linetemplates.drop_recurring_lines(df, min_docs=5, depth=1).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in got) == Counter(
        (d, *(want[t] if t is not None else (None, 0))) for d, t in rows)
    assert sum(r["n_dropped"] for r in got) >= 59
    assert linetemplates.drop_recurring_lines(df.limit(0)).count() == 0


def test_short_lines_follow_the_same_rule(spark):
    """Lines of one to seven tokens, equal ones and such that differ in their last tokens, against the plain rule."""
    rng = random.Random(12)
    rows = []
    for k in range(40):
        lines = ["End", "All rights reserved.", f"Page {k}", f"{k}", "", " ", "\t one\x0b"]
        for n in range(4, 8):
            lines.append(" ".join([f"lead{n}", "of", "line", *(rng.choice(["x", "x", f"own{rng.random()}"]) for _ in range(n - 3))]))
        rows.append((k, "\n".join(rng.sample(lines, rng.randint(3, len(lines))) + [f"word{rng.random()} alone"])))
    want = plain_lines(rows)
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in linetemplates.drop_recurring_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: want[t] for d, t in rows}
    kept = "\n".join(text for d, (text, _) in got.items()).split("\n")
    assert kept.count("All rights reserved.") == kept.count("End") == 1
    assert sum(x.startswith("word") for x in kept) == 1          # a token with a digit is a field


def test_lines_likeness_counts_filled_slots(spark):
    """Short lines that share only their leading tokens are no template; equal ones are."""
    rows = [(k, f"It was a {'abcdefghijkl'[k]}x\nSo we saw {'abcdefghijkl'[k]}y {'abcdefghijkl'[k]}z\n"
                f"They went on to the {'abcdefghijkl'[k]}v {'abcdefghijkl'[k]}w\nThis line is equal\nThis is a longer equal line\n"
                f"a b c d e f {'abcdefghijkl'[k]}u") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in linetemplates.drop_recurring_lines(df).collect()}
    for d, text in rows:
        lines = text.split("\n")
        assert got[d]["text"] == (text if d == 0 else "\n".join(lines[:3])), d      # 3 of the last line's 4 slots are equal
        assert got[d]["n_dropped"] == (0 if d == 0 else 3)


def plain_leaks(docs, items, shingle=5, least=0.8):
    """(doc, item) -> best similarity over all windows of the item's size."""
    found = {}
    for d, text in docs:
        w = [x for x in GAP.split((text or "").lower()) if x]
        for i, it in items:
            v = [x for x in GAP.split((it or "").lower()) if x]
            if not v or not w:
                continue
            size = min(shingle, len(v))
            want = Counter(tuple(v[k:k + size]) for k in range(len(v) - size + 1))
            for s in range(max(1, len(w) - len(v) + 1)):
                x = w[s:s + len(v)]
                have = Counter(tuple(x[k:k + size]) for k in range(len(x) - size + 1))
                both = sum((want & have).values())
                similarity = both / (sum(want.values()) + sum(have.values()) - both) if have else 0
                if similarity >= least and similarity > found.get((d, i), (0, 0))[0]:
                    found[d, i] = similarity, s
    return found


def test_leaks_against_all_windows(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_ORACLE}/benchmark.parquet").select("item_id", "text").collect()]
    grams = {" ".join(w[k:k + 5]) for _, t in items for w in [[x for x in GAP.split(t.lower()) if x]] for k in range(len(w) - 4)}
    likely = [(d, t) for d, t in docs if any(" ".join(w[k:k + 5]) in grams for w in [[x for x in GAP.split(t.lower()) if x]]
                                             for k in range(len(w)))]      # a window of 0.8 shares a shingle
    want = plain_leaks(likely, items)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in op8_decontaminate(spark, SF_ORACLE).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def test_leaks_edge_cases(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    item = [word() for _ in range(40)]
    edited = item[:20] + ["NEW"] + item[21:]
    items = [(1, " ".join(item)), (2, "two words"), (3, ""), (None, " ".join(item[:12])), (1, " ".join(item)), (4, None)]
    docs = [(1, " ".join([word() for _ in range(30)] + item + [word()])), (2, " ".join(item).upper()), (3, " ".join(edited)),
            (None, "these two words"), (5, None), (6, ""), (7, " ".join(item[2:])), (1, "plain"), (8, "two\n\twords"),
            (9, " ".join(word() for _ in range(40_000)) + " " + " ".join(item)), (10, " ".join(item * 30))]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item int")
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    want = plain_leaks(docs, items)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in decontam.leaking_documents(df, bench).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    clean = decontam.decontaminated(df, bench)
    assert clean.columns == df.columns
    assert sorted((r["doc_id"], (r["text"] or "")[:5]) for r in clean.collect()) == sorted(
        (d, (t or "")[:5]) for d, t in docs if d in (3, 5, 6) and not any(k == d for k, _ in want) or t == "plain")
    assert decontam.leaking_documents(df, bench.limit(0)).count() == 0
    assert decontam.leaking_documents(df.limit(0), bench).count() == 0
    # beyond the broadcast bound the shingles are joined by hash, with the same result
    limit, decontam.MAX_BROADCAST_SHINGLES = decontam.MAX_BROADCAST_SHINGLES, 3
    try:
        again = {(r["doc_id"], r["item_id"]) for r in decontam.leaking_documents(df, bench).collect()}
    finally:
        decontam.MAX_BROADCAST_SHINGLES = limit
    assert again == set(want)


def test_leaks_of_reordered_items(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item, short = [word() for _ in range(100)], [word() for _ in range(60)]
    around = lambda w: " ".join([*(word() for _ in range(30)), *w, *(word() for _ in range(150))])
    swapped, turned = item[50:] + item[:50], item[20:] + item[:20]
    docs = [(1, around(swapped)), (2, around(turned)), (3, " ".join(swapped)), (4, " ".join(word() for _ in range(200)) + " " + " ".join(turned)),
            (5, around(short[30:] + short[:30])), (6, around(item[::-1])), (7, around(item[50:])), (8, " ".join(swapped[:95]))]
    items = [(1, " ".join(item)), (2, " ".join(short))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(docs, items)
    assert {d for d, _ in want} == {1, 2, 3, 4, 5, 8}
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in decontam.leaking_documents(df, bench).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    assert {r["doc_id"] for r in decontam.decontaminated(df, bench).collect()} == {6, 7}


KINDS = {"email": r"[\w.+-]+@[\w-]+(\.[\w-]+)+", "ip": r"\d+(\.\d+){3}", "key": r"AKIA[A-Z0-9]{16}", "card": r"\d{16}"}


def test_surrogates_on_the_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op9_surrogates(spark, SF_ORACLE).collect()}
    assert set(got) == set(texts)
    mapping, total = {}, 0
    for d, text in texts.items():
        old, new = surrogates.detect(text), surrogates.detect(got[d]["text"])
        assert len(old) == got[d]["n_replaced"]
        assert [(k, b - a) for a, b, k, _ in old] == [(k, b - a) for a, b, k, _ in new]    # same type and length in place
        if not old:
            assert got[d]["text"] == text
        for (a, b, kind, value), (x, y, _, after) in zip(old, new):
            assert value not in got[d]["text"]
            assert mapping.setdefault((kind, value), after) == after                        # coreference
            assert re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", text[a:b]))).translate(
                str.maketrans("", "", "aA9")) == got[d]["text"][x:y].translate(str.maketrans("", "", "")) .translate(
                str.maketrans("", "", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
            total += 1
    assert total > 50
    assert len(set(mapping.values())) == len(mapping) and not set(mapping.values()) & {v for _, v in mapping}


def test_surrogates_by_type():
    key = b"k" * 32
    text = ("Mail Jo.Doe@Mail8.example.com or jo.doe@mail8.EXAMPLE.com, call +1 (988) 555-2485 or +1 988 555 2485; card 4539 1488 0343 6467, "
            "IBAN DE89 3704 0044 0532 0130 00, Frau Müller met Mr. John Smith and Господин Иванов; host 10.0.0.255; 078-05-1120; "
            "password=b7db7aa4a5fcc78305")
    found = {(kind, value) for _, _, kind, value in surrogates.detect(text)}
    assert {k for k, _ in found} == {"email", "phone", "card", "iban", "first", "family", "ip", "ssn", "secret"}
    assert len([k for k, _ in found if k in ("email", "phone")]) == 2               # two spellings, one entity
    for kind, value in found:
        new = surrogates.surrogate(key, kind, value, 0)
        assert new != value and new == surrogates.surrogate(key, kind, value, 0)
        if kind == "card":
            assert surrogates.luhn(new) == 0 and len(new) == 16
        if kind == "iban":
            assert surrogates.iban_ok(new) and new[:2] == "DE"
        if kind == "secret":
            assert re.fullmatch("[0-9a-f]{18}", new)
        if kind == "first":
            assert new[0] == value[0] and surrogates.script_of(new[2:]) == surrogates.script_of(value[2:])
        if kind == "family":
            assert surrogates.script_of(new) == surrogates.script_of(value)
    assert surrogates.in_format("+1 (988) 555-2485", "phone", "12345678901") == "+1 (234) 567-8901"


def test_family_names_stay_linked(spark):
    """A family name has one surrogate whatever stands before it; names of one gender get names of it; many stay distinct."""
    texts = ["Mr Martin Smith met Mrs Smith.", "SMITH? No: Mr SMITH and Dr Anna Jones.", "Prof. Lee and Mr. Lee", "Mr smith is no name"]
    texts += [f"Herr {a}{b}ach und Frau {a}{b}a {b}{a}er" for a in ("Kl", "Br", "St", "Fr", "Gr") for b in ("au", "ei", "o", "u", "ie", "a")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = [r["text"] for r in sorted(surrogates.replace_pii(df, "k").collect(), key=lambda r: r["doc_id"])]
    first, family = re.fullmatch(r"Mr (\w+) (\w+) met Mrs \2\.", got[0]).groups()
    assert family != "Smith" and first != "Martin" and re.fullmatch(rf"SMITH\? No: Mr {family.upper()} and Dr (?!Anna)\w+ (?!Jones)\w+\.", got[1])
    assert re.fullmatch(r"Prof\. (\w+) and Mr\. \1", got[2]) and "Lee" not in got[2] and got[3] == texts[3]
    pairs = [re.fullmatch(r"Herr (\w+) und Frau (\w+) (\w+)", t).groups() for t in got[4:]]
    assert len({p[0] for p in pairs} | {p[2] for p in pairs}) == 60 and len({p[1] for p in pairs}) == 30
    assert surrogates.replace_pii(df, "other").where("doc_id = 0").first()["text"] != got[0]


def test_plain_words_are_no_secrets():
    found = lambda text: [x[3] for x in surrogates.detect(text) if x[2] == "secret"]
    assert found("the token: configuration is set") == found("secret: Everything else") == found("password = aaaaaaaa1") == []
    assert found("api_key: some-plain-words here") == []
    assert found('token = "24be64439e3e49cf46b2"') == ["24be64439e3e49cf46b2"] and found("pwd: hunter2Two!") == ["hunter2Two"]


def test_surrogate_collisions_are_drawn_again(spark):
    ips = [f"{a}.{b}.1.{c}" for a in range(1, 10) for b in range(10) for c in range(6)]   # 540 of 10,000 like them
    df = spark.createDataFrame([("ip", x) for x in ips], "kind string, canonical string")
    out = {r["canonical"]: r["surrogate"] for r in surrogates.assigned(df, b"x" * 32).collect()}
    assert set(out) == set(ips) and len(set(out.values())) == len(ips) and not set(out.values()) & set(ips)
    few = spark.createDataFrame([("secret", str(d)) for d in range(10)], "kind string, canonical string")
    out = {r["canonical"]: r["surrogate"] for r in surrogates.assigned(few, b"x" * 32, rounds=2).collect()}
    assert len(set(out.values())) == 10 and not set(out.values()) & set(out)


def test_surrogates_edge_cases(spark):
    rows = [(1, None, 9), (2, "", 9), (None, "a@b.org", 9), (3, "a@b.org", 9), (3, "a@b.org", 9), (4, "plain = 5", 9),
            (5, "x " * 200_000 + "a@b.org", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_replaced int")
    out = surrogates.replace_pii(df, "k")
    assert out.columns == ["doc_id", "text", "n_replaced"]
    got = out.collect()
    assert sorted((r["doc_id"] or 0, r["n_replaced"]) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, 0), (5, 1)]
    mails = {r["text"].split(" ")[-1] for r in got if r["n_replaced"]}
    assert len(mails) == 1 and mails != {"a@b.org"} and next(iter(mails)).endswith(".org")
    assert {r["doc_id"]: r["text"] for r in got}[4] == "plain = 5"
    assert surrogates.replace_pii(df.limit(0), "k").count() == 0
