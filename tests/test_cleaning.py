"""The cleaner and emphasis expressions against the sequential model and edge tables."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import seqmodel as M
from docpipe.constants import BLOCK_INDICATORS, CHATTER_PHRASES
from docpipe.functions import cleaning as C
from docpipe.functions.emphasis import enhance_formatting
from pyspark.sql import functions as F

ALPHABET = [
    "---", " --- ", "All formatting has been preserved as requested.", "```", "```markdown", " ``` ",
    "", "   ", "\t", "text line", "Some damage here", "<!-- Pages 1-3 -->", " <!-- Pages 4 --> ",
    "<!-- ERROR: Chunk 2 failed: 504 -->", "remove this", "- **Bold** text converted to `**bold**`",
    "HERE IS THE PDF CONVERTED TO MARKDOWN FORMAT:", "x" * 49, "y" * 50, "- dash line",
    "equipment descriptions preserved as", " ", "state of things", "**bold** markdown",
]


def run(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    return [r.out for r in df.select("id", expr(F.col("content")).alias("out")).orderBy("id").collect()]


def random_docs(seed, n):
    rnd = random.Random(seed)
    docs = []
    for _ in range(n):
        k = rnd.randint(0, 30)
        docs.append("\n".join(rnd.choice(ALPHABET) for _ in range(k)))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_documents_match_sequential_model(spark, seed):
    docs = random_docs(seed, 400) + [None, ""]
    got = run(spark, docs, lambda c: C.clean_response(c, True))
    got_keep = run(spark, docs, lambda c: C.clean_response(c, False))
    blocks = run(spark, docs, C.remove_confirmation_blocks)
    for d, g, gk, b in zip(docs, got, got_keep, blocks):
        assert g == M.clean(d, True), repr(d)
        assert gk == M.clean(d, False), repr(d)
        if d is not None:
            assert b == M.block_pass(d), repr(d)


line = st.sampled_from(ALPHABET) | st.text(alphabet=" -`abc\n ", max_size=8)


@settings(max_examples=40, deadline=None)
@given(st.lists(line, max_size=25))
def test_hypothesis_documents(spark, lines):
    doc = "\n".join(lines)
    assert run(spark, [doc], lambda c: C.clean_response(c, True)) == [M.clean(doc, True)]


def block(lines):
    return "\n".join(["---"] + lines + ["---"])


def test_block_line_limit(spark):
    ind = "all formatting has been preserved as requested"
    fifteen = block([ind] + ["ok"] * 12)           # 15 lines with both markers
    sixteen = block([ind] + ["ok"] * 13)           # 16 lines
    out = run(spark, [fifteen, sixteen], C.remove_confirmation_blocks)
    assert out == ["", sixteen]


def test_block_residual_limit(spark):
    ind = "all formatting has been preserved as requested"
    r49 = block([ind, "z" * 49])
    r50 = block([ind, "z" * 50])
    out = run(spark, [r49, r50], C.remove_confirmation_blocks)
    assert out == ["", r50]


def test_block_subject_substring(spark):
    doc = block(["all formatting has been preserved as requested", "remove"])
    assert run(spark, [doc], C.remove_confirmation_blocks) == [doc]   # 'remove' contains 'move'


def test_unclosed_block_kept_and_pairing(spark):
    doc = "a\n---\nall formatting has been preserved as requested\n---\n---\nb"
    assert run(spark, [doc], C.remove_confirmation_blocks) == ["a\n---\nb"]


def test_blank_after_fence_after_trigger(spark):
    doc = "Formatting preserved as requested.\n```\n\nkept"
    assert run(spark, [doc], C.remove_chatter_lines) == ["kept"]


def test_all_lines_dropped_gives_empty(spark):
    assert run(spark, ["```markdown\n```\n\nFormatting preserved as specified."],
               lambda c: C.clean_response(c)) == [""]


def test_phrase_lists_have_expected_sizes():
    assert len(CHATTER_PHRASES) == 32 and len(BLOCK_INDICATORS) == 15


@pytest.mark.parametrize("text,expected", [
    ("When you act: roll+hard, ok", "When you **act: roll+****hard******, ok"),
    ("coolé hard_ sharp", "coolé hard_ **sharp**"),
    ("", ""),
])
def test_emphasis_examples(spark, text, expected):
    assert run(spark, [text], enhance_formatting) == [expected]


def test_emphasis_matches_sequential_model(spark):
    rnd = random.Random(7)
    words = ["When", "you", "act", "roll+hot", "HX", "Cool", "sharp,", "weird:", "hard", "é", ",", ":",
             "roll+élan", "hotter", "\n"]
    docs = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 20))) for _ in range(300)]
    got = run(spark, docs, enhance_formatting)
    assert got == [M.enhance(d) for d in docs]


def test_python_strip_on_unicode_white_space(spark):
    from docpipe.constants import PY_WHITESPACE_CHARS
    from docpipe.functions.text import is_blank, py_strip
    samples = ["　abc \x1c", "  x y ", "\x85\t\r\n", "é ü", "​zero-width​",
               PY_WHITESPACE_CHARS + "mid" + PY_WHITESPACE_CHARS, ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    rows = df.select("i", py_strip(F.col("s")).alias("t"), is_blank(F.col("s")).alias("b")).orderBy("i").collect()
    assert [r.t for r in rows] == [s.strip() for s in samples]
    assert [r.b for r in rows] == [not s.strip() for s in samples]


odd_line = st.sampled_from(ALPHABET) | st.builds(
    lambda a, b: a + b, st.sampled_from(["---", "```", "", "x", "Formatting preserved as specified."]),
    st.sampled_from(["\r", " ", "\x85", "\xa0", "\x1c", " ", "\t"]))


@settings(max_examples=25, deadline=None)
@given(st.lists(odd_line, max_size=25))
def test_hypothesis_line_terminators_inside_lines(spark, lines):
    doc = "\n".join(lines)
    assert run(spark, [doc], lambda c: C.clean_response(c, True)) == [M.clean(doc, True)]
    assert run(spark, [doc], lambda c: C.clean_response(c, False)) == [M.clean(doc, False)]
