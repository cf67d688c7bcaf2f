"""Markup to Markdown on hand-worked pages."""

import pytest
from pyspark.sql import functions as F

from docpipe.functions.markup import markup_to_markdown

CASES = [
    ("<p>plain</p>", "plain"),
    ("<b>bold</b> <i>it</i> <b><i>both</i></b> <em><strong>too</strong></em>", "**bold** *it* ***both*** ***too***"),
    # open tags end at the next block or line break
    ("<p><b>Title here<br><p>body <i>slanted</p><p>next", "**Title here**\n\nbody *slanted*\n\nnext"),
    ("<b>x<b>y</b>z", "**x****y**z"),
    ("<b>a <i>c<br>d", "**a *c***\nd"),
    ("<h1>One<p>text</p><h3 class='x'>Three</h3>", "# One\n\ntext\n\n### Three"),
    ("<ul><li>a<li>b</ul>", "- a\n- b"),
    ("<ol><li>a</li><li>b</li></ol><ul><li>c</li></ul>", "1. a\n1. b\n\n- c"),
    ("<table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>b|c</td></tr></table>after",
     "| k | v |\n| --- | --- |\n| a | b\\|c |\n\nafter"),
    ("x<table><tr><td>a<td>b<tr><td><b>c</b><td>d", "x\n\n| a | b |\n| --- | --- |\n| **c** | d |"),
    ("a&nbsp;b &#233; &#xE9; &copy; &amp;lt; &#0; &#x1F600;", "a b é é © &lt; &#0; 😀"),
    ("<script>var t='</p>';</script><style>p{}</style><!-- no --><nav><a>x</a></nav>y", "y"),
    ("<base href='x'><button>press</button><img src=i>", "press"),
    ("", ""), (None, None), ("a < b and c > d", "a < b and c > d".replace("< b and c >", "")),
]


@pytest.mark.parametrize("html,want", CASES)
def test_cases(spark, html, want):
    got = spark.createDataFrame([(html,)], "h string").select(markup_to_markdown(F.col("h"))).first()[0]
    assert (got or "").replace("  ", " ") == (want or "").replace("  ", " ") and (got is None) == (want is None)


def test_long_runs_do_not_exhaust_the_stack(spark):
    text = "word " * 200_000
    got = spark.createDataFrame([("<b>" + text + "<u>x</u>" * 3000 + "<br>end",)], "h string").select(markup_to_markdown(F.col("h"))).first()[0]
    assert got.startswith("**word") and got.endswith("**\nend")
