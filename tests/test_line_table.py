"""The bucketed lines-table cleaner equals the per-row cleaner, across bucket borders."""

import pytest

import seqmodel as M
from test_cleaning import random_docs
from docpipe.operators.line_table import assemble, clean_line_table, explode_lines


@pytest.mark.parametrize("bucket_lines,seed", [(1, 5), (3, 6), (4096, 7)])
def test_line_table_matches_sequential_model(spark, bucket_lines, seed):
    docs = random_docs(seed, 300) + [None, "", "   \n\t", "---\nall formatting has been preserved as requested\n---"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, content string")
    cleaned = clean_line_table(explode_lines(df), True, bucket_lines=bucket_lines)
    out = {r.doc_id: r.markdown for r in assemble(cleaned, df).collect()}
    for i, d in enumerate(docs):
        assert out[i] == M.clean(d, True), repr(d)


def formatted_plan(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_line_table_plan_never_keys_lines_by_document_alone(spark):
    import re
    df = spark.createDataFrame([(1, "a\n---\nb")], "doc_id long, content string")
    plan = formatted_plan(spark, clean_line_table(explode_lines(df), bucket_lines=2))
    sections = re.split(r"\n\(\d+\) ", plan)
    exchanges = [sec for sec in sections if sec.startswith("Exchange")]
    assert exchanges
    for sec in exchanges:
        inputs = re.search(r"Input \[\d+\]: \[([^\]]*)\]", sec).group(1)
        keys = re.search(r"hashpartitioning\(([^)]*)\)", sec).group(1)
        key_names = {k.strip().split("#")[0] for k in keys.split(",")[:-1]}
        carries_lines = any(c.strip().startswith("line#") for c in inputs.split(","))
        if carries_lines:
            assert key_names != {"doc_id"}, sec
