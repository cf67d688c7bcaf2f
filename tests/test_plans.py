"""Physical-plan checks: where shuffles may and may not appear."""

from conftest import SF_SMALL
from docpipe.plans.catalog import REGISTRY


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaner_is_narrow(spark):
    for name in ["clean_response", "clean_blocks", "clean_lines", "enhance_formatting", "markup_to_markdown"]:
        p = plan(REGISTRY[name].run(spark, SF_SMALL))
        assert "Exchange" not in p, name


def test_no_cartesian_products(spark):
    for name, q in REGISTRY.items():
        p = plan(q.run(spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_fanout_needs_no_join(spark):
    p = plan(REGISTRY["approach_fanout"].run(spark, SF_SMALL))
    assert "Join" not in p and "Exchange" not in p


def test_profile_aggregates_partially(spark):
    p = plan(REGISTRY["document_profile"].run(spark, SF_SMALL))
    assert "partial_count" in p and "partial_sum" in p


def test_list_jobs_is_top_k(spark):
    p = plan(REGISTRY["list_jobs"].run(spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p
