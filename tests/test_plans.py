"""Plans of the registered queries: no cross products, pruned scans, bounded broadcasts."""

import pytest

from workload import queries, tables

SF_DIR = "/root/testdata/sf0.001"
LAZY = [name for name in queries.registered() if not name.startswith("stream_")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", LAZY)
def test_large_inputs_shuffle(spark, no_broadcast, name):
    """With size-based broadcasts off, what is still broadcast has a checked size."""
    plan = plan_of(queries.registered()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    checked = name in ("article_tagged", "article_build", "indexed_title_lookup")
    assert checked or "BroadcastExchange" not in plan


def test_article_text_is_read_only_where_used(spark):
    rows = tables.articles(spark, SF_DIR)
    plan = plan_of(rows.select("seq", "published_at"))
    assert "text" not in plan.split("ReadSchema")[1] + plan.split("ReadSchema")[2]


def test_spread_documents_are_the_join_shuffle(spark, no_broadcast):
    assert plan_of(tables.articles(spark, SF_DIR)).count("Exchange hashpartitioning") == 2
