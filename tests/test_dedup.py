from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tickertone.operators.dedup import first_per_title, new_articles, stored_hits
from tickertone.operators.sizes import broadcast_within

TITLES = st.sampled_from([None, "", " ", "A", " A", "a", "B"])


def articles(spark, titles):
    rows = [(i, t, f"body {i}") for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "seq bigint, title string, text string").repartition(3)


def stored(spark, titles):
    return spark.createDataFrame([(t,) for t in titles], "title string")


def first_of(titles, seen=()):
    seen, kept = set(seen), []
    for i, title in enumerate(titles):
        if title not in seen:
            seen.add(title)
            kept.append((i, title, f"body {i}"))
    return kept


def test_first_body_wins_and_stored_titles_are_left_out(spark):
    titles = ["seen before", "fresh", "fresh", "other"]
    got = new_articles(articles(spark, titles), stored(spark, ["seen before"]))
    assert sorted(map(tuple, got.collect())) == [(1, "fresh", "body 1"), (3, "other", "body 3")]


def test_null_is_a_title_of_its_own(spark):
    titles = [None, "", None, "x"]
    assert sorted(r.seq for r in first_per_title(articles(spark, titles)).collect()) == [0, 1, 3]
    assert sorted(r.seq for r in new_articles(articles(spark, titles), stored(spark, [None])).collect()) == [1, 3]
    assert sorted(r.seq for r in new_articles(articles(spark, titles), stored(spark, [""])).collect()) == [0, 3]


@settings(max_examples=5, deadline=None)
@given(st.lists(TITLES, max_size=25), st.lists(TITLES, max_size=4))
def test_agrees_with_a_plain_loop(spark, titles, known):
    got = new_articles(articles(spark, titles), stored(spark, known))
    assert sorted(map(tuple, got.collect())) == first_of(titles, known)


def test_hits(spark):
    hits = stored_hits(stored(spark, ["a", "a", None, "z"]), articles(spark, ["a", None, "b"]))
    assert {r.title for r in hits.collect()} == {"a", None} and hits.count() == 2


def test_broadcast_needs_a_checked_size(spark):
    small, large = spark.range(10), spark.range(11)
    shown = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in shown(broadcast_within(small, 10))
    assert "broadcast" not in shown(broadcast_within(large, 10))


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_move_once(spark, tmp_path):
    """Dedup and anti join share one shuffle, and copies are folded before it."""
    articles(spark, ["a", "b", "a", None]).write.parquet(str(tmp_path / "a"))
    stored(spark, ["b"]).write.parquet(str(tmp_path / "s"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = new_articles(spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "s")))
        plan = physical(fresh)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2  # articles once, stored titles once
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert "LeftAnti" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
