"""Narrow results go to where the wide rows are, and what is written is packed."""

import os

import pytest
from pyspark.sql import functions as F

from tickertone.operators.dedup import first_per_title, new_articles
from tickertone.plans.scorers import label_of
from tickertone.plans.scoring import score_articles
from tickertone.session import use_placement
from tickertone.sources.ledger import ResponseLedger
from tickertone.sources.topic import read_topic_files, write_topic_files
from workload import queries
from workload.scorer import fixture_score

SF_DIR = "/root/testdata/sf0.001"
ARTICLE = "seq bigint, title string, text string, region string, place string"


def scorer(headlines, region):
    return [{"score": len(h), "sentiment": label_of(len(h)), "sentiment_model": f"m:{region}"} for h in headlines]


@pytest.fixture
def placed(spark):
    name, size = "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    yield use_placement(spark)
    spark.conf.set(size, before)
    spark.conf.unset(name)


def above_the_text(df):
    """The operators above the first scan of the documents, whose text the articles get, from the top down."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "text#" in line)
    depth, found = lines[at].index("- "), []
    for line in reversed(lines[:at]):
        place = line.find("- ") if line.lstrip(" :+").startswith("- ") else -1
        if 0 <= place < depth:
            depth = place
            found.append(line[place + 2 :])
    return found[::-1]


@pytest.mark.parametrize("name", ["scored_articles", "batch_score_report"])
def test_scores_go_to_the_articles(spark, placed, name):
    path = above_the_text(queries.registered()[name](spark, SF_DIR))
    assert sum("Exchange" in step for step in path) == 1 and any("LeftOuter" in step for step in path)


@pytest.mark.parametrize("name", ["first_occurrence", "new_articles"])
def test_only_first_articles_are_sorted(spark, placed, name):
    path = above_the_text(queries.registered()[name](spark, SF_DIR))
    semi = next(i for i, step in enumerate(path) if "LeftSemi" in step)
    assert "WindowGroupLimit" in "".join(path[:semi]) and "WindowGroupLimit" not in "".join(path[semi:])
    # Below it the rows are spread and sorted for the join that makes them, and not again.
    assert [sum(kind in step for step in path[semi:]) for kind in ("Exchange", "Sort [")] == [1, 1]


def test_no_task_sorts_titles_to_find_first_articles(spark, placed):
    plan = queries.registered()["first_occurrence"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    narrow = plan[plan.index("REPARTITION_BY_COL", plan.index("LeftSemi") + 1) :]
    assert "WindowGroupLimit" not in narrow and "SortAggregate" not in narrow and narrow.count("HashAggregate") == 2


def articles(spark, rows):
    return spark.createDataFrame(rows, ARTICLE).repartition("place")


# Equal titles far apart, a null number, one number twice, and a number twice under other titles.
ROWS = [
    (5, "a", "later", None, "x"), (2, "a", "first", "Nepali", "y"), (2, "b", "same number", None, "y"),
    (4, None, "untitled", None, "x"), (9, None, "again", None, "y"), (7, "", "", None, "z"), (None, "c", "no number", None, "x"),
    (1, "c", "", None, "z"), (6, " d ", "", "Nepali", "z"), (8, "e", "twice", None, "x"), (8, "e", "twice", None, "x"),
]


def test_first_rows_are_the_same_wherever_they_lie(spark, placed):
    rows = articles(spark, ROWS)
    got = sorted(first_per_title(rows, near="place").collect(), key=str)
    assert got == sorted(first_per_title(rows).collect(), key=str) and len(got) == 7
    assert {r.title: r.text for r in got}["c"] == "no number"
    stored = spark.createDataFrame([("a",), (None,)], "title string")
    assert {r.title for r in new_articles(rows, stored, near="place").collect()} == {"", "b", "c", " d ", "e"}


def test_scores_are_the_same_wherever_the_rows_lie(spark, placed, tmp_path):
    rows = articles(spark, [row for row in ROWS if row[0]])
    plain = sorted(score_articles(rows.where("seq NOT IN (2, 8)"), scorer).collect(), key=str)
    assert sorted(score_articles(rows.where("seq NOT IN (2, 8)"), scorer, near="place").collect(), key=str) == plain
    ledger = ResponseLedger(spark, str(tmp_path / "paid"))
    kept = score_articles(rows.where("seq NOT IN (2, 8)"), scorer, near="place", ledger=ledger, batch="b")
    assert sorted(kept.collect(), key=str) == plain
    # A number that comes twice meets its scores as often as before.
    assert sorted(score_articles(rows, scorer, near="place").collect(), key=str) == sorted(score_articles(rows, scorer).collect(), key=str)


def test_a_row_that_lies_nowhere_is_an_error(spark, placed):
    rows = articles(spark, [(1, "a", "", None, None), (2, "b", "", None, "x")])
    with pytest.raises(Exception, match="a row has no place"):
        first_per_title(rows, near="place").collect()
    with pytest.raises(Exception, match="a row has no place"):
        score_articles(rows, scorer, near="place").collect()


def size(folder):
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names)


def test_packed_messages_are_the_same_and_smaller(spark, tmp_path):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("word"), ((F.col("id") * i) % 997).cast("string"))))
    messages = spark.range(2_000).select(F.to_json(F.struct(words.alias("text"))).alias("value")).unionAll(spark.sql("SELECT 'नयाँ'"))
    read = []
    for packed in (False, True):
        folder = str(tmp_path / str(packed))
        write_topic_files(messages, folder, packed=packed)
        stream = read_topic_files(spark, folder, max_files=1, packed=packed).writeStream.format("parquet")
        stream.option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-at").trigger(availableNow=True).start().awaitTermination()
        read.append(sorted(r.value for r in spark.read.parquet(f"{folder}-out").collect()))
    assert read[0] == read[1] and len(read[0]) == 2_001
    assert size(tmp_path / "True") < 0.5 * size(tmp_path / "False")


@pytest.fixture
def run_in(monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "run_folder", lambda spark: str(tmp_path / "run"))
    return tmp_path


def test_titles_come_from_packed_messages(spark, run_in):
    queries.registered()["stream_title_dedup"](spark, SF_DIR)
    files = [name for name in os.listdir(run_in / "run" / "topic") if name.startswith("part-")]
    assert files and all(name.endswith(".zstd.parquet") or name.endswith(".zst.parquet") for name in files)


def test_stored_articles_are_scored_once(spark, run_in, monkeypatch):
    log = str(run_in / "asked")

    def noted(headlines, region=None):
        with open(log, "a") as asked:
            asked.write("".join(f"{h}\n" for h in headlines))
        return [{"score": s, "sentiment": label_of(s), "sentiment_model": "m"} for s in map(fixture_score, headlines)]

    monkeypatch.setattr(queries, "fixture_scorer", noted)
    rows = queries.registered()["stream_scored_store"](spark, SF_DIR).where("sentiment != 'Unscored'").count()
    assert len(open(log).read().splitlines()) == rows > 0
    files = os.listdir(run_in / "run" / "topic")
    assert any(name.endswith(".parquet") for name in files)
