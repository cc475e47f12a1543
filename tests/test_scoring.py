import json

import pytest
from pyspark.sql import functions as F

from tickertone.plans.report import batch_report, write_report
from tickertone.plans.scorers import Providers, credential, label_of
from tickertone.plans.scoring import score_articles, score_new_articles, score_requests
from tickertone.schemas import FALLBACK_MODEL, PRIMARY_MODEL
from tickertone.session import settings_for

SCORES = {"h0": 7, "h1": -20, "h2": 19, "h3": 93, "h4": -19, "h5": 20, "h6": -71}


def table_scorer(headlines, region):
    assert 1 <= len(headlines) <= 5
    return [{"score": SCORES.get(h, 0), "sentiment": label_of(SCORES.get(h, 0)), "sentiment_model": f"m:{region}"} for h in headlines]


def articles(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, title string, text string, region string").repartition(3)


def test_batches_keep_their_mapping(spark):
    rows = [(i, f"h{i}", "t", "International") for i in range(7)]
    got = score_articles(articles(spark, rows), table_scorer).orderBy("seq").collect()
    assert [r.sentiment_score for r in got] == [float(SCORES[f"h{i}"]) for i in range(7)]
    assert {r.sentiment_model for r in got} == {"m:International"} and {r.sentiment_language for r in got} == {"English"}
    assert {r.sentiment_confidence for r in got} == {None}


def test_regions_never_share_a_request(spark):
    rows = [(1, "h1", "", "International"), (2, "नयाँ", "", "Nepali"), (3, "h3", "", None), (4, "h4", "", " Nepali ")]
    got = {r.seq: (r.sentiment_model, r.sentiment_language) for r in score_articles(articles(spark, rows), table_scorer).collect()}
    assert got == {1: ("m:International", "English"), 2: ("m:Nepali", "Nepali"), 3: ("m:None", "English"), 4: ("m:Nepali", "English")}


def test_blank_titles_are_not_sent(spark):
    def strict(headlines, region):
        assert headlines == ["नयाँ"]
        return [{"score": 26, "sentiment": "Positive", "sentiment_model": "m"}]

    rows = [(1, " नयाँ ", "body", "Nepali"), (2, " ", "body", None), (3, "", "b", "x"), (4, None, "b", "x")]
    got = {r.seq: r for r in score_articles(articles(spark, rows), strict).collect()}
    assert (got[1].sentiment, got[1].sentiment_score, got[1].sentiment_language, got[1].title) == ("Positive", 26.0, "Nepali", " नयाँ ")
    for seq in (2, 3, 4):
        r = got[seq]
        assert (r.sentiment, r.sentiment_score, r.sentiment_language, r.sentiment_model) == (
            "Unscored", None, "Unknown", "unscored:no-headline@1",
        )


def test_wrong_number_of_results_fails(spark):
    with pytest.raises(Exception, match="0 results for 1 headlines"):
        score_articles(articles(spark, [(1, "x", "", None)]), lambda h, r: []).collect()


def test_empty_input(spark):
    def never(headlines, region):
        raise AssertionError("called")

    assert score_articles(articles(spark, []), never).count() == 0


def test_tasks_option_sets_parallel_requests(spark):
    rows = [(i, f"x{i}", "", "Nepali") for i in range(40)]
    got = score_articles(articles(spark, rows), table_scorer, tasks=3, block_bits=2)
    assert got.count() == 40


def test_dedup_before_scoring(spark):
    rows = [(1, "h1", "first", "x"), (2, "h1", "second", "x"), (3, "h3", "", "x"), (4, None, "", "x"), (5, None, "", "x")]
    stored = spark.createDataFrame([("h3",)], "title string")
    got = score_new_articles(articles(spark, rows), stored, table_scorer).orderBy("seq").collect()
    assert [(r.seq, r.text, r.sentiment) for r in got] == [(1, "first", "Negative"), (4, "", "Unscored")]


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, "h1", None), (2, "नयाँ", "Nepali")], "seq bigint, title string, region string")
    report = batch_report(rows, table_scorer)
    write_report(report, str(tmp_path / "out"))
    docs = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()), key=lambda d: d["title"])
    assert docs[0] == {
        "title": "h1", "region": None, "sentiment": "Negative", "sentiment_score": -20.0, "sentiment_confidence": None,
        "sentiment_language": "English", "sentiment_model": "m:None",
    }
    assert docs[1]["title"] == "नयाँ" and "text" not in docs[1]


def test_only_headlines_reach_python(spark):
    plan = score_articles(articles(spark, [(1, "x", "long body", None)]), table_scorer)._jdf.queryExecution().optimizedPlan().toString()
    python = next(line for line in plan.splitlines() if "MapInArrow" in line or "PythonMapInArrow" in line)
    below = plan[plan.index(python):]
    assert "text#" not in below.split("\n", 2)[1]


def test_wide_rows_move_once(spark, tmp_path):
    articles(spark, [(i, f"h{i}", "t", "x") for i in range(9)]).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("h3",)], "title string").write.parquet(str(tmp_path / "s"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = score_new_articles(spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "s")), table_scorer)
        lines = fresh._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    wide = [i for i, line in enumerate(lines) if "FileScan" in line and "text#" in line]
    assert len(wide) == 1
    above = "\n".join(lines[: wide[0]])
    assert above.count("Exchange hashpartitioning") == 1


def test_providers_get_ready_requests(spark):
    def answer(payload):
        content = payload.get("messages", [{}, {}])[1].get("content") or payload["contents"][0]["parts"][0]["text"]
        items = json.loads(content.split("Headlines:\n")[1])
        return json.dumps({"results": [{"id": i["id"], "score": len(i["headline"])} for i in reversed(items)]})

    def primary(payload, suffix):
        assert suffix in ("", "_NEPALI")
        if suffix == "_NEPALI":
            return {"success": "true", "result": {"response": "{}"}}
        return json.dumps({"success": True, "result": {"response": answer(json.loads(payload))}})

    def fallback(payload, suffix):
        return {"candidates": [{"content": {"parts": [{"text": answer(json.loads(payload))}]}}]}

    rows = [(i, "x" * (i + 17), "", region) for i, region in enumerate([None, "Nepali", None, "Nepali", None, None, None, None])]
    got = score_articles(articles(spark, rows), Providers(primary, fallback)).collect()
    assert {(r.seq, r.sentiment_score, r.sentiment_model) for r in got} == {
        (i, float(i + 17), FALLBACK_MODEL if region else PRIMARY_MODEL) for i, _, _, region in rows
    }

    def down(payload, suffix):
        return {"candidates": []}

    with pytest.raises(Exception, match="primary scorer failed.*fallback scorer failed"):
        score_articles(articles(spark, [(1, "x", "", "Nepali")]), Providers(primary, down)).collect()


def test_credentials_by_suffix():
    secrets = {"TOKEN": " a ", "TOKEN_NEPALI": "b"}
    assert credential("TOKEN", "", secrets) == "a" and credential("TOKEN", "_NEPALI", secrets) == "b"
    with pytest.raises(RuntimeError, match="KEY_NEPALI"):
        credential("KEY", "_NEPALI", secrets)


def test_requests_spread_over_tasks_under_cluster_settings(spark):
    before = {k: spark.conf.get(k, None) for k in settings_for(1)}
    for key, value in {**settings_for(1), "spark.sql.shuffle.partitions": "16"}.items():
        if key != "spark.sql.files.maxPartitionBytes":
            spark.conf.set(key, value)
    try:
        rows = articles(spark, [(i, f"x{i}", "", f"r{i % 3}") for i in range(400)])
        scores = score_requests(rows, table_scorer).withColumn("task", F.spark_partition_id())
        assert scores.select("task").distinct().count() > 8 and scores.count() == 400
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_width_follows_the_bytes():
    assert settings_for(0)["spark.sql.shuffle.partitions"] == "200"
    assert int(settings_for(10**14)["spark.sql.shuffle.partitions"]) * 128 * 2**20 > 0.99 * 10**14
