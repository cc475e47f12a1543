import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from tickertone.operators.batching import assign_batches, form_requests, number_rows, pending_headlines


def pending(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, region_key string, headline string").repartition(5)


def plain_batches(rows, size=5):
    got, count = {}, {}
    for seq, region, text in sorted(rows):
        n = count.get(region, 0)
        got[seq] = (region, n // size, n % size + 1)
        count[region] = n + 1
    return got


@settings(max_examples=4, deadline=None)
@given(st.sets(st.integers(-(2**40), 2**53), max_size=60), st.integers(0, 40), st.randoms())
def test_numbering_agrees_with_a_plain_loop(spark, seqs, bits, rnd):
    rows = [(s, rnd.choice(["", "Nepali", "Nepali", "Nepali", "X"]), f"h{s}") for s in seqs]
    got = assign_batches(pending(spark, rows), block_bits=bits).collect()
    assert {r.seq: (r.region_key, r.batch_no, r.item_id) for r in got} == plain_batches(rows)


def test_hot_region_spreads_over_blocks(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 10 == 0, "a").otherwise("hot").alias("region_key")
    )
    numbered = number_rows(rows, "region_key", block_bits=8)
    hot = numbered.where("region_key = 'hot'").agg(F.min("position"), F.max("position"), F.countDistinct("position")).first()
    assert tuple(hot) == (0, 17_999, 18_000)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Cartesian" not in plan


def test_sparse_numbers_are_counted_in_small_groups(spark):
    # Each number is a block of its own, so the blocks are as many as the rows.
    spread = F.expr("(id - 2000) * 1125899906842624 + pmod(xxhash64(id), 1125899906842624)")
    rows = spark.range(4_000).select(spread.alias("seq"), F.when(F.col("id") % 7 == 0, "a").otherwise("hot").alias("region_key"))
    numbered = number_rows(rows, "region_key", block_bits=8, level_bits=6)
    plain = Window.partitionBy("region_key").orderBy("seq")
    assert numbered.withColumn("plain", F.row_number().over(plain) - 1).where("plain <> position").count() == 0
    assert numbered.count() == 4_000
    hot = rows.where("region_key = 'hot'").groupBy(F.shiftright("seq", 14)).count().agg(F.max("count")).first()[0]
    assert hot <= 64
    # A window over all blocks of a region stands only at the top level, whose numbers have six bits at most.
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan)
    assert sum("," not in keys for keys in windows) == 1
    assert sum("_group" in keys for keys in windows) == 9


def test_requests_of_five_and_two(spark):
    rows = [(i, "Nepali", f"h{i}") for i in random.Random(1).sample(range(7), 7)]
    got = form_requests(assign_batches(pending(spark, rows))).orderBy("batch_no").collect()
    assert [(r.batch_no, r.seqs, r.headlines) for r in got] == [
        (0, [0, 1, 2, 3, 4], ["h0", "h1", "h2", "h3", "h4"]),
        (1, [5, 6], ["h5", "h6"]),
    ]


def test_pending_strips_and_skips_blanks(spark):
    rows = spark.createDataFrame(
        [(1, " a ", " Nepali "), (2, None, None), (3, " \t", "x"), (4, "b", None)], "seq bigint, title string, region string"
    )
    got = sorted(map(tuple, pending_headlines(rows).collect()))
    assert got == [(1, "Nepali", "a"), (4, "", "b")]


def test_a_row_without_a_number_is_an_error(spark):
    with pytest.raises(Exception, match="a row has no seq"):
        assign_batches(pending(spark, [(None, "", "a"), (1, "", "b")])).collect()
