"""Columns of the input that are named as something inside an operator go through unharmed."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tickertone.llm import bpe, linededup, mixing, neardup, quality

NAMES = ["factor", "cut_symbols", "cut_upper", "__stratum", "__id", "__rows", "__gone", "__none", "__text", "__t1", "__tokens", "__Weight", "weight", "sampled", "home", "first"]
ROWS = [f"Some words of text number {i} that stand in no other text, {i * 7} of them.\nA line of many sites" for i in range(40)] + [None, ""]


@pytest.fixture(scope="module")
def labels(request):
    spark = request.getfixturevalue("spark")
    return spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator", ["quality", "lines", "near", "mix", "sampling", "bpe"])
def test_clashing_columns(spark, docs, labels, operator):
    rows = [(i, text, "en", f"s{i % 10}") for i, text in enumerate(ROWS)]
    run = {
        "quality": lambda d: quality.keep_good(d, labels),
        "lines": linededup.without_boilerplate,
        "near": neardup.first_of_each_group,
        "mix": mixing.mixed_sample,
        "sampling": mixing.with_sampling,
        "bpe": lambda d: bpe.encode(d, public_tokenizers.path("word_bpe_49k.json")),
    }[operator]
    plain = docs(rows)
    replaced = {"weight", "sampled"} if operator == "sampling" else set()
    clashing = plain.select("*", *[F.concat(F.lit(f"{n}/"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    expected, found = run(plain), run(clashing)
    same = [c for c in expected.columns]
    assert sorted(map(str, found.select(*same).collect())) == sorted(map(str, expected.collect()))
    for row in found.select("doc_id", *[n for n in NAMES if n not in replaced]).collect():
        assert all(row[n] == f"{n}/{row.doc_id}" for n in NAMES if n not in replaced)
