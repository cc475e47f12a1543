import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tickertone.llm import quality

TEXTS = [
    None, "", " \n\t ", "one", "a b c d e a b c d e", "a a a a a a a", "x y z w v u t s r q\nx y z w v u t s r q\n\nx y z w v u t s r q",
    "p q r s t u p q r s t\n# ### <b> & %\nÄÖ ß", "k\x0bl\x0cm\rn  o\n\nk", "aa bb cc dd ee ff " * 300, " ".join(f"w{i}" for i in range(3000)), "long" * 20_000,
]


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def measured(table):
    rows = quality.with_measures(table).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return {r.doc_id: tuple(r.measures[n] for n in names) for r in rows}


def test_measures(docs):
    assert measured(docs(TEXTS)) == {i: measures(t) for i, t in enumerate(TEXTS)}


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text("ab \n#", max_size=60), min_size=30, max_size=60))
def test_measures_of_any_texts(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert measured(table) == {i: measures(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("k, n, share", [(0, 10, 0.1), (3, 100, 0.05), (0, 200_000, 0.004), (600, 200_000, 0.004), (7, 2000, 0.004)])
def test_binomial_tail(spark, k, n, share):
    got = spark.range(1).select(quality._log_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), share).alias("x")).first().x
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share) for i in range(k + 1)]
    top = max(terms)
    assert got == pytest.approx(top + math.log(sum(math.exp(t - top) for t in terms)), rel=1e-9)


def good_text(i):
    return " ".join(f"w{i}x{k}" for k in range(30)) + "."


def junk_text(i):
    return " ".join(f"W{i}X{k}###" for k in range(30))


def test_cutoffs_keep_their_promise(spark, docs):
    rows = [(i, good_text(i), "en", "a") for i in range(2500)] + [(3000 + i, junk_text(i), "en", "a") for i in range(200)]
    rows += [(4000 + i, junk_text(i), "de", "a") for i in range(20)] + [(4100 + i, good_text(i), "de", "a") for i in range(50)]
    rows += [(5000, junk_text(1), "en", "a"), (5001, junk_text(2), None, "a"), (5002, None, "en", "a"), (None, good_text(9), "en", "a")]
    labels = spark.createDataFrame(
        [(i, int(i < 3000 or i >= 4100), 0) for i, *_ in rows if i is not None and i < 5000] + [(0, 1, 0), (99_999, 0, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int"
    )
    kept = {r.id: r.kept for r in quality.quality_verdicts(docs(rows), labels).collect()}
    assert all(kept[i] for i in range(2500)) and kept[None]
    assert not any(kept[3000 + i] for i in range(200)) and not kept[5000]  # the rule holds for unlabelled rows too
    assert all(kept[4000 + i] for i in range(20)) and kept[5001]  # too few holdouts to promise anything
    assert not kept[5002]
    clash = docs(rows).withColumns({"measures": F.lit(1), "kept": F.lit("x"), "good": F.lit(2), "stratum": F.lit(3)})
    assert quality.keep_good(clash, labels).columns == clash.columns
    stayed = quality.keep_good(docs(rows), labels)
    assert stayed.columns == docs([]).columns
    assert sorted(str(r.doc_id) for r in stayed.collect()) == sorted(str(i) for i, k in kept.items() if k)


def test_no_labels_or_no_documents(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in quality.quality_verdicts(docs([good_text(1), good_text(1), "short"]), none).orderBy("id").collect()] == [True, True, False]
    assert quality.quality_verdicts(docs([]), none).collect() == []
