"""Quality rules whose cutoffs are certified on labelled holdouts.

A rule rejects a text when its measure lies above a cutoff. Cutoffs are tried from the loosest to the
tightest for each stratum and rule; one is certified while the exact binomial test rejects, at the
corrected level, that more than the allowed share of good documents would be lost. Testing in this
fixed order needs no correction over cutoffs; the level is divided over strata and rules, and the
allowed share over rules, so that with the stated confidence no stratum loses more good documents
than allowed. Of the certified cutoffs that with the best balance on the holdout is taken.
Everything is a DataFrame expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tickertone.llm.shared import sets_aside, written

SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SYMBOL_PATTERN = r"[#*$%&|<>]"
#: Share of a stratum's good documents that all rules together may reject, and the chance that a promise fails.
MAX_FALSE_REJECTIONS, MAX_CHANCE = 0.02, 0.05
#: Cutoffs are the multiples of 1 / STEPS below 1.
STEPS = 20
GRAM = 5

#: Measure of each rule, between 0 and 1, higher is worse.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "symbols": lambda c: c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)),
    "upper_case": lambda c: c("n_upper") / F.greatest(c("word_chars"), F.lit(1)),
    "repeated_lines": lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
    "repeated_grams": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    "repeated_words": lambda c: (c("n_words") - c("n_distinct_words")) / F.greatest(c("n_words"), F.lit(1)),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of GRAM words that a text has twice or more."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(entries: Column) -> Column:
            last = F.size(entries) - 1

            def level(i: Column, j: Column) -> Column:
                return F.get(entries, i)["h"] == F.get(entries, j)["h"]

            repeated = F.filter(entries, lambda _, i: ((i > 0) & level(i, i - 1)) | ((i < last) & level(i, i + 1)))
            return F.sort_array(F.transform(repeated, lambda x: x["i"]))

        def total(starts: Column) -> Column:
            # A window adds the words before the next window's start; the last one adds all of its own.
            return F.aggregate(
                F.transform(starts, lambda x, i: F.least(F.coalesce(F.get(starts, i + 1) - x, F.lit(GRAM)), F.lit(GRAM))),
                F.lit(0),
                lambda a, b: a + b,
            )

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(ordered, places), total)).otherwise(0)

    hashes = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)]))
    return F.when(n >= GRAM, let(hashes, covered)).otherwise(0)


def with_measures(docs: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    """docs with a struct of the counts of each whole text; a null text counts as empty."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(content, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(content) - F.length(F.regexp_replace(content, SYMBOL_PATTERN + "+", ""))).cast("long").alias("n_symbols"),
            (F.length(content) - F.length(F.regexp_replace(content, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
            let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct"))).alias("lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    words = F.filter(F.split(content, SPACE_PATTERN), lambda w: w != "")

    def finished(m: Column) -> Column:
        return F.struct(
            *[m[c].alias(c) for c in ("n_words", "n_distinct_words", "word_chars", "n_symbols", "n_upper", "n_repeat_words")],
            m["lines"]["all"].cast("long").alias("n_lines"),
            (m["lines"]["all"] - m["lines"]["distinct"]).cast("long").alias("n_dup_lines"),
            ((m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])).alias("base_failed"),
        )

    # A generator's result is a column like any other to the optimizer: filters on it do not compute it again below.
    return docs.select("*", F.explode(F.array(let(let(words, counts), finished))).alias(into))


def _level(measure: Column) -> Column:
    """How many of the cutoffs 1/STEPS, 2/STEPS, ... below 1 the measure exceeds."""
    return F.least(F.greatest(F.ceil(measure * STEPS).cast("int") - 1, F.lit(0)), F.lit(STEPS - 1))


def _log_tail(k: Column, n: Column, share: float) -> Column:
    """log P(X <= k) of X binomial over n trials, by adding the terms in logarithms."""

    def step(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + F.lit(math.log(share / (1 - share)))
        top = F.greatest(state["total"], term)
        total = top + F.log(F.exp(state["total"] - top) + F.exp(term - top))
        return F.struct(term.alias("term"), total.alias("total"))

    first = n * F.lit(math.log1p(-share))
    start = F.struct(first.alias("term"), first.alias("total"))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, start, step)["total"]


def certified_cutoffs(
    measured: DataFrame,
    stratum: str = "stratum",
    good: str = "good",
    measures: str = "measures",
    max_false: float = MAX_FALSE_REJECTIONS,
    max_chance: float = MAX_CHANCE,
) -> DataFrame:
    """stratum and, for each rule, the level above which it rejects (null: no cutoff is certified).

    measured has one row for each labelled document: its stratum, a boolean good, and measures.
    Rows with a null label, and rows that the base rules reject, say nothing here. Fewer holdouts
    than the promise needs give no cutoff, so an empty table rejects nothing.
    """
    rules = list(RULES)
    share = max_false / len(rules)
    levels = F.array(*[F.struct(F.lit(r).alias("rule"), _level(RULES[r](lambda c: F.col(measures)[c])).alias("level")) for r in rules])
    counted = (
        measured.where(F.col(good).isNotNull() & ~F.col(measures)["base_failed"])
        .select(F.col(stratum).alias("stratum"), F.col(good).alias("good"), F.explode(levels).alias("x"))
        .groupBy("stratum", "x.rule", "x.level")
        .agg(F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    # One row for each stratum and rule: counts by level, at most STEPS of them.
    table = counted.groupBy("stratum", "rule").agg(F.collect_list(F.struct("level", "good", "bad")).alias("counts"))

    def total(entries: Column, name: str) -> Column:
        return F.aggregate(entries, F.lit(0).cast("long"), lambda a, x: a + x[name])

    def rejected(cut: Column) -> Column:
        above = F.filter("counts", lambda x: x["level"] >= cut)
        return F.struct(cut.alias("cut"), total(above, "good").alias("good"), total(above, "bad").alias("bad"))

    sums = F.transform(F.sequence(F.lit(STEPS - 1), F.lit(1), F.lit(-1)), rejected)
    trials = total(F.col("counts"), "good")
    table = table.select("stratum", "rule", trials.alias("n"), sums.alias("cuts"))
    table = written(table, small=True)
    strata = max(1, table.select("stratum").distinct().count())
    bar = F.lit(math.log(max_chance / len(rules) / strata))
    passed = F.transform(
        "cuts",
        # Past the expected number of losses the test cannot succeed.
        lambda x: (x["good"] <= F.col("n") * share) & F.coalesce(_log_tail(F.least(x["good"], F.floor(F.col("n") * share)), F.col("n"), share) <= bar, F.lit(False)),
    )
    certified = F.filter("cuts", lambda x, i: F.forall(F.slice(F.col("passed"), F.lit(1), i + 1), lambda p: p))
    best = F.array_max(F.transform(certified, lambda x: F.struct((x["bad"] - x["good"]).alias("gain"), x["cut"].alias("cut"))))
    chosen = table.withColumn("passed", passed).select("stratum", "rule", best["cut"].alias("cut"))
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(r) for r in rules])


def _stratum(lang: str) -> Column:
    return F.coalesce(F.col(f"`{lang}`"), F.lit(""))


def labelled(docs: DataFrame, labels: DataFrame, id_column: str, label: str) -> DataFrame:
    """Rows of docs with a boolean good; a document with several labels takes the lowest, one without none."""
    marks = labels.where(F.col(f"`{id_column}`").isNotNull() & F.col(f"`{label}`").isNotNull())
    marks = marks.groupBy(F.col(f"`{id_column}`").alias("__id")).agg((F.min(F.col(f"`{label}`")) >= 1).alias("good"))
    return docs.join(marks, F.col(f"`{id_column}`") == F.col("__id")).drop("__id")


def _kept(measures: str = "measures") -> Column:
    kept = ~F.col(measures)["base_failed"]
    for rule, measure in RULES.items():
        above = _level(measure(lambda c: F.col(measures)[c])) >= F.col(f"cut_{rule}")
        kept &= ~F.coalesce(above, F.lit(False))
    return kept


def with_verdicts(measured: DataFrame, cutoffs: DataFrame, lang: str = "lang", measures: str = "measures", into: str = "kept") -> DataFrame:
    """measured with a boolean kept: false where a base rule fails or a certified cutoff is passed."""
    cuts = cutoffs.select(F.col("stratum").alias("__stratum"), *[F.col(r).alias(f"cut_{r}") for r in RULES])
    joined = measured.join(cuts, _stratum(lang) == F.col("__stratum"), "left")
    return joined.withColumn(into, _kept(measures)).drop("__stratum", *[f"cut_{r}" for r in RULES])


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", lang: str = "lang", label: str = "quality") -> DataFrame:
    """id, lang, measures and kept for each row of docs, repeated rows too.

    Labels are joined on the id; labels of unknown documents are ignored. A null lang is a stratum of
    its own together with empty ones. Measures are narrow, are written once and serve both the
    holdout and the verdicts.
    """
    measured = written(with_measures(docs).select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{lang}`").alias("lang"), "measures"))
    marks = labels.withColumnRenamed(id_column, "id")
    holdout = labelled(measured, marks, "id", label).withColumn("stratum", _stratum("lang"))
    return with_verdicts(measured, written(certified_cutoffs(holdout), small=True))


@sets_aside(r"__.*|cut_.*|stratum|good|measures")
def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", lang: str = "lang", label: str = "quality") -> DataFrame:
    """The rows of docs that the rules keep, with their own columns.

    Only labelled rows are measured for the cutoffs; then every row is measured where it stands, so
    whole texts are not shuffled. Null and empty texts have too few words and go; a null lang counts
    as an empty one; repeated rows have the same verdict; an empty table gives an empty one.
    """
    holdout = labelled(docs.select(F.col(f"`{id_column}`"), F.col(f"`{lang}`"), "text"), labels, id_column, label).withColumn("stratum", _stratum(lang))
    cutoffs = written(certified_cutoffs(with_measures(holdout.select("stratum", "good", "text"))), small=True)
    verdicts = with_verdicts(with_measures(docs, into="__measures"), cutoffs, lang, "__measures", "__kept")
    return verdicts.where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])
