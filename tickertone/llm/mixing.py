"""Mixing of sources to target weights by raking.

Tokens are counted by source, language and topic. The fitted weight of a cell is the product of a
factor for its source, its language and its topic, such that the weighted tokens meet all three sets
of target shares. Languages and topics are bounded by the targets, so their factors are plain
numbers; sources are not, so their factors stay in a table with one row for each source, and a pass
over them is one aggregation to one row. Only DataFrame functions.

The fit is iterative proportional fitting: a pass scales the sources to their shares, which leaves a
small table of languages and topics, and scales first the languages, then the topics of that table to
theirs. Where few sources mix languages the passes creep; what they leave is then polished by Newton's
method, as the logarithms of the factors are the least point of a convex function whose slopes are the
errors of the shares.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tickertone.llm.shared import sets_aside, written
from tickertone.llm.text import WORD_PATTERN, text_key

#: Passes over which the fall of the error is measured; raking that would not end in time at that pace is left to the polish.
CREEP = 5
#: What a language or topic without a target of its own counts as.
OTHER = "other"


@dataclass(frozen=True)
class Targets:
    """Known languages and topic patterns, target shares, and how far shares without a target are flattened.

    A topic is the first whose pattern a text holds, else OTHER. flatten 1 leaves the mix as it is,
    0 makes entries equal. Without named shares, the tokens of each cell (source, language, topic) are
    taken to the power flatten, and the targets are the sums of these by source, language and topic:
    the cells themselves meet all three. With named shares, an entry that they do not name is given its
    token count to the power flatten, in proportion to what the named ones leave; where this contradicts
    the other targets (say, sources of one language each), the flattened cells are raked to the named
    shares alone, and the targets of all others are the sums of these.
    """

    languages: tuple[str, ...] = ("en", "de", "fr", "es")
    patterns: dict[str, str] = field(
        default_factory=lambda: {
            "legal": r"[Ll]icen[sc]e|[Cc]opyright|[Rr]ights [Rr]eserved",
            "contact": r"@\w|\+\d[\d ()-]{6}",
            "code": r"[{};=]",
        }
    )
    language_shares: dict[str, float] = field(default_factory=dict)
    topic_shares: dict[str, float] = field(default_factory=dict)
    flatten: float = 0.9
    max_passes: int = 50  # of raking, and as many steps of its polish
    tolerance: float = 1e-6


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def _language(lang: Column, targets: Targets) -> Column:
    return F.when(lang.isin(list(targets.languages)), lang).otherwise(F.lit(OTHER))


def _topic(text: Column, targets: Targets) -> Column:
    out = F.lit(OTHER)
    for name, pattern in reversed(targets.patterns.items()):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def with_cells(docs: DataFrame, targets: Targets) -> DataFrame:
    """docs with __source, __language, __topic and __tokens."""
    return docs.withColumns(
        {
            "__source": F.coalesce(F.col("source"), F.lit("")),
            "__language": _language(F.col("lang"), targets),
            "__topic": _topic(F.col("text"), targets),
            "__tokens": token_count(F.col("text")),
        }
    )


def _goals(names: list[str], sums: list[float], shares: dict[str, float], flatten: float) -> list[float]:
    """Target shares of the entries that have tokens at all, to sum 1."""
    named = {x for x, n in zip(names, sums, strict=True) if x in shares and n > 0}
    free = {x: n**flatten for x, n in zip(names, sums, strict=True) if x not in shares and n > 0}
    rest = max(0.0, 1 - sum(shares[x] for x in named)) / (sum(free.values()) or 1)
    out = [shares[x] if x in named else free.get(x, 0.0) * rest for x in names]
    return [g / (sum(out) or 1) for g in out]


def _named_only(cells: np.ndarray, goals: list[list[float]], named: list[np.ndarray]) -> list[np.ndarray]:
    """Factors of the rows and columns of cells that bring the named ones to their goals; those that are not named share a factor."""
    factors = [np.ones(n) for n in cells.shape]
    for _ in range(10_000):
        moved = 0.0
        for side in (0, 1):
            if not named[side].any():
                continue
            now, goal = (cells * np.outer(*factors)).sum(1 - side), np.array(goals[side])
            now /= now.sum() or 1
            rest, left = now[~named[side]].sum(), goal[~named[side]].sum()
            change = np.where(named[side], np.divide(goal, now, out=np.zeros_like(now), where=now > 0), left / rest if rest > 0 else 0.0)
            factors[side] = factors[side] * change
            moved = max(moved, float(np.abs(now * change - now).max()))
        if moved <= 1e-13 or max(f.max() for f in factors) > 1e100:
            break  # met, or only a limit meets them
    return factors


@dataclass(frozen=True)
class Fit:
    """Factors by source (a table: source, factor), language and topic, and the largest weight of a cell with tokens.

    passes counts those of raking and the steps of the polish. error is how far a share is from its
    target at most.
    """

    sources: DataFrame
    languages: dict[str, float]
    topics: dict[str, float]
    largest: float
    passes: int
    error: float


def fit(cells: DataFrame, targets: Targets) -> Fit:
    """Rake cells (__source, __language, __topic, tokens).

    A source, language or topic without tokens has no part in the targets; the others share its
    target in proportion. Without any tokens all weights are 0. Named shares that contradict each
    other or the cells leave an error above the tolerance.
    """
    languages, topics = [*targets.languages, OTHER], [*targets.patterns, OTHER]
    pairs = [(i, j) for i in range(len(languages)) for j in range(len(topics))]
    shape = (len(languages), len(topics))
    # A row for each source with one number for each of the bounded pairs.
    counts = [
        F.sum(F.when((F.col("__language") == languages[i]) & (F.col("__topic") == topics[j]), F.col("tokens")).otherwise(0)).cast("double").alias(f"n{k}")
        for k, (i, j) in enumerate(pairs)
    ]
    wide = written(cells.groupBy("__source").agg(*counts, F.sum("tokens").cast("double").alias("total")).where(F.col("total") > 0), small=True)
    flat = [F.when(F.col(f"n{k}") > 0, F.pow(f"n{k}", F.lit(targets.flatten))).otherwise(F.lit(0.0)) for k in range(len(pairs))]
    power = F.pow("total", F.lit(targets.flatten))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0.0)).alias(name)
    sums = wide.agg(total(power, "all"), *[total(F.col(f"n{k}"), f"n{k}") for k in range(len(pairs))], *[total(c, f"f{k}") for k, c in enumerate(flat)]).first()
    table, flattened = (np.array([sums[f"{x}{k}"] for k in range(len(pairs))]).reshape(shape) for x in "nf")
    shares = [targets.language_shares, targets.topic_shares]
    by_side = [_goals(names, table.sum(1 - side).tolist(), shares[side], targets.flatten) for side, names in enumerate((languages, topics))]
    # Named entries that have tokens.
    named = [np.array([x in shares[side] and n > 0 for x, n in zip(names, table.sum(1 - side), strict=True)]) for side, names in enumerate((languages, topics))]

    def raked(goals: list[np.ndarray], goal: Column) -> tuple[list[np.ndarray], float, int]:
        """Factors of languages and topics for these shares of them and of the sources, the largest error, and passes."""
        both, active = np.concatenate(goals), np.concatenate(goals) > 0
        n = len(both)
        sides = [[k for k, p in enumerate(pairs) if p[m >= shape[0]] == (m if m < shape[0] else m - shape[0])] for m in range(n)]

        def measured(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            f = np.where(active, np.exp(x), 0.0)
            cell = [float(f[i] * f[shape[0] + j]) for i, j in pairs]
            values = [F.col(f"n{k}") * F.lit(c) for k, c in enumerate(cell)]
            row = wide.select(goal.alias("goal"), sum(values, F.lit(0.0)).alias("reached"), *[sum((values[k] for k in ks), F.lit(0.0)).alias(f"m{m}") for m, ks in enumerate(sides)], *[c.alias(f"v{k}") for k, c in enumerate(values)]).where("reached > 0")
            part = F.col("goal") / F.col("reached")
            both_of = [(m, o) for m in range(n) for o in range(m, n) if active[m] and active[o]]
            found = row.agg(
                total(F.col("goal") * F.log("reached"), "height"),
                *[total(part * F.col(f"v{k}"), f"v{k}") for k in range(len(pairs))],
                *[total(part * F.col(f"m{m}") / F.col("reached") * F.col(f"m{o}"), f"h{m}_{o}") for m, o in both_of],
            ).first()
            inner = np.array([found[f"v{k}"] for k in range(len(pairs))])
            slope = np.array([inner[ks].sum() for ks in sides]) - both
            curve = np.zeros((n, n))
            for m, o in both_of:
                curve[m, o] = curve[o, m] = inner[sorted(set(sides[m]) & set(sides[o]))].sum() - found[f"h{m}_{o}"]
            return found["height"] - float(both @ np.where(active, x, 0.0)), slope, curve

        def rake() -> tuple[list[np.ndarray], float, int]:
            """Factors of languages and topics, the largest error once the sources meet theirs, and passes."""
            factors, errors = [np.where(g > 0, 1.0, 0.0) for g in goals], []
            while True:
                values = [F.col(f"n{k}") * F.lit(float(factors[0][i] * factors[1][j])) for k, (i, j) in enumerate(pairs)]
                scaled = wide.select(goal.alias("goal"), sum(values, F.lit(0.0)).alias("reached"), *[c.alias(f"v{k}") for k, c in enumerate(values)]).where("reached > 0")
                row = scaled.agg(*[total(F.col("goal") / F.col("reached") * F.col(f"v{k}"), f"v{k}") for k in range(len(pairs))]).first()
                now = np.array(row).reshape(shape)
                errors.append(max(float(np.abs(now.sum(1 - side) - goals[side]).max()) for side in (0, 1)))
                if errors[-1] <= targets.tolerance or len(errors) == targets.max_passes:
                    return factors, errors[-1], len(errors)
                if len(errors) >= CREEP:
                    ahead = (targets.max_passes - len(errors)) / (CREEP - 1)
                    if errors[-1] * (errors[-1] / errors[-CREEP]) ** ahead > targets.tolerance:
                        return factors, errors[-1], len(errors)
                for side in (0, 1):
                    held = now.sum(1 - side)
                    change = np.divide(goals[side], held, out=np.zeros_like(held), where=held > 0)
                    factors[side] = factors[side] * change
                    now = now * (change[:, None] if side == 0 else change[None, :])

        factors, error, passes = rake()
        if error <= targets.tolerance or not all((f[g > 0] > 0).all() for f, g in zip(factors, goals, strict=True)):
            return factors, error, passes
        # What creeps is polished.
        x = np.log(np.where(active, np.concatenate(factors), 1.0))
        step, best, last = np.zeros(n), None, passes + targets.max_passes
        while passes < last:
            passes += 1
            height, slope, curve = measured(x + step)
            worst = float(np.abs(slope).max())
            if best is None or height < best[0] or worst < best[1]:
                x, best = x + step, (height, worst)
                if worst <= targets.tolerance:
                    break
                step = -np.linalg.pinv(curve, rcond=1e-12, hermitian=True) @ slope
                step *= min(1.0, 5 / max(float(np.abs(step).max()), 1e-300))
            else:
                step = step / 2
            if np.abs(step).max() < 1e-13 or np.abs(x + step).max() > 300:
                break  # no direction lowers the error, or only the limit does
        f = np.where(active, np.exp(x), 0.0)
        return [f[: shape[0]], f[shape[0] :]], best[1] if best else float("inf"), passes

    goal, factors, error, passes = F.lit(0.0), [np.zeros(n) for n in shape], 0.0, 0
    if sums["all"]:
        fitted = None
        if any(x.any() for x in named):
            goal = power / F.lit(sums["all"])
            fitted = raked([np.array(g) for g in by_side], goal)
        if fitted is None or not fitted[1] <= targets.tolerance:
            moved = _named_only(flattened, by_side, named)
            joint = flattened * np.outer(*moved)
            mass = float(joint.sum())
            if mass > 0:
                earlier = fitted[2] if fitted else 0
                goal = sum((c * F.lit(float(moved[0][i] * moved[1][j])) for c, (i, j) in zip(flat, pairs, strict=True)), F.lit(0.0)) / F.lit(mass)
                goals = [joint.sum(1 - side) / mass for side in (0, 1)]
                fitted = raked(goals, goal)
                missed = max(float(np.abs(g - np.array(w))[x].max()) if x.any() else 0.0 for g, w, x in zip(goals, by_side, named, strict=True))
                fitted = (fitted[0], fitted[1] + missed, fitted[2] + earlier)
        factors, error, passes = fitted
    factors = [[float(x) for x in side] for side in factors]
    reached = sum((F.col(f"n{k}") * F.lit(factors[0][i] * factors[1][j]) for k, (i, j) in enumerate(pairs)), F.lit(0.0))
    factor = F.when(reached > 0, goal / reached).otherwise(F.lit(0.0))
    weights = F.array(*[F.when(F.col(f"n{k}") > 0, F.lit(factors[0][i] * factors[1][j])).otherwise(F.lit(0.0)) for k, (i, j) in enumerate(pairs)])
    sources = written(wide.select("__source", factor.alias("factor"), F.array_max(weights).alias("most")), small=True)
    largest = sources.agg(F.max(F.col("factor") * F.col("most"))).first()[0] or 0.0
    return Fit(sources.select("__source", "factor"), dict(zip(languages, factors[0], strict=True)), dict(zip(topics, factors[1], strict=True)), largest, passes, error)


def _looked_up(key: Column, factors: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, value in factors.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


@sets_aside(r"__.*|factor")
def with_sampling(docs: DataFrame, targets: Targets | None = None, seed: int = 0, id_column: str = "doc_id") -> DataFrame:
    """docs with n_tokens, weight, probability and sampled (columns of these names are replaced).

    weight is that of a token of the document's cell. probability is the weight over the largest
    weight, so expected tokens of the sample meet the targets without a cap. A document is sampled
    if a number between 0 and 1 hashed from seed, id and text lies below its probability: a rerun, a
    lost task and a repeated row give the same choice. Null source and null or unlisted lang count
    as a source of its own and as OTHER; documents without words do not move the weights. Targets
    that cannot be met are an error that says how far off the shares stay.
    """
    targets = targets or Targets()
    docs = docs.drop("n_tokens", "weight", "probability", "sampled")
    celled = with_cells(docs, targets)
    cells = celled.groupBy("__source", "__language", "__topic").agg(F.sum("__tokens").alias("tokens"))
    fitted = fit(written(cells, small=True), targets)
    if not fitted.error <= targets.tolerance:
        raise ValueError(f"target shares are missed by up to {fitted.error:.3g} after {fitted.passes} passes: they contradict each other or the documents")
    weight = F.coalesce(F.col("factor"), F.lit(0.0)) * _looked_up(F.col("__language"), fitted.languages) * _looked_up(F.col("__topic"), fitted.topics)
    t1, t2 = text_key(F.col("text"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"), t1, t2), 11) / F.lit(float(1 << 53))
    joined = celled.join(fitted.sources, "__source", "left").withColumn("__weight", weight)
    probability = F.least(F.col("__weight") / F.lit(fitted.largest), F.lit(1.0)) if fitted.largest else F.lit(0.0)
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("__tokens").alias("n_tokens"),
        F.col("__weight").alias("weight"),
        probability.alias("probability"),
        (draw < probability).alias("sampled"),
    )


@sets_aside(r"__.*|factor|n_tokens|weight|probability|sampled")
def mixed_sample(docs: DataFrame, targets: Targets | None = None, seed: int = 0, id_column: str = "doc_id") -> DataFrame:
    """The sampled rows of docs, with their own columns.

    Repeated rows stay or go together; nulls and documents without words are as in with_sampling;
    an empty table gives an empty one.
    """
    return with_sampling(docs, targets, seed, id_column).where("sampled").select(*[F.col(f"`{c}`") for c in docs.columns])
