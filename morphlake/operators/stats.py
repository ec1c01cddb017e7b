"""Two-group tests, multiplicity, and a random-intercept model: Spark gathers the sums, tails are taken on the few result rows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from morphlake.functions import tails
from morphlake.functions.columns import all_of
from morphlake.operators.cohort import paired_pivot
from morphlake.sources.storage import cut


#: Rows of one family up to which one task ranks it; larger ones are ranked in ranges.
FAMILY_ROWS = 1_000_000


def _in_ranges(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame | None:
    """``rows`` in ranges of (by, order), stored, with the range's number, the family's rows before it and in all; None where families are small."""
    most = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= FAMILY_ROWS:
        return None
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(most) // FAMILY_ROWS))
    ranged = cut(rows.repartitionByRange(parts, *[F.col(c) for c in by], *order).withColumn("__range", F.spark_partition_id()))
    family = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sizes = ranged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = family.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__rows").over(before), F.lit(0)), "__all": F.sum("__rows").over(family)}).drop("__rows")
    return _same_family(ranged, sizes, [*by, "__range"])


def _same_family(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns that ``other`` has for their keys, null among these like any value."""
    named = other.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    on = all_of(*[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return rows.join(named, on).drop(*[f"__k{i}" for i in range(len(keys))])


def average_ranks(rows: DataFrame, by: Sequence[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Ranks with ties sharing their mean, and ``tied``: the size of each value's tie group. Families of over FAMILY_ROWS rows are ranked in ranges."""
    ranged = _in_ranges(rows, by, [F.col(value)])
    if ranged is None:
        order, same = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
        return rows.withColumn("tied", F.count(F.lit(1)).over(same)).withColumn(name, F.rank().over(order) + (F.col("tied") - 1) / 2)
    order, same = Window.partitionBy(*by, "__range").orderBy(value), Window.partitionBy(*by, "__range", value)  # equal values are in one range
    ranked = ranged.withColumn("tied", F.count(F.lit(1)).over(same)).withColumn(name, F.col("__before") + F.rank().over(order) + (F.col("tied") - 1) / 2)
    return ranked.drop("__range", "__before", "__all")


def fdr_bh(tests: DataFrame, by: Sequence[str], p: str, key: str, name: str = "p_fdr") -> DataFrame:
    """Benjamini-Hochberg within each family; a null p sorts last, counts as a test, and is adjusted to 1.

    Families of over FAMILY_ROWS tests are ranked in ranges, and the running minimum is carried from the later ranges.
    """
    order = [F.asc_nulls_last(p), F.asc(key)]
    ranged = _in_ranges(tests, by, order)
    scaled = lambda f: f.withColumn("__q", F.coalesce(F.col(p) * F.col("__all") / F.col("__rank"), F.lit(1.0)))
    down = lambda w: w.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if ranged is None:
        family = Window.partitionBy(*by)
        ranked = scaled(tests.withColumns({"__all": F.count(F.lit(1)).over(family), "__rank": F.row_number().over(family.orderBy(*order))}))
        return ranked.withColumn(name, F.least(F.lit(1.0), F.min("__q").over(down(family)))).drop("__all", "__rank", "__q")
    inside = Window.partitionBy(*by, "__range")
    ranked = scaled(ranged.withColumn("__rank", F.col("__before") + F.row_number().over(inside.orderBy(*order))))
    family = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    later = family.orderBy("__range").rowsBetween(1, Window.unboundedFollowing)
    least = ranked.groupBy(*by, "__range").agg(F.min("__q").alias("__m")).withColumn("__later", F.coalesce(F.min("__m").over(later), F.lit(1.0))).drop("__m")
    out = _same_family(ranked, least, [*by, "__range"])
    adjusted = out.withColumn(name, F.least(F.lit(1.0), F.min("__q").over(down(inside)), F.col("__later")))
    return adjusted.drop("__range", "__before", "__all", "__rank", "__q", "__later")


def welch_statistics(samples: DataFrame, outcome: str, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Welch's t and its degrees of freedom, means, and Cohen's d (0 where the pooled deviation is) for each group with two values a side."""
    part = lambda f, c: f(F.when(F.col("condition") == c, F.col(outcome)))
    s = samples.where(F.col(outcome).isNotNull()).groupBy(*by).agg(*[part(f, c).alias(f"{n}_{k}") for c, k in ((a, "a"), (b, "b")) for f, n in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "var"))])
    s = s.where("n_a >= 2 and n_b >= 2")
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    diff = F.col("mean_a") - F.col("mean_b")
    return s.withColumns({"t": F.try_divide(diff, F.sqrt(va + vb)), "df": F.try_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1)), "effect": F.when(pooled > 1e-12, diff / pooled).otherwise(0.0)})


def rank_sum_statistics(samples: DataFrame, outcome: str, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Mann-Whitney U of the first condition and the tie term, sum of t**3 - t."""
    rows = average_ranks(samples.where(F.col(outcome).isNotNull() & F.col("condition").isin(a, b)), by, outcome)
    side = lambda c: F.count_if(F.col("condition") == c)
    s = rows.groupBy(*by).agg(side(a).alias("n_a"), side(b).alias("n_b"), F.sum(F.when(F.col("condition") == a, F.col("avg_rank"))).alias("r"), F.sum(F.col("tied") * F.col("tied") - 1).cast("double").alias("ties"))
    return s.where("n_a >= 2 and n_b >= 2").withColumn("u", F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2).drop("r")


def paired_statistics(samples: DataFrame, outcome: str, a: str, b: str) -> DataFrame:
    """Paired t, its degrees of freedom, Cohen's dz (0 for a constant difference), and the signed-rank sum, over animals with both conditions."""
    d = paired_pivot(samples, outcome, a, b).withColumn("d", F.col(a) - F.col(b))
    ranked = average_ranks(d.where("abs(d) > 1e-12").withColumn("abs_d", F.abs("d")), [], "abs_d")
    signed = ranked.agg(F.count(F.lit(1)).alias("n_ranked"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("avg_rank"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.col("tied") * F.col("tied") - 1), F.lit(0)).cast("double").alias("ties"))
    s = d.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd")).where("n_pairs >= 2")
    se = F.col("sd") / F.sqrt("n_pairs")
    t = F.when(se > 0, F.col("mean_diff") / se).when(F.col("mean_diff") != 0, F.signum("mean_diff") * float("inf"))
    return s.withColumns({"t": t, "df": (F.col("n_pairs") - 1).cast("double"), "se": se, "effect": F.when(F.col("sd") > 1e-12, F.col("mean_diff") / F.col("sd")).otherwise(0.0)}).join(signed)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([tails.t_two_sided(x, d) for x, d in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def rank_sum_p_value(u: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([tails.mann_whitney(*x) for x in zip(u, n.astype(int), m.astype(int), ties, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def signed_rank_p_value(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([tails.signed_rank(*x) for x in zip(w, n.astype(int), ties, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_margin(df: pd.Series) -> pd.Series:
    return pd.Series([tails.t_quantile(0.975, d) if d and d > 0 else float("nan") for d in df], dtype="float64")


def two_group_tests(samples: DataFrame, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, test, n_a, n_b, effect, statistic, p): Welch's t and Mann-Whitney for the two conditions, a before b in order of name.

    More or fewer than two conditions give no rows; so does a group with fewer than two values on a side.
    """
    names = sorted(str(r[0]) for r in samples.select("condition").where("condition is not null").distinct().limit(3).collect())
    a, b = (names if len(names) == 2 else ("", ""))
    rows = samples.withColumn("condition", F.col("condition").cast("string"))
    t = welch_statistics(rows, outcome, by, a, b).select(*by, F.lit("welch_t").alias("test"), "n_a", "n_b", "effect", F.col("t").alias("statistic"), t_p_value("t", "df").alias("p"))
    u = rank_sum_statistics(rows, outcome, by, a, b).select(*by, F.lit("mann_whitney").alias("test"), "n_a", "n_b", F.lit(None).cast("double").alias("effect"), F.col("u").alias("statistic"), rank_sum_p_value("u", "n_a", "n_b", "ties").alias("p"))
    return t.unionByName(u)


def paired_tests(samples: DataFrame, outcome: str, a: str, b: str) -> DataFrame:
    """The paired t-test with its confidence interval, and the signed-rank test where some difference is not 0."""
    s = paired_statistics(samples, outcome, a, b)
    margin = t_margin("df") * F.col("se")
    none = F.lit(None).cast("double")
    t = s.select(F.lit("paired_t").alias("test"), "n_pairs", "effect", F.col("t").alias("statistic"), t_p_value("t", "df").alias("p"), (F.col("mean_diff") - margin).alias("low"), (F.col("mean_diff") + margin).alias("high"))
    w = s.where("n_ranked > 0").select(F.lit("signed_rank").alias("test"), "n_pairs", none.alias("effect"), F.col("w_plus").alias("statistic"), signed_rank_p_value("w_plus", "n_ranked", "ties").alias("p"), none.alias("low"), none.alias("high"))
    return t.unionByName(w)


def mixed_model_sums(rows: DataFrame, columns: Sequence[str], outcome: str, group: str) -> DataFrame:
    """Sums that a random-intercept likelihood needs, one row for each group size: k groups, X'X, X'y, y'y and the sums of
    outer products of each group's totals. All columns and the outcome must be non-null numbers."""
    v = [*columns, outcome]
    totals = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(v)], *[F.sum(F.col(c) * F.col(e)).alias(f"x{i}_{j}") for i, c in enumerate(v) for j, e in enumerate(v) if i <= j])
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    return totals.groupBy("n").agg(F.count(F.lit(1)).alias("k"), *[F.sum(f"x{i}_{j}").alias(f"x{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"o{i}_{j}") for i, j in pairs])


def design_columns(rows: DataFrame, terms: Sequence[str | tuple[str, ...]], most_levels: int = 100) -> tuple[DataFrame, list[str], list[str]]:
    """The rows with a numeric column for each coefficient, the names of these columns, and the names of the coefficients.

    A text is a numeric column. A tuple is a categorical term, of several columns an interaction of their indicators; the
    first level in order of text is the baseline and has no column. Rows with a null in any term go. A column of more than
    ``most_levels`` levels raises: what the driver gets is bounded by it.
    """
    factors = sorted({c for t in terms if not isinstance(t, str) for c in t})
    used = rows.dropna(subset=[*{t for t in terms if isinstance(t, str)}, *factors]) if terms else rows
    levels = {}
    for c in factors:
        found = sorted(str(r[0]) for r in used.select(F.col(c).cast("string")).distinct().limit(most_levels + 1).collect())
        if len(found) > most_levels:
            raise ValueError(f"{c} has more than {most_levels} levels")
        levels[c] = found[1:]
    columns: list[tuple[str, Column]] = [("intercept", F.lit(1.0))]
    for t in terms:
        if isinstance(t, str):
            columns.append((t, F.col(t).cast("double")))
            continue
        for combination in itertools.product(*[levels[c] for c in t]):
            on = [F.col(c).cast("string") == v for c, v in zip(t, combination, strict=True)]
            columns.append((":".join(f"{c}[{v}]" for c, v in zip(t, combination, strict=True)), all_of(*on).cast("double")))
    names = [f"__c{i}" for i in range(len(columns))]
    return used.withColumns({n: c for n, (_, c) in zip(names, columns, strict=True)}), names, [n for n, _ in columns]


#: Innermost clusters that the driver evaluates itself; beyond it each step of the search is a Spark job over them.
MOST_CLUSTERS = 100_000


def _cluster_terms(clusters: pd.DataFrame, keys: Sequence[str], points: np.ndarray, width: int) -> list[np.ndarray]:
    """For each point of variance ratios (one a level, outermost first): what the clusters take from X'X, and the log determinant last.

    clusters: a row for each innermost cluster, in order of its keys, with its rows ``n`` and the sums of all columns. A
    level's covariance is that of the levels inside it plus a constant on the whole block, so its inverse only takes one
    outer product a block: that of the block's sums, each shrunk by the levels inside.
    """
    code = [pd.factorize(pd.MultiIndex.from_frame(clusters[list(keys[: k + 1])]))[0] for k in range(len(keys))]
    base, rows = clusters[[f"s{i}" for i in range(width)]].to_numpy(dtype=float), clusters["n"].to_numpy(dtype=float)
    out = []
    for ratios in points:
        sums, weight, taken, determinant, of = base, rows, np.zeros((width, width)), 0.0, code[-1]
        for level in range(len(keys) - 1, -1, -1):
            shrink = 1.0 / (1.0 + ratios[level] * weight)
            taken += (sums * (ratios[level] * shrink)[:, None]).T @ sums
            determinant += float(np.log1p(ratios[level] * weight).sum())
            sums, weight = sums * shrink[:, None], weight * shrink
            if level and len(sums):
                first = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0])) if level == len(keys) - 1 else first
                parent = code[level - 1][first]
                starts = np.flatnonzero(np.concatenate([[True], np.diff(parent) != 0]))
                sums, weight, first = np.add.reduceat(sums, starts), np.add.reduceat(weight, starts), first[starts]
        out.append(np.concatenate([taken.reshape(-1), [determinant]]))
    return out


def nested_model(rows: DataFrame, terms: Sequence[str | tuple[str, ...]], outcome: str, group: str, nested: Sequence[str]) -> DataFrame:
    """As ``mixed_model``, with an intercept also for each cluster of ``nested`` within the levels before it: outcome ~ terms + (1 | group/nested...).

    The variances follow the terms: group_variance, one named after each nested column, residual_variance. Spark sums the
    columns of each innermost cluster; the likelihood of any variance ratios comes from these sums by a block inverse, level
    by level. The ratios are sought on a narrowing grid, all levels together. A level that the level outside it or the rows
    already tell apart raises ValueError, as what ``mixed_model`` refuses does.
    """
    keys = [group, *nested]
    frame, columns, labels = design_columns(rows, terms)
    frame = cut(frame.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(outcome).cast("double").alias("__y"), *columns).dropna())
    values, p = [*columns, "__y"], len(columns)
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    total = frame.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(values[i]) * F.col(values[j])).alias(f"x{i}_{j}") for i, j in pairs]).first()
    clusters = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(values)])
    clusters = cut(clusters.repartition(group).sortWithinPartitions(*keys))
    sizes = [frame.select(*keys[: k + 1]).distinct().count() for k in range(len(keys))]
    n, width = float(total["n"]), p + 1
    if sizes[0] < 2:
        raise ValueError("a mixed model needs two groups at least")
    for name, outer, inner in zip(keys[1:], sizes, sizes[1:], strict=False):
        if inner == outer or inner == n:
            raise ValueError(f"{name} has no variance of its own")
    whole = np.zeros((width, width))
    for i, j in pairs:
        whole[i, j] = whole[j, i] = float(total[f"x{i}_{j}"] or 0.0)
    if np.linalg.matrix_rank(whole[:p, :p], hermitian=True) < p:
        raise ValueError("the terms depend on each other")
    local = clusters.toPandas().sort_values(keys, ignore_index=True) if sizes[-1] <= MOST_CLUSTERS else None

    def evaluated(points: np.ndarray) -> list[np.ndarray]:
        if local is not None:
            return _cluster_terms(local, keys, points, width)

        def terms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = pd.concat(list(batches), ignore_index=True)  # sums of a partition's clusters
            for number, value in enumerate(_cluster_terms(held, keys, points, width)):
                yield pd.DataFrame({"point": number, "at": np.arange(len(value)), "value": value})

        found = clusters.mapInPandas(terms_of, "point int, at int, value double").groupBy("point", "at").agg(F.sum("value").alias("value")).toPandas().sort_values(["point", "at"])
        return list(found["value"].to_numpy().reshape(len(points), -1))

    def likelihood(term: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
        m = whole - term[:-1].reshape(width, width)
        beta = np.linalg.solve(m[:p, :p], m[:p, p])
        variance = max(m[p, p] - beta @ m[:p, p], 0.0) / n
        if variance <= 1e-12:
            raise ValueError("the outcome has no variance beyond the terms")
        return -0.5 * (n * math.log(2 * math.pi * variance) + n + term[-1]), beta, variance, m

    low, high = -12.0, 8.0
    centre, reach, reached = np.full(len(keys), (low + high) / 2), (high - low) / 2, -math.inf
    while reach > 1e-6:  # a step to a better point keeps the reach, else it is halved
        points = np.exp(np.array(list(itertools.product(*[np.clip(c + reach * np.linspace(-1, 1, 5), low, high) for c in centre]))))
        scores = [likelihood(t)[0] for t in evaluated(points)]
        best = int(np.argmax(scores))
        if scores[best] > reached + 1e-10:
            centre, reached = np.log(points[best]), scores[best]
        else:
            reach /= 2
    choices = np.array(list(itertools.product(*[(math.exp(c), 0.0) for c in centre])))  # a level whose variance is better left out has none
    fits = [likelihood(t) for t in evaluated(choices)]
    best = max(range(len(fits)), key=lambda k: (round(fits[k][0], 9), -int((choices[k] > 0).sum())))
    _, beta, variance, m = fits[best]
    names = ["group_variance", *[f"{k}_variance" for k in nested], "residual_variance"]
    return _coefficients(rows, labels, beta, m[:p, :p], variance, list(zip(names, [*(choices[best] * variance), variance], strict=True)))


def mixed_model_ladder(rows: DataFrame, terms: Sequence[str | tuple[str, ...]], outcome: str, group: str, nested: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """(model, nested columns it has, why fuller ones failed): the fullest model that can be fitted.

    All of ``nested`` are tried, then without the last, then without the first, then none; where the model with a group's
    intercept alone fails too, its ValueError is raised.
    """
    rungs = [list(nested), list(nested[:-1]), list(nested[1:]), []]
    reasons: list[str] = []
    for number, rung in enumerate(rungs):
        if rung in rungs[:number]:
            continue
        try:
            return (nested_model(rows, terms, outcome, group, rung) if rung else mixed_model(rows, terms, outcome, group)), rung, reasons
        except (ValueError, np.linalg.LinAlgError) as failure:
            if not rung:
                raise
            reasons.append(str(failure))
    raise AssertionError("the last rung returns or raises")


def _coefficients(rows: DataFrame, labels: Sequence[str], beta: np.ndarray, information: np.ndarray, variance: float, variances: Sequence[tuple[str, float]]) -> DataFrame:
    errors = np.sqrt(np.diag(np.linalg.inv(information)) * variance)
    if not (np.isfinite(beta).all() and np.isfinite(errors).all() and (errors > 0).all()):
        raise ValueError("the fit has coefficients that aren't finite")
    reach = 1.959963984540054 * errors
    fixed = [(i, t, float(b), float(s), float(b / s), tails.normal_two_sided(float(b / s)), float(b - r), float(b + r)) for i, (t, b, s, r) in enumerate(zip(labels, beta, errors, reach, strict=True))]
    schema = "term string, estimate double, se double, z double, p double, low double, high double"
    adjusted = fdr_bh(rows.sparkSession.createDataFrame(fixed, "i int, " + schema).withColumn("f", F.lit(1)), ["f"], "p", "i").drop("f", "i")
    last = [(name, float(v), None, None, None, None, None) for name, v in variances]
    return adjusted.unionByName(rows.sparkSession.createDataFrame(last, schema).withColumn("p_fdr", F.lit(None).cast("double")))


def mixed_model(rows: DataFrame, terms: Sequence[str | tuple[str, ...]], outcome: str, group: str) -> DataFrame:
    """Maximum likelihood of outcome ~ terms + (1 | group): term, estimate, se, z, p, low, high, p_fdr, then both variances.

    Terms are those of ``design_columns``. low and high bound 95 %, p_fdr adjusts over the terms. The sums have one row for
    each distinct group size; the variance ratio is found on those by a golden-section search. Fewer than two groups, a
    constant outcome, terms that depend on each other and results that aren't finite raise ValueError.
    """
    frame, columns, labels = design_columns(rows, terms)
    frame = frame.select(group, F.col(outcome).cast("double").alias("__y"), *columns).dropna()
    sums, p = mixed_model_sums(frame, columns, "__y", group).toPandas(), len(columns)
    n = float((sums["n"] * sums["k"]).sum())
    if sums["k"].sum() < 2:
        raise ValueError("a mixed model needs two groups at least")

    def matrix(ratio: float) -> np.ndarray:
        out = np.zeros((p + 1, p + 1))
        for i in range(p + 1):
            for j in range(i, p + 1):
                out[i, j] = out[j, i] = float((sums[f"x{i}_{j}"] - ratio / (1 + sums["n"] * ratio) * sums[f"o{i}_{j}"]).sum())
        return out

    plain = matrix(0.0)
    if np.linalg.matrix_rank(plain[:p, :p], hermitian=True) < p:
        raise ValueError("the terms depend on each other")

    def fit(ratio: float) -> tuple[float, np.ndarray, float, np.ndarray]:
        m = matrix(ratio)
        beta = np.linalg.solve(m[:p, :p], m[:p, p])
        residual = max(m[p, p] - beta @ m[:p, p], 0.0)
        variance = residual / n
        if variance <= 1e-12:
            raise ValueError("the outcome has no variance beyond the terms")
        return -0.5 * (n * math.log(2 * math.pi * variance) + n + float((sums["k"] * np.log1p(sums["n"] * ratio)).sum())), beta, variance, m

    low, high, golden = -12.0, 8.0, (math.sqrt(5) - 1) / 2
    for _ in range(100):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if fit(math.exp(a))[0] > fit(math.exp(b))[0] else (a, high)
    ratio = math.exp((low + high) / 2)
    ratio = ratio if fit(ratio)[0] > fit(0.0)[0] else 0.0
    _, beta, variance, m = fit(ratio)
    return _coefficients(rows, labels, beta, m[:p, :p], variance, [("group_variance", ratio * variance), ("residual_variance", variance)])


def run_statistics(samples: DataFrame, outcome: str, eligible: bool, mode: str = "auto") -> DataFrame:
    """One row that says which analysis applies: mixed where asked for or possible, else simple, with the reason."""
    if mode == "mixed" and not eligible:
        raise ValueError("the samples have no repeated structure for a mixed model")
    chosen, reason = ("simple", "requested") if mode == "simple" else ("mixed", "repeated_structure") if eligible else ("simple", "no_repeated_structure")
    if chosen == "mixed" and mode == "auto":
        spread = samples.agg(F.max(outcome).alias("hi"), F.min(outcome).alias("lo")).first()
        if spread["hi"] == spread["lo"]:
            chosen, reason = "simple", "no_variance"
    return samples.sparkSession.createDataFrame([(outcome, mode, chosen, reason)], "outcome string, requested string, selected string, reason string")


def study_statistics(
    samples: DataFrame, outcome: str, eligible: bool, terms: Sequence[str | tuple[str, ...]], group: str = "animal_id", by: Sequence[str] = (), mode: str = "auto", nested: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(decision, results): runs the analysis that ``run_statistics`` names.

    Mixed: the model of ``terms``, with intercepts of ``nested`` as far as they can be fitted. Simple: the two-group tests, in each group of ``by``, p-values adjusted over all of them.
    In mode auto a model that can't be fitted falls back to the simple tests, and the decision's ``fallback`` says why; in
    mode mixed it raises. Where no simple test can be made, ``selected`` is none and the results are empty.
    """
    decision = run_statistics(samples, outcome, eligible, mode).first()
    selected, fallback, results = decision["selected"], None, None
    if selected == "mixed":
        try:
            fit, _, _ = mixed_model_ladder(samples, terms, outcome, group, nested)
            results = fit.select(F.lit("mixed").alias("model"), "term", "estimate", F.col("z").alias("statistic"), "p", "p_fdr")
        except (ValueError, np.linalg.LinAlgError) as failure:
            if mode == "mixed":
                raise
            selected, fallback = "simple", str(failure)
    if results is None:
        tests = cut(two_group_tests(samples, outcome, by))
        term = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], "test")
        named = tests.select(F.lit("simple").alias("model"), term.alias("term"), F.col("effect").alias("estimate"), "statistic", "p").withColumn("f", F.lit(1))
        results = fdr_bh(named, ["f"], "p", "term").drop("f")
        selected = "none" if tests.isEmpty() else selected
    row = [(outcome, mode, selected, decision["reason"], fallback)]
    return samples.sparkSession.createDataFrame(row, "outcome string, requested string, selected string, reason string, fallback string"), results
