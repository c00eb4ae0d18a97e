"""Comparisons: between groups of spots, between samples, and between the parameters fitted to them.

Tests return their statistic with a p-value, which a vectorised function adds to the few rows of the result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.small import small
from spotloom.operators.expression import benjamini_hochberg, welch_t

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def normal_tails(z: np.ndarray) -> np.ndarray:
    """Two-sided tails of a standard normal."""
    return np.array([math.erfc(abs(v) / math.sqrt(2)) for v in z])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b), element by element (continued fraction, Lentz's method)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.clip(np.where(flip, 1 - x, x), 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp((_lgamma(p + q) - _lgamma(p) - _lgamma(q)).astype(float) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        t, df = t.to_numpy(float), df.to_numpy(float)
        return pd.Series(incomplete_beta(df / 2, np.full(len(df), 0.5), df / (df + t * t)))

    return tail(t, df)


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return pd.Series(normal_tails(z.to_numpy(float)), dtype="float64")

    return tail(z)


def fisher_p(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of Fisher's F."""

    @F.pandas_udf("double")
    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        f, d1, d2 = (v.to_numpy(float) for v in (f, d1, d2))
        return pd.Series(incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))

    return tail(f, d1, d2)


def de_genes(expr: DataFrame, max_adjusted: float = 1e-5, min_fold: float = 1.0, top: int = 500) -> DataFrame:
    """(replicate, gene, t, p, adjusted, log_fold, rank): genes of one group against all others by Welch's t-test.

    Kept: fold change of ``min_fold`` or more and an adjusted p-value (Benjamini-Hochberg over the group's genes) under
    ``max_adjusted``; the first ``top`` by t, ties by name.  The groups stand in the column replicate.
    """
    tests = welch_t(expr).withColumn("p", student_p(F.col("t"), F.col("df")))
    tests = benjamini_hochberg(tests, "p", ["replicate"])
    by = Window.partitionBy("replicate").orderBy(F.desc(F.round("t", 9)), "gene")
    good = tests.where((F.col("adjusted") < max_adjusted) & (F.col("log_fold") >= float(np.log2(min_fold))))
    return good.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("replicate", "gene", "t", "p", "adjusted", "log_fold", "rank")


def condition_de(expr: DataFrame, spots: DataFrame, by: list[str], condition: str, one: str, two: str) -> DataFrame:
    """([by], gene, t, df, p, log_fold): ``one`` against ``two`` inside every group of spots, zeros included.

    ``spots`` hold (replicate, spot_id, [by], condition).  Groups with fewer than two spots on either side give no rows."""
    own = spots.where(F.col(condition).isin(one, two)).select("replicate", "spot_id", *by, (F.col(condition) == one).alias("first"))
    sizes = own.groupBy(*by).agg(F.count_if("first").alias("n1"), F.count_if(~F.col("first")).alias("n2")).where("n1 > 1 AND n2 > 1")
    v, first = F.col("value").cast("double"), F.col("first")
    side = lambda c, flag, name: F.sum(F.when(flag, c).otherwise(0.0)).alias(name)
    sums = expr.join(own, ["replicate", "spot_id"]).groupBy(*by, "gene").agg(side(v, first, "s1"), side(v * v, first, "q1"), side(v, ~first, "s2"), side(v * v, ~first, "q2"))
    rows = sums.join(small(sizes), by)
    var = lambda i: (F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col(f"n{i}")) / (F.col(f"n{i}") - 1) / F.col(f"n{i}")
    rows = rows.select(*by, "gene", (F.col("s1") / F.col("n1")).alias("m1"), (F.col("s2") / F.col("n2")).alias("m2"), var(1).alias("a"), var(2).alias("b"), "n1", "n2").where("a + b > 0")
    a, b = F.col("a"), F.col("b")
    out = rows.select(*by, "gene", ((F.col("m1") - F.col("m2")) / F.sqrt(a + b)).alias("t"), ((a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("df"), F.log2((F.col("m1") + 1e-9) / (F.col("m2") + 1e-9)).alias("log_fold"))
    return out.withColumn("p", student_p(F.col("t"), F.col("df")))


def average_ranks(rows: DataFrame, by: list[str], value: str, out: str = "rank", parts: int = 256) -> DataFrame:
    """``rows`` with the average rank (from 1) of ``value`` inside each group and the number of ties ``tied``.

    Distinct values are counted first and dealt to buckets between quantiles of a sketch; what precedes a bucket is a sum of
    bucket totals, so no task orders a whole group."""
    values = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("tied"))
    cuts = small(values.groupBy(*by).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("__cuts")))
    placed = values.join(cuts, by).withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    totals = placed.groupBy(*by, "__b").agg(F.sum("tied").alias("__t"))
    up = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = small(totals.select(*by, "__b", F.coalesce(F.sum("__t").over(up), F.lit(0)).alias("__before")))
    inner = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(before, [*by, "__b"]).withColumn(out, F.col("__before") + F.sum("tied").over(inner) - (F.col("tied") - 1) / 2)
    return rows.join(ranked.select(*by, value, out, "tied"), [*by, value])


def mann_whitney(rows: DataFrame, by: list[str], group: str, value: str, one) -> DataFrame:
    """([by], n1, n2, u, z, p): group ``one`` against the rest; average ranks, normal approximation with ties and continuity."""
    ranked = average_ranks(rows.where(F.col(value).isNotNull()), by, value)
    first = F.col(group) == F.lit(one)
    # a tie of t rows adds t^3 - t; every one of its rows adds t^2 - 1
    sums = ranked.groupBy(*by).agg(F.count_if(first).alias("n1"), F.count_if(~first).alias("n2"), F.sum(F.when(first, F.col("rank")).otherwise(0.0)).alias("r1"), F.sum(F.col("tied") * F.col("tied") - 1).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.when(spread > 0, F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / spread * F.signum(u - n1 * n2 / 2))
    return sums.where("n1 > 0 AND n2 > 0").select(*by, "n1", "n2", u.alias("u"), z.alias("z")).withColumn("p", normal_p(F.col("z")))


def hotelling(rows: DataFrame, by: list[str], group: str, x: str, y: str, one) -> DataFrame:
    """([by], n1, n2, t2, f, p): Hotelling's two-sample T-squared of two variables, ``one`` against the rest."""
    first = F.col(group) == F.lit(one)
    each = rows.groupBy(*by, first.alias("first")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.covar_pop(y, y).alias("yy"))
    side = lambda i, flag: each.where(F.col("first") == flag).select(*by, *[F.col(c).alias(f"{c}{i}") for c in ("n", "mx", "my", "xx", "xy", "yy")])
    both = side(1, True).join(side(2, False), by).where("n1 + n2 > 3")
    n1, n2 = F.col("n1"), F.col("n2")
    pool = lambda c: (F.col(f"{c}1") * n1 + F.col(f"{c}2") * n2) / (n1 + n2 - 2)
    dx, dy = F.col("mx1") - F.col("mx2"), F.col("my1") - F.col("my2")
    det = pool("xx") * pool("yy") - pool("xy") * pool("xy")
    t2 = n1 * n2 / (n1 + n2) * (dx * dx * pool("yy") - 2 * dx * dy * pool("xy") + dy * dy * pool("xx")) / det
    out = both.where(det > 0).select(*by, "n1", "n2", t2.alias("t2"), (t2 * (n1 + n2 - 3) / (2 * (n1 + n2 - 2))).alias("f"))
    return out.withColumn("p", fisher_p(F.col("f"), F.lit(2.0), (F.col("n1") + F.col("n2") - 3).cast("double")))


def wilcoxon(rows: DataFrame, by: list[str], difference: str) -> DataFrame:
    """([by], n, w, z, p): signed-rank test of non-zero differences; normal approximation with ties, without continuity."""
    used = rows.where(F.col(difference) != 0).select(*by, F.abs(difference).alias("__a"), (F.col(difference) > 0).alias("__up"))
    ranked = average_ranks(used, by, "__a")
    sums = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("__up"), F.col("rank")).otherwise(0.0)).alias("w"), F.sum(F.col("tied") * F.col("tied") - 1).alias("ties"))
    n = F.col("n")
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return sums.select(*by, "n", "w", z.alias("z")).withColumn("p", normal_p(F.col("z")))


def marker_ranks(weights: DataFrame, markers: DataFrame) -> DataFrame:
    """(set_name, k, gene, rank): place (from 0, ascending, ties by name) of marker genes among all genes of each factor.

    ``weights`` (gene, k, w) hold one row per gene and factor."""
    up = Window.partitionBy("k").orderBy("w", "gene")
    return weights.withColumn("rank", F.row_number().over(up) - 1).join(markers.select("set_name", "gene").distinct(), "gene").select("set_name", "k", "gene", "rank")


def marker_rank_tests(weights: DataFrame, markers: DataFrame) -> DataFrame:
    """(set_name, k, median, n, w, z, p): median rank of a set's genes, and the signed-rank test of their distance from the
    middle of all ranks."""
    ranks = marker_ranks(weights, markers)
    middle = (weights.agg(F.count_distinct("gene")).first()[0] - 1) / 2
    tests = wilcoxon(ranks.withColumn("d", F.col("rank") - middle), ["set_name", "k"], "d")
    return ranks.groupBy("set_name", "k").agg(F.median("rank").alias("median")).join(tests, ["set_name", "k"])


def feature_correlation(feature: DataFrame, loadings: DataFrame) -> DataFrame:
    """(replicate, k, n, r, p): Pearson correlation of a feature (replicate, spot_id, value) with every factor."""
    both = feature.join(loadings, ["replicate", "spot_id"]).groupBy("replicate", "k").agg(F.count(F.lit(1)).alias("n"), F.corr("value", "v").alias("r")).where("n > 2")
    df = (F.col("n") - 2).cast("double")
    return both.withColumn("p", student_p(F.col("r") * F.sqrt(df / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300))), df))


def set_expression(expr: DataFrame, genes: list[str]) -> DataFrame:
    """(replicate, spot_id, value): mean over the named genes, zeros included, for every spot with any expression."""
    hit = F.col("gene").isin(genes)
    return expr.groupBy("replicate", "spot_id").agg((F.sum(F.when(hit, F.col("value")).otherwise(0.0)) / len(set(genes))).alias("value"))


def signature_enrichment(expr: DataFrame, spots: DataFrame, signature: DataFrame) -> DataFrame:
    """(replicate, label, gene, value): mean expression of a signature's genes by label and replicate, zeros included."""
    named = spots.select("replicate", "spot_id", "label")
    sizes = small(named.join(expr.select("replicate", "spot_id").distinct(), ["replicate", "spot_id"]).groupBy("replicate", "label").agg(F.count(F.lit(1)).alias("n")))
    own = expr.join(signature.select("gene").distinct(), "gene", "left_semi").join(named, ["replicate", "spot_id"])
    sums = own.groupBy("replicate", "label", "gene").agg(F.sum("value").alias("s"))
    return sums.join(sizes, ["replicate", "label"]).select("replicate", "label", "gene", (F.col("s") / F.col("n")).alias("value"))


def paired_difference(expr: DataFrame, spots: DataFrame, pairs: list[tuple[str, str]], genes: DataFrame) -> DataFrame:
    """(one, two, label, gene, difference): mean expression in sample ``two`` less that in ``one``; 0 where a side lacks the gene."""
    mean = signature_enrichment(expr, spots, genes)
    out = None
    for one, two in pairs:
        side = lambda r, c: mean.where(F.col("replicate") == r).select("label", "gene", F.col("value").alias(c))  # noqa: E731, B023
        d = side(one, "a").join(side(two, "b"), ["label", "gene"], "full").select(F.lit(one).alias("one"), F.lit(two).alias("two"), "label", "gene", (F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).alias("difference"))
        out = d if out is None else out.union(d)
    return out


def group_average(parameters: DataFrame, groups: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(group, [keys], value): mean of per-replicate parameters over the members of each group (group, replicate)."""
    return parameters.join(small(groups), "replicate").groupBy("group", *keys).agg(F.avg(value).alias(value))


def condition_groups(replicates: DataFrame, prefixes: list[str]) -> DataFrame:
    """(group, replicate): replicates under the prefixes of their names."""
    name = F.explode(F.filter(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.col("replicate").cast("string"), p)))
    return replicates.select("replicate").distinct().withColumn("group", name).select("group", "replicate")


def gene_map(weights: DataFrame, affinity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((gene, k, value), (a, b, value)): M S and M S M', genes by genes, from weights (gene, k, w) and S (i, j, value).

    A gene's row of weights stays one array; S is a small table and the right-hand rows of M are broadcast while they are few."""
    from spotloom.functions.small import dot, packed

    k = affinity.agg(F.max("i")).first()[0] or 1
    m = packed(weights, k, ("gene",), v="w", out="m")
    columns = packed(affinity, k, ("j",), "i", "value", "col")
    s = [r.col for r in columns.orderBy("j").collect()]  # factors x factors
    ms = m.select("gene", F.array(*[dot(F.col("m"), F.array(*[F.lit(float(v)) for v in col])) for col in s]).alias("ms"))
    table = ms.select("gene", F.posexplode("ms").alias("k", "value")).withColumn("k", F.col("k") + 1)
    right = small(m.select(F.col("gene").alias("b"), "m"))
    pairs = ms.select(F.col("gene").alias("a"), "ms").crossJoin(right).select("a", "b", dot(F.col("ms"), F.col("m")).alias("value"))
    return table, pairs


def affinity_difference(affinity: DataFrame, one: str, two: str, top: int | None = None) -> DataFrame:
    """(i, j, difference, magnitude, rank): upper triangle of the matrix of ``two`` less that of ``one``, by size."""
    side = lambda r, c: affinity.where((F.col("replicate") == r) & (F.col("i") <= F.col("j"))).select("i", "j", F.col("value").alias(c))
    d = side(one, "a").join(side(two, "b"), ["i", "j"]).withColumn("difference", F.col("b") - F.col("a"))
    out = d.select("i", "j", "difference", F.sqrt(F.col("difference") * F.col("difference") + F.col("b") * F.col("b")).alias("magnitude"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(F.col("i") < 0).orderBy(F.desc(F.round(F.abs("difference"), 9)), "i", "j")))  # one row a pair of factors
    return out.where(F.col("rank") <= top) if top else out


def affinity_deviation(affinity: DataFrame, top: int = 5) -> DataFrame:
    """(replicate, i, j, difference, value, magnitude, rank): pairs i >= j by the length of (value - mean over replicates, value)."""
    shared = affinity.groupBy("i", "j").agg(F.avg("value").alias("bar"))
    d = affinity.where("i >= j").join(shared, ["i", "j"]).withColumn("difference", F.col("value") - F.col("bar"))
    d = d.withColumn("magnitude", F.sqrt(F.col("difference") * F.col("difference") + F.col("value") * F.col("value")))
    by = Window.partitionBy("replicate").orderBy(F.desc(F.round("magnitude", 9)), "i", "j")
    return d.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("replicate", "i", "j", "difference", "value", "magnitude", "rank")


def gene_trajectories(weights: DataFrame, covariate: DataFrame) -> DataFrame:
    """(gene, r, n): correlation of a gene's summed weights per group (group, gene, k, w) with the group's covariate (group, t)."""
    total = weights.groupBy("group", "gene").agg(F.sum("w").alias("w"))
    return total.join(small(covariate), "group").groupBy("gene").agg(F.corr("t", "w").alias("r"), F.count(F.lit(1)).alias("n"))


def gene_activations(weights: DataFrame, genes: list[str]) -> DataFrame:
    """(group, gene, k, w): the weights of chosen genes by group."""
    return weights.where(F.col("gene").isin(genes)).select("group", "gene", "k", "w")


def encode_labels(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``code``: the place (from 0) of the label among all labels in order; a short list."""
    names = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().collect())
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label)) - 1 if names else F.lit(None)
    return rows.withColumn("code", code.cast("int"))


def one_hot(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with one 0/1 column ``is_<label>`` per label; null labels are 0 everywhere."""
    names = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().collect())
    return rows.withColumns({f"is_{n}": F.coalesce((F.col(label) == n).cast("int"), F.lit(0)) for n in names})


