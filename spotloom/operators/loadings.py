"""Element-wise and matrix operators on long loadings (replicate, spot_id, k, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.small import exact_percentile, small

SPOT = ["replicate", "spot_id"]


def l1_normalize(loadings: DataFrame) -> DataFrame:
    """Loadings over the sum of their absolute values per spot; a spot of zeros stays zero."""
    total = F.sum(F.abs("v")).over(Window.partitionBy(*SPOT))
    return loadings.withColumn("v", F.when(total > 0, F.col("v") / total).otherwise(0.0))


def zscore(loadings: DataFrame) -> DataFrame:
    """Loadings standardised per replicate and factor (population deviation); constant factors become 0."""
    mom = loadings.groupBy("replicate", "k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return loadings.join(small(mom), ["replicate", "k"]).select("replicate", "spot_id", "k", F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(0.0).alias("v"))


def project_simplex(loadings: DataFrame) -> DataFrame:
    """Euclidean projection of every spot's loadings onto the simplex, exact by sorting."""
    down = Window.partitionBy(*SPOT).orderBy(F.desc("v"), "k")
    ranked = loadings.withColumn("r", F.row_number().over(down)).withColumn("c", F.sum("v").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    cut = F.max(F.when(F.col("v") > (F.col("c") - 1) / F.col("r"), F.struct("r", ((F.col("c") - 1) / F.col("r")).alias("t")))).over(Window.partitionBy(*SPOT))
    return ranked.select("replicate", "spot_id", "k", F.greatest(F.col("v") - cut["t"], F.lit(0.0)).alias("v"))


def rank_loadings(loadings: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(replicate, spot_id, k, rank): ranks from 0; values below ``threshold`` all get their mean rank, rounded down."""
    up = Window.partitionBy(*SPOT).orderBy("v", "k")
    low = F.col("v") < threshold
    r = loadings.withColumn("r", F.row_number().over(up) - 1)
    mean = F.avg(F.when(low, F.col("r"))).over(Window.partitionBy(*SPOT))
    return r.select("replicate", "spot_id", "k", F.when(low, mean).otherwise(F.col("r")).cast("int").alias("rank"))


def gram(loadings: DataFrame) -> DataFrame:
    """(i, j, value): X'X, from each spot's own factors; a spot's loadings meet in one row, products are added before they move."""
    one = loadings.groupBy(*SPOT).agg(F.collect_list(F.struct("k", "v")).alias("x"))
    left = one.select(F.explode("x").alias("a"), "x")
    both = left.select("a", F.explode("x").alias("b"))
    return both.groupBy(F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("value"))


def column_correlation(weights: DataFrame, row: str | list[str]) -> DataFrame:
    """(i, j, value): Pearson correlation of factors over rows (``row``, k, v)."""
    one = weights.groupBy(*([row] if isinstance(row, str) else row)).agg(F.collect_list(F.struct("k", "v")).alias("x"))
    both = one.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b"))
    return both.groupBy(F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(F.corr("a.v", "b.v").alias("value"))


def high_threshold(loadings: DataFrame, share: float = 0.99) -> DataFrame:
    """(replicate, k, threshold, n_above): the exact percentile per factor and how many values exceed it."""
    cut = exact_percentile(loadings, ["replicate", "k"], "v", share, "threshold")
    return loadings.join(small(cut), ["replicate", "k"]).groupBy("replicate", "k", "threshold").agg(F.count_if(F.col("v") > F.col("threshold")).alias("n_above"))


def normalize_by_threshold(loadings: DataFrame, share: float = 0.99) -> DataFrame:
    """Loadings over threshold times the number of values above it."""
    cut = high_threshold(loadings, share)
    return loadings.join(small(cut), ["replicate", "k"]).select("replicate", "spot_id", "k", (F.col("v") / (F.col("threshold") * F.col("n_above"))).alias("v"))


def loadings_by_label(loadings: DataFrame, spots: DataFrame) -> DataFrame:
    """(replicate, label, k, mean_expressed, expressed): mean over non-zero values, and their number."""
    named = loadings.join(spots.select(*SPOT, "label"), SPOT)
    return named.groupBy("replicate", "label", "k").agg((F.sum("v") / F.count_if(F.col("v") != 0)).alias("mean_expressed"), F.count_if(F.col("v") != 0).alias("expressed"))


def mean_profile_difference(loadings: DataFrame, spots: DataFrame, one: str, two: str) -> DataFrame:
    """(label, k, difference): mean loading in replicate ``two`` minus ``one``; 0 where a side has no spots."""
    named = loadings.join(spots.select(*SPOT, "label"), SPOT)
    mean = lambda r, c: named.where(F.col("replicate") == r).groupBy("label", "k").agg(F.avg("v").alias(c))
    both = mean(one, "a").join(mean(two, "b"), ["label", "k"], "full")
    return both.select("label", "k", F.coalesce(F.col("b") - F.col("a"), F.lit(0.0)).alias("difference"))


def outlying_rows(weights: DataFrame, centre: DataFrame, top: int, row: str = "gene", group: list[str] | None = None) -> DataFrame:
    """([group], k, row, difference, rank): the ``top`` rows per group and factor that differ most from the shared value.

    ``weights`` ([group], row, k, v) and ``centre`` (row, k, v); ties by name."""
    group = group or ["replicate"]
    off = weights.join(centre.select(row, "k", F.col("v").alias("c")), [row, "k"]).withColumn("difference", F.abs(F.col("v") - F.col("c")))
    w = Window.partitionBy(*group, "k").orderBy(F.desc(F.round("difference", 9)), row)
    return off.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(*group, "k", row, "difference", "rank")
