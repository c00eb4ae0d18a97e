"""Trends of values over a covariate, and groups of neighbouring covariate values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trends(rows: DataFrame, by: str = "feature", t: str = "t", value: str = "value") -> DataFrame:
    """(by, r, variance, slope, n): correlation with the covariate, population variance, least-squares slope."""
    r = F.corr(t, value)
    return rows.groupBy(by).agg(r.alias("r"), F.var_pop(value).alias("variance"), (r * F.stddev_pop(value) / F.stddev_pop(t)).alias("slope"), F.count(F.lit(1)).alias("n"))


def top_trends(table: DataFrame, metric: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest ``metric`` (smallest for negative ``n``), ties by name."""
    order = F.desc(metric) if n > 0 else F.asc(metric)
    return table.orderBy(order, table.columns[0]).limit(abs(n))


def neighbour_groups(rows: DataFrame, width: int = 1, t: str = "t", by: str = "feature") -> DataFrame:
    """(by, centre, member): for every distinct covariate value with ``width`` values on both sides, the values in
    that window."""
    values = rows.select(by, t).distinct()
    w = Window.partitionBy(by).orderBy(t)
    ranked = values.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    centres = ranked.where((F.col("rank") > width) & (F.col("rank") <= F.col("n") - width)).select(by, F.col(t).alias("centre"), F.explode(F.sequence(F.col("rank") - width, F.col("rank") + width)).alias("rank"))
    return centres.join(ranked.select(by, "rank", F.col(t).alias("member")), [by, "rank"]).select(by, "centre", "member")
