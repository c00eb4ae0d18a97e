"""Joins with small tables: broadcast behind a check of their size, an ordinary join beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def small(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """``table`` evaluated once and marked for broadcast if it has at most ``rows`` rows; else ``table`` itself."""
    got = table.limit(rows + 1).collect()
    return table if len(got) > rows else F.broadcast(table.sparkSession.createDataFrame(got, table.schema))


def exact_percentile(rows: DataFrame, keys: list[str], value: str, share: float, out: str, lower: bool = False) -> DataFrame:
    """([keys], out): the exact linearly interpolated percentile per group, or with ``lower`` the value at or below it.

    A sketch brackets the wanted ranks within two thousandths of a group (of 5000 values or more; all of smaller ones); only
    distinct values in the bracket are ordered, so no task holds a large group's values.
    """
    eps = 1e-3
    ends = F.percentile_approx(value, [max(0.0, share - eps), min(1.0, share + eps)], 10_000)
    sketch = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(ends.alias("__e"), F.count(F.lit(1)).alias("__n"))
    few = F.col("__n") < 5000
    sketch = small(sketch.select(*keys, F.when(~few, F.col("__e")[0]).alias("__lo"), F.when(~few, F.col("__e")[1]).alias("__hi"), "__n"))
    near = rows.where(F.col(value).isNotNull()).join(sketch, keys)
    kind = F.when(F.col(value) < F.col("__lo"), F.lit(None)).otherwise(F.col(value))
    counts = near.where(F.col("__hi").isNull() | (F.col(value) <= F.col("__hi"))).groupBy(*keys, kind.alias("__v")).agg(F.count(F.lit(1)).alias("__c"), F.first("__n").alias("__n"))
    upto = counts.withColumn("__u", F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.lit(share) * (F.col("__n") - 1)
    at = lambda r: F.min(F.when(F.col("__u") > r, F.col("__v")))
    both = upto.groupBy(*keys).agg(at(F.floor(rank)).alias("__a"), at(F.ceil(rank)).alias("__b"), F.first(rank - F.floor(rank)).alias("__f"))
    if lower:
        return both.select(*keys, F.col("__a").alias(out))
    return both.select(*keys, (F.col("__a") + F.col("__f") * (F.col("__b") - F.col("__a"))).alias(out))


def packed(loadings: DataFrame, factors: int, keys: tuple[str, ...] = ("replicate", "spot_id"), k: str = "k", v: str = "v", out: str = "z") -> DataFrame:
    """([keys], out): one array of ``factors`` values per row from (keys, k from 1, v); absent ones are 0."""
    values = F.map_from_entries(F.collect_list(F.struct(k, v)))
    dense = F.transform(F.sequence(F.lit(1), F.lit(factors)), lambda i: F.coalesce(F.col("__m")[i], F.lit(0.0)))
    return loadings.groupBy(*keys).agg(values.alias("__m")).select(*keys, dense.alias(out))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
