"""Over-representation of gene sets among selected genes."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.scratch import materialize


def hypergeometric_tail(shared: int, chosen: int, members: int, total: int) -> float:
    """Probability of ``shared`` or more members among ``chosen`` of ``total`` genes drawn at random."""

    def log_choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    whole = log_choose(total, chosen)
    low = max(shared, chosen + members - total)
    return min(1.0, sum(exp(log_choose(members, x) + log_choose(total - members, chosen - x) - whole) for x in range(low, min(chosen, members) + 1)))


def over_representation(members: DataFrame, chosen: DataFrame, background: DataFrame) -> DataFrame:
    """(signature, set_name, shared, p): for sets (set_name, gene) and signatures (signature, gene), both cut to the
    background genes, the hypergeometric tail of their overlap.  Genes, sets and signatures are written once; later steps scan them."""
    genes = materialize(background.select("gene").distinct(), "genes")
    total = genes.count()
    sets = materialize(members.select("set_name", "gene").distinct().join(genes, "gene", "left_semi"), "gene-sets")
    picks = materialize(chosen.select("signature", "gene").distinct().join(genes, "gene", "left_semi"), "signatures")
    size = sets.groupBy("set_name").agg(F.count(F.lit(1)).alias("members"))
    many = picks.groupBy("signature").agg(F.count(F.lit(1)).alias("chosen")).collect()  # one short row a signature
    both = picks.join(sets, "gene").groupBy("signature", "set_name").agg(F.count(F.lit(1)).alias("shared"))
    table = F.array(*[F.struct(F.lit(r.signature).alias("signature"), F.lit(r.chosen).alias("chosen")) for r in many]) if many else F.array().cast("array<struct<signature:string,chosen:long>>")
    grid = size.withColumn("e", F.explode(table)).select("set_name", "members", "e.signature", "e.chosen", F.lit(total).cast("long").alias("total"))
    grid = grid.join(both, ["signature", "set_name"], "left").na.fill(0, ["shared"])

    @F.pandas_udf("double")
    def tail(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for cols in parts:
            known = {row: hypergeometric_tail(*row) for row in set(zip(*cols, strict=True))}
            yield pd.Series([known[row] for row in zip(*cols, strict=True)], dtype="float64")

    return grid.select("signature", "set_name", "shared", tail("shared", "chosen", "members", "total").alias("p"))


def signature_by_knee(weights: DataFrame, sensitivity: float = 1.0, high: bool = True) -> DataFrame:
    """(k, gene, w): genes from the knee of the factor's sorted weights (gene, k, w) on: the largest, or the smallest before it.

    The curve of weights, read from its flat end and scaled to the unit square, rises over the diagonal.  A local maximum of the
    difference is the knee, if the difference then falls by ``sensitivity`` mean steps before a local minimum, or below zero
    after one; the first such maximum counts.  Without a knee every gene stays.  ``high`` takes the convex curve from the
    largest weight down, otherwise the concave one from the smallest up (the knee itself left out).  Ties by name.
    """
    by = Window.partitionBy("k")
    n = F.count(F.lit(1)).over(by)
    up = F.row_number().over(by.orderBy("w", "gene")) - 1
    scaled = (F.col("w") - F.min("w").over(by)) / F.greatest(F.max("w").over(by) - F.min("w").over(by), F.lit(1e-300))
    steps = F.greatest(n - 1, F.lit(1))
    place, rise = (n - 1 - up, 1 - scaled) if high else (up, scaled)
    curve = weights.select("k", "gene", "w", place.alias("p"), F.round(rise - place / steps, 12).alias("d"), (sensitivity / steps).alias("step"))
    walk = by.orderBy("p")
    sofar = walk.rowsBetween(Window.unboundedPreceding, 0)
    before, after = F.coalesce(F.lag("d").over(walk), F.col("d")), F.coalesce(F.lead("d").over(walk), F.col("d"))
    turns = curve.withColumns({"next": F.lead("d").over(walk), "top": (F.col("d") >= before) & (F.col("d") >= after), "low": (F.col("d") <= before) & (F.col("d") <= after)})
    last = lambda flag, value: F.last(F.when(F.col(flag), F.col(value)), ignorenulls=True).over(sofar)
    seen = turns.withColumns({"at": last("top", "p"), "peak": last("top", "d"), "dip": F.coalesce(last("low", "p"), F.lit(-1))})
    fallen = F.col("next") < F.when(F.col("dip") >= F.col("at"), F.lit(0.0)).otherwise(F.col("peak") - F.col("step"))
    knee = seen.where(fallen).groupBy("k").agg(F.min_by("at", "p").alias("cut"))
    inside = F.col("p") <= F.col("cut") if high else F.col("p") < F.col("cut")
    return curve.join(knee, "k", "left").where(F.col("cut").isNull() | inside).select("k", "gene", "w")
