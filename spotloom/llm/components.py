"""Connected components of a link table, without gathering the links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.functions.scratch import materialize


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step: link each node's larger (or smaller) neighbours to the smallest node it knows."""
    both = _both_ways(links)
    seen = both if large else both.where("v < u")
    hub = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.where("v > u") if large else seen.where("v <> u")
    out = near.join(hub, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(hub.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v: long), component being its smallest reachable node.

    Alternates large-star and small-star steps (O(log^2 n) rounds) until the links no longer change.  Each round is
    two joins on partially aggregated keys and ends in a table in the shared folder.  An empty table gives none.
    """
    now = materialize(links.where("u <> v").select("u", "v").distinct(), "links")
    sign = None
    for _ in range(max_rounds):
        was = sign
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == was or not sign[0]:
            break
        now = materialize(_star(_star(now, large=True), large=False), "links")
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    # at the fixed point every link joins a node to the smallest of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
