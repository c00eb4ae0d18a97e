"""Differences between replicates taken out of their loadings: mutual nearest neighbours and smooth correction vectors.

Rows of two replicates that are among each other's ``k`` nearest are taken for the same kind of spot.  Replicates are merged by
falling overlap; the smaller side of a merge moves by the mean difference of its matches, weighted by a Gaussian of the
distance to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.functions.scratch import discard, materialize
from spotloom.operators.evaluate import _block_pairs, _blocks, _unpacked, nearest_in_space, squared_distances


def mutual_pairs(rows: DataFrame, k: int = 20) -> DataFrame:
    """(a, b, src, dst): rows (replicate: string, spot_id: numbers of their own in all replicates, z) of replicates a < b that
    are among each other's ``k`` nearest rows of the other replicate.

    The search is exact, block by block (``nearest_in_space``): quadratic in the rows of a pair of replicates."""
    names = rows.select("replicate").distinct()
    both = names.select(F.col("replicate").alias("a")).join(names.select(F.col("replicate").alias("b")), F.col("a") < F.col("b"))  # a row a pair of replicates
    side = lambda c: rows.join(both, F.col("replicate") == F.col(c)).select(F.to_json(F.array("a", "b")).alias("replicate"), "spot_id", "z")
    left, right = materialize(side("a"), "align-left"), materialize(side("b"), "align-right")
    there = nearest_in_space(left, right, k).select("replicate", "src", "dst")
    back = nearest_in_space(right, left, k).select("replicate", F.col("dst").alias("src"), F.col("src").alias("dst"))
    pair = F.from_json("replicate", "array<string>")
    found = there.join(back, ["replicate", "src", "dst"]).select(pair[0].alias("a"), pair[1].alias("b"), "src", "dst")
    table = materialize(found, "align-pairs")
    discard(left)
    discard(right)
    return table


def overlaps(rows: DataFrame, pairs: DataFrame) -> list[tuple[float, str, str]]:
    """(share, a, b) by falling share: the larger of the two replicates' shares of rows with a match; a row a pair."""
    size = {r.replicate: r["count"] for r in rows.groupBy("replicate").count().collect()}
    found = pairs.groupBy("a", "b").agg(F.count_distinct("src").alias("m"), F.count_distinct("dst").alias("n")).collect()
    return sorted(((max(r.m / size[r.a], r.n / size[r.b]), r.a, r.b) for r in found), key=lambda t: (-t[0], t[1], t[2]))


def _shifted(moving: DataFrame, anchors: DataFrame, sharp: float, width: int, block: int) -> DataFrame:
    """``moving`` (replicate, spot_id, z) plus the mean ``shift`` of ``anchors`` (spot_id, z, shift), weighted by
    exp(-sharp x squared distance).  Blocks meet, and only sums a row and block move; weights are relative to the nearest
    anchor of the row, so that none vanish."""
    one = F.lit("all").alias("replicate")
    met = _block_pairs(_blocks(moving.select(one, "spot_id", "z"), block, ["spot_id", "z"]), _blocks(anchors.select(one, "spot_id", "z", "shift"), block, ["z", "shift"]))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, p, q in _unpacked(batch):
                x, at, shift = p["z"], q["z"], q["shift"]
                for i in range(0, len(x), 64):
                    e = -sharp * np.maximum(squared_distances(x[i : i + 64], at)[0], 0.0)
                    top = e.max(axis=1)
                    w = np.exp(e - top[:, None])
                    yield pa.RecordBatch.from_pydict({"spot_id": p["spot_id"][i : i + 64], "top": top, "den": w.sum(axis=1), "num": pa.array(list(w @ shift), pa.list_(pa.float64()))})

    parts = materialize(met.mapInArrow(weigh, "spot_id long, top double, den double, num array<double>"), "align-sums")
    scale = F.exp(F.col("top") - F.col("peak"))
    sums = parts.join(parts.groupBy("spot_id").agg(F.max("top").alias("peak")), "spot_id").groupBy("spot_id")
    vector = F.array(*[F.sum(F.col("num")[i] * scale) / F.sum(F.col("den") * scale) for i in range(width)])
    return moving.join(sums.agg(vector.alias("by")), "spot_id").select("replicate", "spot_id", F.zip_with("z", "by", lambda a, b: a + b).alias("z"))


def align_replicates(rows: DataFrame, k: int = 20, least: float = 0.1, sharp: float = 7.5, block: int = 8192) -> DataFrame:
    """``rows`` (replicate, spot_id, z: array<double>) with the differences between replicates taken out.

    Pairs of replicates with an overlap of ``least`` or more are merged, the largest first (ties by name); the side with fewer
    rows moves (ties: the one with the first name stays), using the matches between all replicates of both sides.  ``sharp`` is
    relative to the mean squared length of all rows.  Replicates without such a partner stay as they are, as does a single one."""
    kind = rows.schema["replicate"].dataType
    base = materialize(rows.select("replicate", "spot_id", "z").withColumn("n", F.monotonically_increasing_id()), "align-rows")
    now = base.select(F.col("replicate").cast("string").alias("replicate"), F.col("n").alias("spot_id"), "z")
    about = base.agg(F.avg(F.aggregate("z", F.lit(0.0), lambda s, v: s + v * v)).alias("square"), F.max(F.size("z")).alias("width")).first()
    pairs = mutual_pairs(now, k)
    size = {r.replicate: r["count"] for r in now.groupBy("replicate").count().collect()}  # a row a replicate
    side = {r: {r} for r in size}
    written = None
    for share, a, b in overlaps(now, pairs):
        if share < least or side[a] is side[b]:
            continue
        stays, moves = sorted((side[a], side[b]), key=lambda s: (-sum(size[r] for r in s), min(s)))
        now, held = _merged(now, pairs, stays, moves, sharp / (about.square or 1.0), about.width, block), written
        written = now
        if held is not None:
            discard(held)
        for r in moves:
            side[r] = stays
        stays |= moves
    return base.select("n", F.col("replicate").cast(kind).alias("replicate"), F.col("spot_id")).join(now.select(F.col("spot_id").alias("n"), "z"), "n").drop("n")


def _merged(now: DataFrame, pairs: DataFrame, stays: set[str], moves: set[str], sharp: float, width: int, block: int) -> DataFrame:
    """All rows, those of the replicates in ``moves`` moved to their matches in ``stays``; written."""
    here, there = sorted(moves), sorted(stays)
    ab = pairs.where(F.col("a").isin(here) & F.col("b").isin(there)).select("src", "dst")
    ba = pairs.where(F.col("b").isin(here) & F.col("a").isin(there)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    at = lambda c, z: now.select(F.col("spot_id").alias(c), F.col("z").alias(z))
    both = ab.union(ba).join(at("src", "z"), "src").join(at("dst", "to"), "dst")
    anchors = materialize(both.select(F.xxhash64("src", "dst").alias("spot_id"), "z", F.zip_with("to", "z", lambda t, z: t - z).alias("shift")), "align-anchors")
    goes = F.col("replicate").isin(here)
    table = materialize(now.where(~goes).unionByName(_shifted(now.where(goes), anchors, sharp, width, block)), "align-rows")
    discard(anchors)
    return table
