"""Delaunay graphs of spots, and the nearest row of another table, both on grids of cells.

Two spots are Delaunay neighbours if their Voronoi cells share an edge of positive length.  A spot's cell needs only the
spots that cut it.  It is first cut by the nearest spots (``knn_graph``); on the bisector towards each of them the others
leave an interval, and the intervals' ends are the cell's corners.  A corner nearer than half the reach of the known spots is
certain.  For the other corners the nearest spot of the replicate is looked up: a spot nearer than the cell's own cuts the corner
off, so it joins the known ones and the cell is cut again, until no corner finds a new spot.  All cells of a round are cut at
once in arrays; after the first round few cells are open, mostly on the rim.  No task holds a replicate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.scratch import discard, materialize
from spotloom.functions.small import exact_percentile, small
from spotloom.operators.graph import knn_graph

#: Corners of unbounded cells are looked up this many extents away, so triangles with wider circles at the rim are left out.
FAR = 1e6
_WIDE = 1e-9  # an edge of a cell counts from this share of its corners' distances on


def pyramid(data: DataFrame, per_cell: float = 4.0) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(points, levels, boxes): ``data`` (replicate, spot_id, x, y) with leaf cells cx, cy; per level, coarsest first, the
    occupied cells (replicate, gx, gy, tight box), each level with eight times finer sides; a replicate's extent."""
    box = data.groupBy("replicate").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("wide"), F.count(F.lit(1)).alias("n"))
    box = materialize(box, "pyramid-boxes")
    most = box.agg(F.max("n")).first()[0] or 1
    depth = max(1, min(9, int(np.ceil(np.log(np.sqrt(most / per_cell)) / np.log(8)))) if most > per_cell else 1)
    last = 8**depth - 1
    cell = lambda c, low: F.least(F.lit(last), F.when(F.col("wide") > 0, F.floor((F.col(c) - F.col(low)) / F.col("wide") * (last + 1))).otherwise(0)).cast("long")
    points = materialize(data.select("replicate", "spot_id", "x", "y").join(small(box), "replicate").select("replicate", "spot_id", "x", "y", cell("x", "x0").alias("cx"), cell("y", "y0").alias("cy")), "pyramid-points")
    leaf = points.groupBy("replicate", F.col("cx").alias("gx"), F.col("cy").alias("gy")).agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    levels = [materialize(leaf, "pyramid-cells")]
    for _ in range(depth - 1):
        up = levels[0].groupBy("replicate", F.expr("gx div 8").alias("gx"), F.expr("gy div 8").alias("gy"))
        levels.insert(0, materialize(up.agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2")), "pyramid-cells"))
    return points, levels, box


def _bounds() -> tuple[Column, Column]:
    """Squared distances between which a cell's nearest point lies: to its box, and to the farther end of the nearer side
    (every side of a tight box holds a point)."""
    x, y, x1, x2, y1, y2 = (F.col(c) for c in ("x", "y", "x1", "x2", "y1", "y2"))
    gap = lambda v, low, high: F.greatest(low - v, v - high, F.lit(0.0))
    near = lambda v, low, high: F.least(F.abs(v - low), F.abs(v - high))
    far = lambda v, low, high: F.greatest(F.abs(v - low), F.abs(v - high))
    sq = lambda v: v * v
    low = sq(gap(x, x1, x2)) + sq(gap(y, y1, y2))
    return low, F.least(sq(near(x, x1, x2)) + sq(far(y, y1, y2)), sq(near(y, y1, y2)) + sq(far(x, x1, x2)))


def nearest_points(queries: DataFrame, points: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(replicate, q, spot_id, px, py, distance): the point of the replicate nearest each query (replicate, q, x, y), ties by id.

    A descent of the cells of ``pyramid``: of the cells met on a level those stay whose box may hold the nearest point.  Queries
    of a replicate without points are left out.  Levels of up to 100,000 cells are broadcast, finer ones are joined by
    cell, so neither the queries nor the points may outgrow a machine."""
    now = queries.select("replicate", "q", "x", "y", F.lit(0).cast("long").alias("gx"), F.lit(0).cast("long").alias("gy"))
    whole = Window.partitionBy("replicate", "q")
    low, high = _bounds()
    for cells in levels:
        below = cells.withColumn("px", F.expr("gx div 8")).withColumn("py", F.expr("gy div 8"))
        met = now.select("replicate", "q", "x", "y", F.col("gx").alias("px"), F.col("gy").alias("py")).join(small(below), ["replicate", "px", "py"])
        met = met.select("replicate", "q", "x", "y", "gx", "gy", low.alias("low"), high.alias("high"))
        now = met.withColumn("most", F.min("high").over(whole)).where(F.col("low") <= F.col("most") * (1 + 1e-12)).select("replicate", "q", "x", "y", "gx", "gy")
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    at = points.select("replicate", F.col("cx").alias("gx"), F.col("cy").alias("gy"), "spot_id", F.col("x").alias("px"), F.col("y").alias("py"))
    found = now.join(at, ["replicate", "gx", "gy"]).groupBy("replicate", "q").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "spot_id", "px", "py")).alias("best"))
    return found.select("replicate", "q", "best.spot_id", "best.px", "best.py", F.sqrt("best.d2").alias("distance"))


def nearest_object(spots: DataFrame, objects: DataFrame) -> DataFrame:
    """(replicate, spot_id, object_id, distance): the nearest row of ``objects`` (replicate, object_id, x, y) of each spot."""
    points, levels, _ = pyramid(objects.withColumnRenamed("object_id", "spot_id"))
    found = nearest_points(spots.select("replicate", F.col("spot_id").alias("q"), "x", "y"), points, levels)
    return found.select("replicate", F.col("q").alias("spot_id"), F.col("spot_id").alias("object_id"), "distance")


def spans(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) per row and known spot: where on the bisector towards it, in lengths of the connecting line from its
    middle, no other known spot is nearer.  ``near`` is rows x spots x 2, relative to the row's own spot, NaN where absent."""
    norm = (near**2).sum(axis=2)
    inner = near @ near.transpose(0, 2, 1)  # i, j: product of spots i and j
    side = near[:, :, None, 0] * near[:, None, :, 1] - near[:, :, None, 1] * near[:, None, :, 0]  # of spot j across the line to i
    room = norm[:, None, :] - inner
    scale = np.sqrt(norm[:, :, None] * norm[:, None, :])
    flat = np.abs(side) <= 1e-13 * scale
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = room / (2 * side)
    own = np.eye(near.shape[1], dtype=bool)[None]
    high = np.where((side > 0) & ~flat & ~own, bound, np.inf)
    low = np.where((side < 0) & ~flat & ~own, bound, -np.inf)
    low, high = low.max(axis=2), high.min(axis=2)
    blocked = (flat & ~own & (room < 0)).any(axis=2) | np.isnan(norm)
    return np.where(blocked, np.inf, low), np.where(blocked, -np.inf, high)


def _edge(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    size = np.maximum(1.0, np.minimum(np.abs(low), np.abs(high)))
    with np.errstate(invalid="ignore"):
        return high - low > _WIDE * size


_CELL = "replicate string, src long, x double, y double, reach double, wide double, ids array<long>, px array<double>, py array<double>"


def _cut(batches: Iterator[pd.DataFrame], chunk: int = 256) -> Iterator[pd.DataFrame]:
    """Cells cut by their known spots: the neighbours, and the corners (vx, vy) that are not certain."""
    for whole in batches:
        for start in range(0, len(whole), chunk):
            t = whole.iloc[start : start + chunk].reset_index(drop=True)
            k = max(map(len, t["ids"]))
            near = np.full((len(t), k, 2), np.nan)
            for i, (a, b) in enumerate(zip(t["px"], t["py"], strict=True)):
                near[i, : len(a), 0], near[i, : len(a), 1] = a, b
            near -= t[["x", "y"]].to_numpy()[:, None, :]
            low, high = spans(near)
            keep = _edge(low, high)
            length = np.sqrt((near**2).sum(axis=2))
            most = FAR * t["wide"].to_numpy()[:, None] / length  # corners at infinity are looked up from here
            neighbours, vx, vy = [], [], []
            for i in range(len(t)):
                at = np.flatnonzero(keep[i])
                neighbours.append([int(t["ids"][i][j]) for j in at])
                ends = np.concatenate((np.maximum(low[i, at], -most[i, at]), np.minimum(high[i, at], most[i, at])))
                to = np.tile(near[i, at], (2, 1))
                corner = to / 2 + ends[:, None] * np.stack((-to[:, 1], to[:, 0]), axis=1)
                corner = corner[2 * np.sqrt((corner**2).sum(axis=1)) > t["reach"][i]]
                corner = np.unique(corner.round(12), axis=0)
                vx.append((corner[:, 0] + t["x"][i]).tolist())
                vy.append((corner[:, 1] + t["y"][i]).tolist())
            yield t.assign(neighbours=neighbours, vx=vx, vy=vy)


def delaunay_graph(spots: DataFrame, k: int = 20, rounds: int = 60) -> DataFrame:
    """(replicate, src, dst, distance): both directions of every Delaunay edge of each replicate (a string).

    Of spots at the same place the one of smallest id takes part; the others have no edge.  Where more than three spots lie on
    one empty circle (grids), pairs that touch in a corner only are no neighbours, so the graph is unique."""
    sites = spots.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(F.col("replicate").cast("string").alias("replicate"), "x", "y").agg(F.min("spot_id").alias("spot_id"))
    sites = materialize(sites.select("replicate", "spot_id", "x", "y"), "delaunay-sites")
    points, levels, box = pyramid(sites)
    place = lambda side, x, y: sites.select("replicate", F.col("spot_id").alias(side), F.col("x").alias(x), F.col("y").alias(y))
    known = knn_graph(sites, k).join(place("dst", "px", "py"), ["replicate", "dst"]).groupBy("replicate", "src")
    known = known.agg(F.max("distance").alias("reach"), F.collect_list("dst").alias("ids"), F.collect_list("px").alias("px"), F.collect_list("py").alias("py"))
    cells = known.join(place("src", "x", "y"), ["replicate", "src"]).join(small(box.select("replicate", "wide", "n")), "replicate")
    reach = F.when(F.col("n") <= k + 1, F.lit(float("inf"))).otherwise(F.col("reach"))
    columns = [c.split()[0] for c in _CELL.split(", ")]
    now = cells.withColumn("reach", reach).select(*columns)
    done: list[DataFrame] = []
    for _ in range(rounds):
        cut = materialize(now.mapInPandas(_cut, f"{_CELL}, neighbours array<long>, vx array<double>, vy array<double>"), "delaunay-cells")
        open_ = cut.where(F.size("vx") > 0)
        done.append(cut.where(F.size("vx") == 0).select("replicate", "src", "neighbours"))
        if open_.isEmpty():
            break
        corners = materialize(open_.select("replicate", "src", "ids", F.explode(F.arrays_zip("vx", "vy")).alias("v")).select("replicate", "src", "ids", F.col("v.vx").alias("x"), F.col("v.vy").alias("y")).withColumn("q", F.monotonically_increasing_id()), "delaunay-corners")
        found = corners.select("replicate", "q", "src", "ids").join(nearest_points(corners, points, levels), ["replicate", "q"])
        found = found.where((F.col("spot_id") != F.col("src")) & ~F.array_contains("ids", F.col("spot_id"))).select("replicate", "src", "spot_id", "px", "py").distinct()
        added = found.groupBy("replicate", "src").agg(F.collect_list("spot_id").alias("a_ids"), F.collect_list("px").alias("a_px"), F.collect_list("py").alias("a_py"))
        added = materialize(added, "delaunay-added")
        done.append(open_.join(added, ["replicate", "src"], "left_anti").select("replicate", "src", "neighbours"))
        more = open_.join(added, ["replicate", "src"])
        now = more.select("replicate", "src", "x", "y", "reach", "wide", *[F.concat(c, f"a_{c}").alias(c) for c in ("ids", "px", "py")])
        discard(corners)
    else:
        raise RuntimeError(f"cells still open after {rounds} rounds")
    pairs = done[0]
    for part in done[1:]:
        pairs = pairs.union(part)
    one = pairs.select("replicate", "src", F.explode("neighbours").alias("dst"))
    both = one.union(one.select("replicate", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    apart = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return both.join(place("src", "ax", "ay"), ["replicate", "src"]).join(place("dst", "bx", "by"), ["replicate", "dst"]).select("replicate", "src", "dst", apart.alias("distance"))


def delaunay_within(spots: DataFrame, percentile: float = 94.5, k: int = 20) -> DataFrame:
    """The Delaunay graph without edges longer than their replicate's ``percentile``."""
    edges = materialize(delaunay_graph(spots, k), "delaunay-edges")
    cut = exact_percentile(edges, ["replicate"], "distance", percentile / 100, "cut")
    return edges.join(small(cut), "replicate").where(F.col("distance") <= F.col("cut")).drop("cut")
