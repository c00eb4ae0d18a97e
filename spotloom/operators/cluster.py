"""Communities of a neighbour graph, principal components, partition bins, and graphs by geometry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.scratch import materialize
from spotloom.functions.small import dot, exact_percentile, packed, small
from spotloom.operators.align import align_replicates
from spotloom.operators.graph import smooth_labels, smooth_loadings, symmetric_edges
from spotloom.operators.leiden import communities_near
from spotloom.operators.near_rows import nearest_about


def gabriel_graph(knn: DataFrame) -> DataFrame:
    """(replicate, src, dst, distance): neighbour pairs whose circle on the pair as diameter holds no other spot.

    A spot in that circle is nearer to ``src`` than ``dst`` is, so the earlier entries of ``src``'s own neighbour list
    are all that need be checked.  The graph is a part of the Delaunay triangulation.
    """
    a = knn.select("replicate", "src", "dst", "distance", "rank", "x", "y", "dx", "dy")
    b = knn.select("replicate", "src", F.col("rank").alias("r2"), F.col("distance").alias("d2"), F.col("dx").alias("kx"), F.col("dy").alias("ky"))
    far = (F.col("dx") - F.col("kx")) * (F.col("dx") - F.col("kx")) + (F.col("dy") - F.col("ky")) * (F.col("dy") - F.col("ky"))
    inside = F.col("d2") * F.col("d2") + far < F.col("distance") * F.col("distance") * (1 - 1e-12)
    blocked = a.join(b, ["replicate", "src"]).where((F.col("r2") < F.col("rank")) & inside).select("replicate", "src", "dst").distinct()
    free = a.join(blocked, ["replicate", "src", "dst"], "left_anti").select("replicate", "src", "dst", "distance")
    return free.union(free.select("replicate", F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).dropDuplicates(["replicate", "src", "dst"])


def with_positions(knn: DataFrame, spots: DataFrame) -> DataFrame:
    """``knn`` with the positions of both ends (x, y and dx, dy)."""
    at = lambda side, x, y: spots.select("replicate", F.col("spot_id").alias(side), F.col("x").alias(x), F.col("y").alias(y))
    return knn.join(at("src", "x", "y"), ["replicate", "src"]).join(at("dst", "dx", "dy"), ["replicate", "dst"])


def loading_graph(loadings: DataFrame, k: int, factors: int) -> tuple[DataFrame, DataFrame]:
    """((replicate, src, dst, distance), (replicate, spot_id, n)): symmetric graph of nearly the ``k`` nearest spots by loadings
    over all replicates together (``nearest_about``), its ends being numbers n of spots; its one replicate is called all."""
    rows = materialize(packed(loadings, factors).withColumn("n", F.monotonically_increasing_id()), "loading-rows")
    joint = rows.select(F.lit("all").alias("replicate"), F.col("n").alias("spot_id"), "z")
    return symmetric_edges(nearest_about(joint, k)), rows.select("replicate", "spot_id", "n")


def domains(spots: DataFrame, edges: DataFrame, loadings: DataFrame, target: int, k: int = 40, factors: int | None = None, tolerance: float = 0.05, batch_correct: bool = False) -> DataFrame:
    """(replicate, spot_id, label, smoothed): spatial domains over all replicates together.

    Loadings (with ``batch_correct`` after ``align_replicates``) are averaged over neighbours, joined to their ``k`` nearest in loadings, parted into ``target`` communities
    (``communities_near``), and a spot whose neighbours mostly hold another label takes it.  Labels count from 0 by size."""
    width = factors or loadings.agg(F.max("k")).first()[0] or 1
    if batch_correct:
        fixed = align_replicates(packed(loadings, width))
        loadings = fixed.select("replicate", "spot_id", F.posexplode("z").alias("k", "v")).withColumn("k", F.col("k") + 1)
    near, numbers = loading_graph(smooth_loadings(edges, loadings), k, width)
    found = communities_near(materialize(near, "domain-edges"), target, tolerance=tolerance)[0]
    size = found.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("spot_id").alias("first"))
    order = Window.partitionBy(F.col("n").isNull()).orderBy(F.desc("n"), "first")  # a row a community
    named = found.join(small(size.select("community", (F.row_number().over(order) - 1).alias("label"))), "community")
    own = numbers.join(named.select(F.col("spot_id").alias("n"), "label"), "n").select("replicate", "spot_id", "label")
    return smooth_labels(spots.select("replicate", "spot_id").join(own, ["replicate", "spot_id"]), edges)


def components_by_replicate(loadings: DataFrame, n: int, factors: int | None = None) -> DataFrame:
    """(replicate, spot_id, component, value): ``principal_components`` of every replicate by itself.

    One pass adds up factors x factors products for all replicates; the driver holds one such matrix a replicate."""
    k = factors or loadings.agg(F.max("k")).first()[0] or 1
    z = materialize(packed(loadings, k), "pca-rows")
    both = z.select("replicate", F.posexplode("z").alias("i", "a"), "z").select("replicate", "i", "a", F.posexplode("z").alias("j", "b")).where("i <= j")
    rows = both.groupBy("replicate", "i", "j").agg(F.coalesce(F.covar_samp("a", "b"), F.lit(0.0)).alias("c"), F.avg("a").alias("m")).collect()
    table = []
    for replicate in sorted({r.replicate for r in rows}, key=str):
        cov, mean = np.zeros((k, k)), np.zeros(k)
        for r in rows:
            if r.replicate == replicate:
                cov[r.i, r.j] = cov[r.j, r.i] = r.c
                mean[r.i] = r.m
        values, vectors = np.linalg.eigh(cov)
        v = vectors[:, np.argsort(-values)[:n]]
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        table.append((replicate, mean.tolist(), v.T.tolist()))
    kind = loadings.schema["replicate"].dataType.simpleString()
    turn = small(loadings.sparkSession.createDataFrame(table, f"replicate {kind}, m array<double>, v array<array<double>>"))
    centred = z.join(turn, "replicate").withColumn("z", F.zip_with("z", "m", lambda a, b: a - b))
    out = centred.select("replicate", "spot_id", "z", F.posexplode("v").alias("component", "w"))
    return out.select("replicate", "spot_id", (F.col("component") + 1).alias("component"), dot(F.col("z"), F.col("w")).alias("value"))


def principal_components(loadings: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """((replicate, spot_id, component, value), variances): components of centred loadings, signs made positive at the
    largest weight.  Only the factors x factors covariance reaches the driver."""
    k = loadings.agg(F.max("k")).first()[0]
    z = packed(loadings, k)
    both = z.select(F.posexplode("z").alias("i", "a"), "z").select((F.col("i") + 1).alias("i"), "a", F.posexplode("z").alias("j", "b")).withColumn("j", F.col("j") + 1)
    cov = np.zeros((k, k))
    for r in both.groupBy("i", "j").agg(F.covar_samp("a", "b").alias("c")).collect():
        cov[r.i - 1, r.j - 1] = r.c
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:n]
    v = vectors[:, order]
    v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    table = loadings.sparkSession.createDataFrame([(i + 1, c + 1, float(v[i, c])) for i in range(k) for c in range(len(order))], "k int, component int, w double")
    centre = loadings.groupBy("k").agg(F.avg("v").alias("m"))
    out = loadings.join(small(centre), "k").join(F.broadcast(table), "k").groupBy("replicate", "spot_id", "component").agg(F.sum((F.col("v") - F.col("m")) * F.col("w")).alias("value"))
    return out, values[order]


def partition_bins(spots: DataFrame, depth: int | None = None, per_bin: int = 64, most: int | None = None) -> DataFrame:
    """(replicate, spot_id, bin_id): 2^depth bins of about equal size by halving at exact lower medians, x and y in turn.

    Without ``depth`` the largest replicate decides: its bins hold about ``per_bin`` spots, or more where that takes over ``most`` levels.

    A level is one bracketed median per part (``exact_percentile``) and a join with the parts, never a sort of a replicate.
    """
    if depth is None:
        largest = spots.groupBy("replicate").count().agg(F.max("count")).first()[0] or 1
        depth = max(0, int(np.ceil(np.log2(largest / per_bin))))
        depth = depth if most is None else min(depth, most)
    now = spots.select("replicate", "spot_id", "x", "y", F.lit(0).alias("bin_id"))
    for level in range(depth):
        axis = "x" if level % 2 == 0 else "y"
        mids = exact_percentile(now, ["replicate", "bin_id"], axis, 0.5, "mid", lower=True)
        now = materialize(now.join(small(mids), ["replicate", "bin_id"]).select("replicate", "spot_id", "x", "y", (2 * F.col("bin_id") + (F.col(axis) > F.col("mid")).cast("int")).alias("bin_id")), "partition")
    return now.select("replicate", "spot_id", "bin_id")
