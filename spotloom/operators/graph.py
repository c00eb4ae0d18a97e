"""Neighbour graphs over two-dimensional spots, and what is summed or averaged along their edges.

A spot is known by its replicate and its id: ids may repeat in other replicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.small import dot, exact_percentile, packed, small

SRC, DST = ["replicate", "src"], ["replicate", "dst"]


def knn_graph(spots: DataFrame, k: int = 6, per_cell: float = 2.0) -> DataFrame:
    """(replicate, src, dst, distance, rank): the exact k nearest spots of each spot in its replicate, ties by id.

    An equi-join on grid cells instead of a pairwise join.  Cells form a pyramid (each level doubles the side).  Every
    spot uses the finest level at which the 3 x 3 cells around it hold more than k spots: its k-th neighbour then lies
    within ``2 * sqrt(2)`` sides, hence inside the 7 x 7 cells that it is joined with.  Dense and sparse regions thus
    get candidates in proportion to k, not to the replicate's size.
    """
    box = spots.groupBy("replicate").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("wide"), F.count(F.lit(1)).alias("n"))
    box = box.withColumn("top", F.greatest(F.lit(0), F.least(F.lit(24), F.ceil(F.log2(F.sqrt(F.col("n") / per_cell))).cast("int"))))
    box = box.withColumn("side", F.when(F.col("wide") > 0, F.col("wide") / F.pow(F.lit(2.0), F.col("top"))).otherwise(F.lit(1.0)))
    placed = spots.select("replicate", "spot_id", "x", "y").join(small(box), "replicate")
    placed = placed.select("replicate", "spot_id", "x", "y", "top", F.floor((F.col("x") - F.col("x0")) / F.col("side")).cast("int").alias("cx"), F.floor((F.col("y") - F.col("y0")) / F.col("side")).cast("int").alias("cy"))
    at = lambda c: F.expr(f"shiftright({c}, level)")
    cells = placed.groupBy("replicate", "cx", "cy", "top").agg(F.count(F.lit(1)).alias("n"))
    leveled = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top") + 1))).select("replicate", "level", at("cx").alias("gx"), at("cy").alias("gy"), "n")
    counts = leveled.groupBy("replicate", "level", "gx", "gy").agg(F.sum("n").alias("n"))
    blocks = _around(counts, 1).groupBy("replicate", "level", "gx", "gy").agg(F.sum("n").alias("n")).where(F.col("n") > k)
    finest = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top") + 1))).withColumn("gx", at("cx")).withColumn("gy", at("cy")).drop("n")
    finest = finest.join(blocks, ["replicate", "level", "gx", "gy"], "left").groupBy("replicate", "cx", "cy").agg(F.coalesce(F.min(F.when(F.col("n").isNotNull(), F.col("level"))), F.max("top") + 1).alias("level"))
    own = placed.join(finest, ["replicate", "cx", "cy"]).select("replicate", F.col("spot_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), "level", at("cx").alias("gx"), at("cy").alias("gy"))
    used = finest.select("replicate", "level").distinct()
    data = placed.join(small(used), "replicate").select("replicate", "level", F.col("spot_id").alias("dst"), "x", "y", at("cx").alias("gx"), at("cy").alias("gy"))
    dx, dy = F.col("ax") - F.col("x"), F.col("ay") - F.col("y")
    near = _around(own, 3).join(data, ["replicate", "level", "gx", "gy"]).where("src <> dst").select("replicate", "src", "dst", (dx * dx + dy * dy).alias("d2"))
    order = Window.partitionBy(*SRC).orderBy("d2", "dst")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("replicate", "src", "dst", F.sqrt("d2").alias("distance"), "rank")


def _around(rows: DataFrame, rings: int) -> DataFrame:
    """Every row once for each cell within ``rings`` of its own."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-rings, rings + 1) for j in range(-rings, rings + 1)])
    moved = rows.withColumn("step", F.explode(steps))
    return moved.withColumn("gx", F.col("gx") + F.col("step.i")).withColumn("gy", F.col("gy") + F.col("step.j")).drop("step")


def symmetric_edges(knn: DataFrame) -> DataFrame:
    """Both directions of every neighbour pair, once."""
    one = knn.select("replicate", "src", "dst", "distance")
    return one.union(one.select("replicate", F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("replicate", F.col("src").alias("spot_id")).agg(F.count(F.lit(1)).alias("degree"))


def radius_graph(spots: DataFrame, radius: float) -> DataFrame:
    """(replicate, src, dst, distance): all ordered pairs of spots of a replicate at most ``radius`` apart.

    A range join as an equi-join on grid cells of side ``radius``: a spot meets the 3 x 3 cells around its own.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    own = spots.select("replicate", F.col("spot_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("gx"), cell("y").alias("gy"))
    data = spots.select("replicate", F.col("spot_id").alias("dst"), "x", "y", cell("x").alias("gx"), cell("y").alias("gy"))
    dx, dy = F.col("ax") - F.col("x"), F.col("ay") - F.col("y")
    near = _around(own, 1).join(data, ["replicate", "gx", "gy"]).where("src <> dst").select("replicate", "src", "dst", F.sqrt(dx * dx + dy * dy).alias("distance"))
    return near.where(F.col("distance") <= radius)


def prune_long_edges(edges: DataFrame, share: float = 0.945) -> DataFrame:
    """Edges strictly shorter than the replicate's ``share`` percentile of edge lengths."""
    cut = exact_percentile(edges, ["replicate"], "distance", share, "cut")
    return edges.join(small(cut), "replicate").where(F.col("distance") < F.col("cut")).drop("cut")


def clip_mask(rows: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """``rows`` with ``inside``: whether the value lies between the group's exact ``low`` and ``high`` percentiles."""
    a, b = exact_percentile(rows, keys, value, low, "__low"), exact_percentile(rows, keys, value, high, "__high")
    return rows.join(small(a), keys).join(small(b), keys).withColumn("inside", F.col(value).between(F.col("__low"), F.col("__high"))).drop("__low", "__high")


def drop_disconnected(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """Spots with at least one edge."""
    return spots.join(edges.select("replicate", F.col("src").alias("spot_id")).distinct(), ["replicate", "spot_id"], "left_semi")


def neighbour_sum(edges: DataFrame, loadings: DataFrame) -> DataFrame:
    """(replicate, spot_id, k, v): sum of the loadings of a spot's neighbours (adjacency times loadings)."""
    right = loadings.select("replicate", F.col("spot_id").alias("dst"), "k", "v")
    return edges.select(*SRC, "dst").join(right, DST).groupBy("replicate", F.col("src").alias("spot_id"), "k").agg(F.sum("v").alias("v"))


def smooth_loadings(edges: DataFrame, loadings: DataFrame) -> DataFrame:
    """(replicate, spot_id, k, v): mean over a spot and its neighbours."""
    own = loadings.select("replicate", F.col("spot_id").alias("src"), F.col("spot_id").alias("dst")).distinct()
    right = loadings.select("replicate", F.col("spot_id").alias("dst"), "k", "v")
    return edges.select(*SRC, "dst").union(own).join(right, DST).groupBy("replicate", F.col("src").alias("spot_id"), "k").agg(F.avg("v").alias("v"))


def smooth_labels(spots: DataFrame, edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(replicate, spot_id, label, smoothed): the most frequent neighbour label (ties: smallest), if the spot and its
    neighbours hold it with a share of at least ``threshold``; else the spot's own label."""
    names = spots.select("replicate", F.col("spot_id").alias("dst"), F.col("label").alias("near"))
    counted = edges.select(*SRC, "dst").join(names, DST).groupBy("replicate", F.col("src").alias("spot_id"), "near").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("replicate", "spot_id").agg(F.min_by("near", F.struct(-F.col("n"), F.col("near"))).alias("major"), F.max("n").alias("n"), F.sum("n").alias("degree"))
    votes = (F.col("n") + F.when(F.col("major") == F.col("label"), 1).otherwise(0)) / (F.col("degree") + 1)
    return spots.join(best, ["replicate", "spot_id"], "left").select("replicate", "spot_id", "label", F.when(votes >= threshold, F.col("major")).otherwise(F.col("label")).alias("smoothed"))


def neighbourhood_enrichment(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """(replicate, a, b, enrichment): over connected spots of label a, the mean share of label b among neighbours."""
    own = spots.select("replicate", F.col("spot_id").alias("src"), F.col("label").alias("a"))
    near = spots.select("replicate", F.col("spot_id").alias("dst"), F.col("label").alias("b"))
    pair = edges.select(*SRC, "dst").join(near, DST).groupBy(*SRC, "b").agg(F.count(F.lit(1)).alias("n"))
    # one row per spot: its neighbours' labels with their numbers
    of_spot = pair.groupBy(*SRC).agg(F.sum("n").alias("degree"), F.collect_list(F.struct("b", "n")).alias("near")).join(own, SRC)
    shares = of_spot.select("replicate", "a", F.explode(F.concat(F.transform("near", lambda e: F.struct(e["b"].alias("b"), (e["n"] / F.col("degree")).alias("share"))), F.array(F.struct(F.col("a").alias("b"), F.lit(0.0).alias("share"))))).alias("e"))
    total = shares.groupBy("replicate", "a", "e.b").agg(F.sum("e.share").alias("total"))
    size = small(of_spot.groupBy("replicate", "a").agg(F.count(F.lit(1)).alias("size")))
    grid = size.select("replicate", "a", "size").join(size.select("replicate", F.col("a").alias("b")), "replicate")  # labels by labels
    return grid.join(total, ["replicate", "a", "b"], "left").select("replicate", "a", "b", (F.coalesce("total", F.lit(0.0)) / F.col("size")).alias("enrichment"))


def edge_arrays(edges: DataFrame, loadings: DataFrame, factors: int | None = None) -> DataFrame:
    """(replicate, src, dst, za, zb): the loadings of both ends, one row an edge."""
    k = factors or loadings.agg(F.max("k")).first()[0] or 1
    z = packed(loadings, k)
    left = z.select("replicate", F.col("spot_id").alias("src"), F.col("z").alias("za"))
    right = z.select("replicate", F.col("spot_id").alias("dst"), F.col("z").alias("zb"))
    return edges.select("replicate", "src", "dst").join(left, SRC).join(right, DST).select("replicate", "src", "dst", "za", "zb")


def edge_pairs(edges: DataFrame, loadings: DataFrame) -> DataFrame:
    """(replicate, src, dst, i, j, a, b): products' factors for every edge and factor pair, unfolded after the joins."""
    one = edge_arrays(edges, loadings).select("replicate", "src", "dst", F.posexplode("za").alias("i", "a"), "zb")
    out = one.select("replicate", "src", "dst", (F.col("i") + 1).alias("i"), "a", F.posexplode("zb").alias("j", "b"))
    return out.withColumn("j", F.col("j") + 1)


def empirical_correlation(edges: DataFrame, loadings: DataFrame, scaling: float = 10.0) -> DataFrame:
    """(replicate, i, j, value): negated correlation of neighbouring loadings, symmetrised, centred, scaled."""
    corr = edge_pairs(edges, loadings).groupBy("replicate", "i", "j").agg(F.coalesce(F.nanvl(-F.corr("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("c"))
    return _centred(corr, scaling)


def initial_affinity(edges: DataFrame, loadings: DataFrame, scaling: float = 10.0) -> DataFrame:
    """Like ``empirical_correlation`` with sample standard deviations under the population covariance."""
    ratio = -F.covar_pop("a", "b") / (F.stddev_samp("a") * F.stddev_samp("b"))
    corr = edge_pairs(edges, loadings).groupBy("replicate", "i", "j").agg(F.coalesce(F.nanvl(ratio, F.lit(0.0)), F.lit(0.0)).alias("c"))
    return _centred(corr, scaling)


def _centred(corr: DataFrame, scaling: float) -> DataFrame:
    turned = corr.select("replicate", F.col("j").alias("i"), F.col("i").alias("j"), F.col("c").alias("d"))
    both = corr.join(turned, ["replicate", "i", "j"]).withColumn("s", (F.col("c") + F.col("d")) / 2)
    whole = Window.partitionBy("replicate")
    return both.select("replicate", "i", "j", ((F.col("s") - F.avg("s").over(whole)) * scaling).alias("value"))


def affinity_linear_term(edges: DataFrame, loadings: DataFrame) -> DataFrame:
    """(replicate, i, j, value): sum over edges of the products of loadings (Z' A Z)."""
    return edge_pairs(edges, loadings).groupBy("replicate", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def neighbour_interactions(edges: DataFrame, loadings: DataFrame) -> DataFrame:
    """(replicate, src, dst, i, j, value): 1 - z_i z_j for every edge and i <= j."""
    return edge_pairs(edges, loadings).where("i <= j").select("replicate", "src", "dst", "i", "j", (1 - F.col("a") * F.col("b")).alias("value"))


def _names(spots: DataFrame, side: str, out: str) -> DataFrame:
    return spots.select("replicate", F.col("spot_id").alias(side), F.col("label").alias(out))


def edge_interaction(edges: DataFrame, loadings: DataFrame, affinity: DataFrame, factors: int | None = None) -> DataFrame:
    """(replicate, src, dst, w): -z_src . affinity . z_dst for every edge; ``affinity`` (replicate, i, j, value) is a small table."""
    k = factors or loadings.agg(F.max("k")).first()[0] or 1
    rows = packed(affinity, k, ("replicate", "i"), "j", "value", "row")
    matrix = rows.groupBy("replicate").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda r: r["row"]).alias("s"))
    pairs = edge_arrays(edges, loadings, k).join(small(matrix), "replicate")
    w = F.aggregate(F.zip_with("za", F.transform("s", lambda r: dot(r, F.col("zb"))), lambda x, y: x * y), F.lit(0.0), lambda t, x: t - x)
    return pairs.select("replicate", "src", "dst", w.alias("w"))


def category_interaction(spots: DataFrame, edges: DataFrame, loadings: DataFrame, affinity: DataFrame) -> DataFrame:
    """(replicate, a, b, value): mean over edges between labels of -z_src . affinity . z_dst."""
    pairs = edge_interaction(edges, loadings, affinity)
    named = pairs.join(_names(spots, "src", "a"), SRC).join(_names(spots, "dst", "b"), DST)
    return named.groupBy("replicate", "a", "b").agg((F.sum("w") / (F.count(F.lit(1)) + 1e-6)).alias("value"))


def top_category_pairs(interaction: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` pairs of labels per replicate by value, ties by name."""
    by = Window.partitionBy("replicate").orderBy(F.desc(F.round("value", 9)), "a", "b")
    return interaction.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def pair_score(spots: DataFrame, edges: DataFrame, loadings: DataFrame, affinity: DataFrame, a, b) -> DataFrame:
    """(replicate, spot_id, score): for spots of label ``a``, the summed interactions with neighbours of label ``b`` over
    their number (none: over 1); spots with a zero score are left out."""
    named = edges.join(_names(spots, "src", "a"), SRC).join(_names(spots, "dst", "b"), DST).where((F.col("a") == F.lit(a)) & (F.col("b") == F.lit(b)))
    scored = edge_interaction(named.select("replicate", "src", "dst"), loadings, affinity).groupBy("replicate", F.col("src").alias("spot_id")).agg((F.sum("w") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("score"))
    return scored.where("score <> 0")


def modularity(spots: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(replicate, modularity) of the label partition, every edge being stored in both directions."""
    named = edges.select(*SRC, "dst").join(_names(spots, "src", "a"), SRC).join(_names(spots, "dst", "b"), DST)
    by = named.groupBy("replicate", "a").agg(F.count(F.lit(1)).alias("deg"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    m2 = F.sum("deg").over(Window.partitionBy("replicate"))
    terms = by.withColumn("q", F.col("inside") / m2 - resolution * (F.col("deg") / m2) * (F.col("deg") / m2))
    return terms.groupBy("replicate").agg(F.sum("q").alias("modularity"))


def nearest_landmark(spots: DataFrame, landmarks: Sequence[tuple[str, float, float]]) -> DataFrame:
    """(replicate, spot_id, landmark, distance): the nearest of the landmarks (name, x, y), ties by smaller name.

    Landmarks are a drawn list, so they are part of the expression and no join is needed."""
    d2 = lambda x, y: (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    best = F.array_min(F.array(*[F.struct(d2(x, y).alias("d2"), F.lit(name).alias("landmark")) for name, x, y in landmarks]))
    return spots.select("replicate", "spot_id", best.alias("best")).select("replicate", "spot_id", F.col("best.landmark").alias("landmark"), F.sqrt("best.d2").alias("distance"))


def object_distance(spots: DataFrame, objects: Sequence[tuple[float, float, float]]) -> DataFrame:
    """(replicate, spot_id, distance): least absolute distance to the rim of a round object (x, y, radius)."""
    rim = lambda x, y, r: F.abs(F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)) - r)
    return spots.select("replicate", "spot_id", F.array_min(F.array(*[rim(*o) for o in objects])).alias("distance"))


def profile_around(distances: DataFrame, loadings: DataFrame, n: int) -> DataFrame:
    """(replicate, k, n, mean, distance): mean loadings of the ``n`` spots nearest to an object, and how far they reach.

    The n-th distance comes from ranked partial lists, never from a sort of a replicate in one task."""
    part = F.pmod(F.xxhash64("spot_id"), F.lit(256))
    inner = Window.partitionBy("replicate", "part").orderBy("distance", "spot_id")
    some = distances.withColumn("part", part).withColumn("r", F.row_number().over(inner)).where(F.col("r") <= n)
    whole = Window.partitionBy("replicate").orderBy("distance", "spot_id")  # n rows a part
    near = some.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= n).select("replicate", "spot_id", "distance")
    return loadings.join(near, ["replicate", "spot_id"]).groupBy("replicate", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.max("distance").alias("distance"))


def grid_bins(spots: DataFrame, side: int = 8) -> DataFrame:
    """(replicate, spot_id, bin_id, bx, by): half-open grid bins over each replicate's box, ``side`` to an axis."""
    box = spots.groupBy("replicate").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    place = lambda c: F.least(F.lit(side - 1), F.greatest(F.lit(0), (F.ceil((F.col(c) - F.col(c + "0")) / ((F.col(c + "1") - F.col(c + "0")) / side)) - 1).cast("int")))
    out = spots.join(small(box), "replicate").withColumn("bx", place("x")).withColumn("by", place("y"))
    return out.select("replicate", "spot_id", (F.col("bx") * side + F.col("by")).cast("int").alias("bin_id"), "bx", "by")


def bin_coordinates(spots: DataFrame, bins: DataFrame) -> DataFrame:
    """(replicate, bin_id, x, y, n): mean position of each bin's spots."""
    return spots.join(bins.select("replicate", "spot_id", "bin_id"), ["replicate", "spot_id"]).groupBy("replicate", "bin_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


def bin_values(values: DataFrame, bins: DataFrame, feature: str) -> DataFrame:
    """(replicate, bin_id, feature, value): member values summed per bin."""
    return values.join(bins.select("replicate", "spot_id", "bin_id"), ["replicate", "spot_id"]).groupBy("replicate", "bin_id", feature).agg(F.sum("value").alias("value"))


def propagate_labels(bins: DataFrame, coarse: DataFrame) -> DataFrame:
    """(replicate, spot_id, label): every spot takes its bin's label."""
    return bins.join(coarse, ["replicate", "bin_id"]).select("replicate", "spot_id", "label")


def majority(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The most frequent value per key, ties by smaller value."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(out))
