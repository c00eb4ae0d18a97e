"""Nearest rows in many dimensions without meeting all rows: a random-projection forest, refined by neighbours of neighbours.

``evaluate.nearest_in_space`` is exact and quadratic in a replicate.  Here a row meets the rows of its leaf in a few trees and
then, in rounds, the neighbours of its neighbours, so the work is in proportion to the rows.  The result is approximate;
tests hold its recall against the exact neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.scratch import discard, materialize

_EDGES = "replicate string, src long, dst long, distance double"


def _descent(turn: np.ndarray, mids: list[dict], first: int, last: int):
    """Appends to batches of (replicate, spot_id, z and more): ``leaf``, the leaves of trees ``first`` to ``last``, and ``p``, their places on the next direction.

    ``mids`` holds per level the cut of every part that has one, by (replicate, tree, leaf).  Rows at a cut, such as many equal ones,
    are dealt to both sides by their ids."""
    width, _, levels = turn.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = b.column("z").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            p = np.tensordot(z, turn[:, first:last], axes=1) if b.num_rows else np.zeros((0, last - first, levels))
            names, ids = np.array(b.column("replicate").to_pylist(), dtype=object), b.column("spot_id").to_numpy().astype(np.uint64)
            leaf = np.ones((b.num_rows, last - first), np.int64)
            for name in set(names):
                own = np.flatnonzero(names == name)
                for i in range(last - first):
                    for level, cuts in enumerate(mids):
                        parts, where = np.unique(leaf[own, i], return_inverse=True)
                        cut = np.array([cuts.get((name, first + i, int(v)), np.inf) for v in parts])[where]
                        at = p[own, i, level].astype(np.float32)
                        coin = ((ids[own] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * (first + i) * levels + 2 * level + 1) >> np.uint64(41)) & np.uint64(1) == 1
                        leaf[own, i] = 2 * leaf[own, i] + ((at > cut) | ((at == cut) & coin))
            out = {c: b.column(c) for c in b.schema.names}
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * (last - first)
            out["leaf"] = pa.ListArray.from_arrays(ends, leaf.ravel())
            out["p"] = pa.ListArray.from_arrays(ends, p[:, :, min(len(mids), levels - 1)].astype(np.float32).ravel())
            yield pa.RecordBatch.from_pydict(out)

    return run


def _forest(points: DataFrame, trees: int, leaf: int, seed: int) -> tuple[np.ndarray, list[dict]]:
    """(directions, cuts): what ``_descent`` needs to find the leaves, of at most about ``leaf`` rows, of ``trees`` trees.

    A level halves all larger parts of all trees at the median of a random projection (one sketch a part).  The driver holds a number a part,
    ``trees`` in ``leaf`` rows; no level writes a table."""
    top = points.groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("z")).alias("d")).agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
    most = max(top.n or 1, 1)
    levels = math.ceil(math.log2(most / leaf)) + 1 if most > leaf else 0  # one more for halves that are not quite even
    turn = np.random.default_rng(seed).normal(size=(top.d or 1, trees, max(levels, 1)))
    vector = f"replicate string, spot_id long, z {points.schema['z'].dataType.simpleString()}"
    mids: list[dict] = []
    for _ in range(levels):
        rows = points.mapInArrow(_descent(turn, mids, 0, trees), f"{vector}, leaf array<long>, p array<float>")
        each = rows.select("replicate", F.posexplode(F.arrays_zip("leaf", "p")).alias("tree", "e")).select("replicate", "tree", "e.leaf", "e.p")
        cuts = each.groupBy("replicate", "tree", "leaf").agg(F.percentile_approx("p", 0.5, 1000).alias("mid"), F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf)
        mids.append({(r.replicate, r.tree, r.leaf): np.float32(r.mid) for r in cuts.select("replicate", "tree", "leaf", "mid").collect()})
    return turn, mids


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest different neighbours of every row, ties by id; an edge is ``fresh`` if all its rows are."""
    more = [F.bool_and("fresh").alias("fresh")] if "fresh" in edges.columns else []
    once = edges.repartition("replicate", "src").groupBy("replicate", "src", "dst").agg(F.min("distance").alias("distance"), *more)
    order = Window.partitionBy("replicate", "src").orderBy(F.round("distance", 12), "dst")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_of_block(z: np.ndarray, start: int, end: int, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, distance): of rows ``start`` to ``end`` of ``z`` (about zero) the ``k`` nearest others no farther than ``limit``.

    Products rule out rows that cannot be near; distances are those of differences, ties go to the earlier row."""
    sizes = (z * z).sum(axis=1)
    d2 = sizes[start:end, None] + sizes[None] - 2 * (z[start:end] @ z.T)
    own = np.arange(end - start)
    d2[own, start + own] = np.inf
    bound = np.partition(d2, k - 1, axis=1)[:, k - 1] if k < len(z) else np.full(end - start, np.inf)
    row, other = np.nonzero(d2 <= (np.minimum(bound, limit[start:end] ** 2) + 1e-9 * (sizes[start:end] + sizes.max()))[:, None])
    apart = row + start != other
    row, other = row[apart], other[apart]
    distance = np.concatenate([np.zeros(0), *(np.sqrt(((z[start + row[i : i + 65536]] - z[other[i : i + 65536]]) ** 2).sum(axis=1)) for i in range(0, len(row), 65536))])
    by = np.lexsort((other, distance, row))
    row, other, distance = row[by], other[by], distance[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    good = (place < k) & (distance <= limit[start + row])
    return start + row[good], other[good], distance[good]


def _near_inside(k: int, block: int = 128):
    """From packed groups (replicate, p: spot_id, z, far): each row's ``k`` nearest of the group that are no farther than ``far``."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, names = batch.column("p"), batch.column("replicate").to_pylist()
            ends, members = np.cumsum(pc.list_value_length(p).to_numpy(zero_copy_only=False)), p.flatten()
            all_ids, far = (members.field(c).to_numpy(zero_copy_only=False) for c in ("spot_id", "far"))
            all_z = members.field("z").flatten().to_numpy(zero_copy_only=False).reshape(len(all_ids), -1) if len(all_ids) else np.zeros((0, 1))
            found, rep, start = [], [], 0
            for name, end in zip(names, ends, strict=True):
                order = start + np.argsort(all_ids[start:end])
                ids, z, limit = all_ids[order], all_z[order].astype(float), far[order]
                z -= z.mean(axis=0)
                for i in range(0, len(ids), block):
                    row, other, distance = _nearest_of_block(z, i, min(i + block, len(ids)), k, limit)
                    found.append((ids[row], ids[other], distance))
                    rep.append((name, len(row)))
                start = end
            if found:
                src, dst, distance = (np.concatenate(x) for x in zip(*found, strict=True))
                replicate = pa.array([n for n, _ in rep], pa.string()).take(pa.array(np.repeat(np.arange(len(rep)), [n for _, n in rep])))
                yield pa.RecordBatch.from_pydict({"replicate": replicate, "src": src, "dst": dst, "distance": distance})

    return near


def _packed(rows: DataFrame) -> DataFrame:
    """Rows with ``z`` as floats where that loses nothing in any of them, which halves what moves."""
    short = F.col("z").cast("array<float>")
    same = rows.agg(F.bool_and(short.cast("array<double>") == F.col("z")).alias("same")).first().same
    return rows.withColumn("z", short) if same else rows


#: Trees are met in these passes; a later pass hands on only edges that are nearer than those known.
_PASSES = (2, 6, 8, 16)


def nearest_about(rows: DataFrame, k: int, trees: int = 32, leaf: int | None = None, rounds: int = 12, settled: float = 0.002, seed: int = 42) -> DataFrame:
    """(replicate, src, dst, distance, rank): nearly the ``k`` nearest rows of each of ``rows`` (replicate, spot_id, z: array<double>).

    Distances are exact, some neighbours are farther than the true ones; a replicate of ``k`` rows or fewer gives all of them.
    A tree moves one vector a row and a round 2k + 1, so leaves are large (``leaf``, default 4096 rows, or 3k) and find most neighbours.
    A round brings every row that has a new edge together with its neighbours and the ``k`` nearest rows that have it as neighbour, and
    compares those 2k + 1 with each other; groups without a new edge were compared before.  Trees and rounds end when fewer than
    ``settled`` of the edges are new, rounds after ``rounds``.  Groups have these sizes whatever the table's size.
    While refining, k is larger by half (by ten at least) than asked for, which keeps ways open in many dimensions.
    """
    asked, k = k, k + max(10, k // 2)
    points = materialize(_packed(rows.select(F.col("replicate").cast("string").alias("replicate"), "spot_id", "z")), "near-points")
    endless = F.lit(float("inf"))
    member = F.collect_list(F.struct("spot_id", "z", "far")).alias("p")
    turn, mids = _forest(points, trees, leaf or max(4096, 3 * asked), seed)
    if not mids:  # all rows of a replicate are in one leaf
        trees = 1
    key = ["replicate", "src", "dst"]
    vector = f"replicate string, spot_id long, z {points.schema['z'].dataType.simpleString()}, far double"

    def known(now: DataFrame | None) -> DataFrame:
        """The points with the distance beyond which they need no edge; rows with fewer than k neighbours take any."""
        if now is None:
            return points.withColumn("far", endless)
        far = now.groupBy("replicate", F.col("src").alias("spot_id")).agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("far"))
        return points.join(far, ["replicate", "spot_id"], "left").withColumn("far", F.coalesce("far", endless))

    def merged(now: DataFrame | None, groups: DataFrame) -> tuple[DataFrame, float]:
        """The best of the known edges and those inside ``groups``, and the share of new ones."""
        found = groups.select("replicate", "p").mapInArrow(_near_inside(k), _EDGES).withColumn("fresh", F.lit(True))
        old = found if now is None else now.select(*key, "distance", F.lit(False).alias("fresh")).union(found)
        after = materialize(_best(old, k), "near-edges")
        total = after.agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("fresh")).first()
        if now is not None:
            discard(now)
        return after, total.fresh / max(total.n, 1)

    now, first, new = None, 0, 1.0
    for width in _PASSES:
        last = min(trees, first + width)
        if first == last or new <= settled:
            break
        dealt = known(now).mapInArrow(_descent(turn, mids, first, last), f"{vector}, leaf array<long>, p array<float>").select("replicate", "spot_id", "z", "far", F.posexplode("leaf").alias("tree", "leaf"))
        now, new = merged(now, dealt.groupBy("replicate", "tree", "leaf").agg(member))
        first = last
    if trees == 1:  # every pair was compared
        return now.where(F.col("rank") <= asked).drop("fresh")
    every = F.lit(True)  # no group of the first round was compared before
    for _ in range(rounds):
        if new <= settled:
            break
        back = Window.partitionBy("replicate", "dst").orderBy("distance", "src")
        reverse = now.withColumn("r", F.row_number().over(back)).where(F.col("r") <= k).select("replicate", F.col("dst").alias("v"), F.col("src").alias("spot_id"), "fresh")
        forward = now.select("replicate", F.col("src").alias("v"), F.col("dst").alias("spot_id"), "fresh")
        pairs = forward.union(reverse).groupBy("replicate", "v").agg(F.collect_set("spot_id").alias("ids"), F.bool_or("fresh").alias("fresh")).where(every)
        pairs = pairs.select("replicate", "v", F.explode(F.concat("ids", F.array("v"))).alias("spot_id"))
        every = F.col("fresh")
        now, new = merged(now, pairs.join(known(now), ["replicate", "spot_id"]).groupBy("replicate", "v").agg(member))
    return now.where(F.col("rank") <= asked).drop("fresh")
