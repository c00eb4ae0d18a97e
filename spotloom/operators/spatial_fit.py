"""Loadings that depend on their neighbours: graph colouring, the spatial update, and finer loadings below bins."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.functions.scratch import discard, materialize, scratch_dir
from spotloom.operators.factors import FLOOR, project_simplex, spot_products


def colour_graph(edges: DataFrame, seed: int = 0, max_rounds: int = 200) -> DataFrame:
    """(replicate, spot_id, colour): no edge joins equal colours.

    Rounds of independent sets: in each, the uncoloured spots whose hash is smallest among uncoloured neighbours get the
    round's number.  A few rounds beyond the maximum degree's logarithm suffice, whatever the number of spots.
    """
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(seed)), F.col(c))
    at = lambda side: [F.col("replicate"), F.col("spot_id").alias(side)]
    left = materialize(edges.where("src <> dst").select("replicate", "src", "dst").distinct(), "colour-edges")
    done = None
    for colour in range(max_rounds):
        low = left.groupBy("replicate", "src").agg(F.min(rank("dst")).alias("near"))
        chosen = low.where(rank("src") < F.col("near")).select("replicate", F.col("src").alias("spot_id"), F.lit(colour).alias("colour"))
        chosen = materialize(chosen, "colour")
        done = chosen if done is None else done.union(chosen)
        rest = left.join(chosen.select(*at("src")), ["replicate", "src"], "left_anti")
        kept = materialize(rest.join(chosen.select(*at("dst")), ["replicate", "dst"], "left_anti"), "colour-edges")
        # spots whose neighbours are all coloured now have no edge left; they come last, each colour being free for them
        alone = rest.select("replicate", "src").distinct().join(kept.select("replicate", "src").distinct(), ["replicate", "src"], "left_anti").select("replicate", F.col("src").alias("spot_id"), F.lit(colour + 1).alias("colour"))
        done = materialize(done.union(alone), "coloured")
        discard(left)
        left = kept
        if left.isEmpty():
            return done
    raise RuntimeError(f"not coloured after {max_rounds} rounds")


def _solve_simplex(c: np.ndarray, gram: np.ndarray, pull: np.ndarray, scale: np.ndarray, z: np.ndarray, epochs: int, tol: float) -> np.ndarray:
    """Rows on the simplex that minimise scale^2 z G z' / 2 - scale z c' + z . pull, by accelerated projected gradient."""
    step = 1 / (np.linalg.eigvalsh(gram)[-1] * scale[:, None] ** 2)
    y, t = z.copy(), 1.0
    for _ in range(epochs):
        new = project_simplex((y - step * (scale[:, None] ** 2 * (y @ gram) - scale[:, None] * c + pull)).T).T
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - z)
        change = np.abs(new - z).max(initial=0.0)
        z, t = new, t_new
        if change < tol:
            break
    return z


def spatial_loadings(spots: DataFrame, edges: DataFrame, weights: np.ndarray | Mapping[str, np.ndarray], affinity: np.ndarray | Mapping[str, np.ndarray], sigma: float | Mapping[str, float], rounds: int = 3, epochs: int = 100, tol: float = 0.0, colours: DataFrame | None = None) -> DataFrame:
    """(replicate, spot_id, s, z) after ``rounds`` sweeps over the colours of the graph; replicates in which a sweep moved no
    spot by ``tol`` are left alone from then on.

    ``spots`` holds g, y (sparse expression) and x (current loadings).  A spot minimises
    |y - s M z|^2 / (2 sigma^2) + z . affinity . (sum of its neighbours' z), s having a closed form for fixed z.  Weights,
    affinity and sigma are one for all or one a replicate; all replicates are solved together,
    and those of the same weights and affinity end together.  Spots of
    one colour are independent and solved together, from neighbour sums that one join makes.  Colours are tables of their own, so
    a step writes its own spots only, and reads the edges that begin at them.
    """
    of = lambda what, r: what[r] if isinstance(what, Mapping) else what
    kin = lambda r: (of(weights, r).tobytes(), of(affinity, r).tobytes())
    k = (next(iter(weights.values())) if isinstance(weights, Mapping) else weights).shape[1]
    key = ["replicate", "spot_id"]
    start = spots.select(*key, "g", "y", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("s"), "x")
    start = start.select(*key, "g", "y", "s", F.transform("x", lambda v: v / F.greatest(F.col("s"), F.lit(FLOOR))).alias("z"))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r, t in batch.groupby("replicate"):
                c, yy = spot_products(t["g"], t["y"], of(weights, r))
                yield t[["replicate", "spot_id", "colour", "s", "z"]].assign(c=list(c), yy=yy)

    static = "replicate string, spot_id long, colour int, s double, z array<double>, c array<double>, yy double"
    coloured = start.join(colour_graph(edges) if colours is None else colours, key, "left").na.fill(0, ["colour"])
    # expression enters only through its products with the weights, so a sweep moves a few numbers a spot
    fixed = materialize(coloured.mapInPandas(project, static), "spatial-spots")
    there = sorted(r.colour for r in fixed.select("colour").distinct().collect())  # some tens
    here = fixed.select("replicate", F.col("spot_id").alias("src"), F.col("colour").alias("at"))
    other = fixed.select("replicate", F.col("spot_id").alias("dst"), F.col("colour").alias("to"))
    linked = edges.select("replicate", "src", "dst").join(here, ["replicate", "src"]).join(other, ["replicate", "dst"])
    spark, path = edges.sparkSession, f"{scratch_dir(edges.sparkSession)}/spatial-edges-{uuid.uuid4().hex}"
    linked.write.partitionBy("at").parquet(path)
    linked = spark.read.schema("replicate string, src long, dst long, to int, at int").parquet(path)
    state = {c: fixed.where(F.col("colour") == c).select(*key, "s", "z", "c") for c in there}
    written: dict[int, DataFrame] = {}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r, t in batch.groupby("replicate"):
                sigma_r, m = of(sigma, r), of(weights, r)
                gram = m.T @ m / sigma_r**2
                c, z = np.array(t["c"].tolist()) / sigma_r**2, np.array(t["z"].tolist())
                pull = np.array([np.zeros(k) if v is None else v for v in t["nu"]]) @ of(affinity, r)
                for _ in range(5):
                    s = np.maximum((c * z).sum(axis=1) / np.maximum((z @ gram * z).sum(axis=1), 1e-12), 1e-5)
                    z = _solve_simplex(c, gram, pull, s, z, epochs, 1e-5)
                yield t[["replicate", "spot_id", "c"]].assign(s=s, z=list(z))

    def every(what: dict[int, DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.unionAll, [what[c].select(*key, "s", "z") for c in there])

    done: list[str] = []
    for turn in range(rounds):
        before, old = dict(state), dict(written)
        for colour in there:
            goes = ~F.col("replicate").isin(done) if done else F.lit(True)
            own = state[colour]
            near = linked.where((F.col("at") == colour) & goes).join(every(state).select("replicate", F.col("spot_id").alias("dst"), "z"), ["replicate", "dst"])
            nu = near.groupBy("replicate", F.col("src").alias("spot_id")).agg(F.array(*[F.sum(F.col("z")[i]) for i in range(k)]).alias("nu"))
            moved = own.where(goes).join(nu, key, "left").mapInPandas(solve, "replicate string, spot_id long, c array<double>, s double, z array<double>").select(*key, "s", "z", "c")
            state[colour] = written[colour] = materialize(moved.unionAll(own.where(~goes)) if done else moved, "spatial-state")
        if tol and turn < rounds - 1:
            was = every(before).select(*key, F.col("z").alias("was"))
            step = F.aggregate(F.zip_with("z", "was", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda t, x: t + x)
            far = every(state).join(was, key).groupBy("replicate").agg(F.max(step).alias("far")).collect()  # a row a replicate
            top = {kin(r.replicate): max((x.far or 0.0) for x in far if kin(x.replicate) == kin(r.replicate)) for r in far}
            done = sorted(r.replicate for r in far if top[kin(r.replicate)] < tol)
        for table in old.values():
            discard(table)
        if there and tol and turn < rounds - 1 and len(done) == len(far):
            break
    return every(state) if there else fixed.select(*key, "s", "z")


def _solve_bins(c: np.ndarray, xb: np.ndarray, there: np.ndarray, gram: np.ndarray, epochs: int) -> np.ndarray:
    """Loadings of several bins at once: ``c`` is bins x spots x factors, ``there`` marks the spots that a bin has, ``xb`` is bins x factors.

    Every bin takes the steps that it takes by itself and rests when it no longer moves."""
    n = there.sum(axis=1)
    here = there[:, :, None]
    x = np.where(here, xb[:, None, :] / n[:, None, None], 0.0)
    step = (1 / (np.linalg.eigvalsh(gram)[-1] + n))[:, None, None]
    out, at, y, m = x.copy(), np.arange(len(c)), x.copy(), 1.0
    for _ in range(epochs):
        new = np.where(here, np.maximum(y - step * (y @ gram - c + (y.sum(axis=1) - xb)[:, None, :]), FLOOR), 0.0)
        m_new = (1 + np.sqrt(1 + 4 * m * m)) / 2
        y = new + (m - 1) / m_new * (new - x)
        moves = np.abs(new - x).max(axis=(1, 2)) >= 1e-8 * np.maximum(1.0, xb.max(axis=1))
        x, m = new, m_new
        if not moves.all():
            out[at[~moves]] = x[~moves]
            at, x, y, c, xb, here, step = (v[moves] for v in (at, x, y, c, xb, here, step))
            if not len(at):
                break
    out[at] = x
    return out


def superresolve(cells: DataFrame, weights: np.ndarray, sigma: float, epochs: int = 10_000, at_once: int = 256) -> DataFrame:
    """(replicate, bin_id, spot_id, x): loadings below bins whose sum is drawn to the bin's loadings.

    ``cells`` holds replicate, bin_id, spot_id, g, y and xb (the bin's loadings).  The problem
    |Y - X M'|^2 / (2 sigma^2) + |xb - sum of X|^2 / 2 separates by bin, so bins are solved apart, until nothing moves, in arrays of up to
    ``at_once`` bins of about equal size.  A task holds one batch of rows and one bin: ``partition_bins`` halves a replicate until its bins hold a
    bounded number of spots.
    """
    gram = weights.T @ weights / sigma**2

    def solved(t: pd.DataFrame) -> pd.DataFrame:
        c = spot_products(t["g"], t["y"], weights)[0] / sigma**2
        starts = np.flatnonzero(_new_bin(t))
        sizes, xb = np.diff(np.append(starts, len(t))), np.array(t["xb"].iloc[starts].tolist())
        x, order = np.zeros(c.shape), np.argsort(sizes, kind="stable")
        for some in (order[i : i + at_once] for i in range(0, len(order), at_once)):
            there = np.arange(sizes[some].max()) < sizes[some][:, None]
            rows = np.where(there, starts[some][:, None] + np.arange(there.shape[1]), 0)
            x[rows[there]] = _solve_bins(np.where(there[:, :, None], c[rows], 0.0), xb[some], there, gram, epochs)[there]
        return t[["replicate", "bin_id", "spot_id"]].assign(x=list(x))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for t in batches:
            held = t if held is None else pd.concat([held, t], ignore_index=True)
            last = int(np.flatnonzero(_new_bin(held))[-1]) if len(held) else 0  # the last bin may go on in the next batch
            if last:
                yield solved(held.iloc[:last])
                held = held.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield solved(held)

    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # much work for few bytes: a number of tasks that is not merged
    rows = cells.repartition(tasks, "replicate", "bin_id").sortWithinPartitions("replicate", "bin_id")
    return rows.mapInPandas(solve, f"replicate string, bin_id {cells.schema['bin_id'].dataType.simpleString()}, spot_id long, x array<double>")


def _new_bin(t: pd.DataFrame) -> np.ndarray:
    """Which rows, sorted by replicate and bin, begin a bin."""
    names, bins = t["replicate"].to_numpy(), t["bin_id"].to_numpy()
    return np.concatenate((np.ones(min(1, len(t)), bool), (names[1:] != names[:-1]) | (bins[1:] != bins[:-1])))
