"""Non-negative factor models of sparse expression: Y ~ X M', fitted by alternating block updates.

Y (spots by genes) and X (spots by factors) are distributed, one row per spot; M (genes by factors) is small and lives on
the driver.  A fit iteration is one pass over the spots: every task solves its spots' loadings for the current M, which is
sent along (genes x factors), and returns sums of X'X and Y'X, from which the driver updates M.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.functions.scratch import discard, materialize
from spotloom.functions.small import dot, packed, small

FLOOR = 1e-10


SPOT = ["replicate", "spot_id"]


def cross(expr: DataFrame, loadings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """([by], gene, k, value): Y'X over spots that have loadings, ``by`` being further columns of ``expr``."""
    by = by or []
    x = loadings.groupBy(*SPOT).agg(F.collect_list(F.struct("k", "v")).alias("x"))
    rows = expr.join(x, SPOT).select(*by, "gene", "value", F.explode("x").alias("e"))
    return rows.groupBy(*by, "gene", "e.k").agg(F.sum(F.col("value") * F.col("e.v")).alias("value"))


def simplex_columns(weights: DataFrame) -> DataFrame:
    """(gene, k, w): non-negative weights divided by their sum per factor."""
    total = weights.groupBy("k").agg(F.sum("value").alias("t"))
    return weights.join(small(total), "k").select("gene", "k", (F.col("value") / F.col("t")).alias("w"))


def residuals(expr: DataFrame, loadings: DataFrame, weights: DataFrame) -> DataFrame:
    """(replicate, n, loss, sigma): squared residual of Y - X M' over spots with loadings, without forming it, and its
    root mean over spots and genes."""
    k = loadings.agg(F.max("k")).first()[0] or 1
    x, w = packed(loadings, k, out="x"), packed(weights, k, ("gene",), v="w", out="m")
    own = expr.join(x, SPOT).join(small(w), "gene", "left")
    fit = F.coalesce(dot(F.col("x"), F.col("m")), F.lit(0.0))
    sums = own.groupBy("replicate").agg(F.sum(F.col("value") * F.col("value")).alias("yy"), F.sum(F.col("value") * fit).alias("yx"))
    mm = w.select(F.posexplode("m").alias("i", "a"), "m").select("i", "a", F.posexplode("m").alias("j", "b")).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("m"))
    spots = x.join(expr.select(*SPOT).distinct(), SPOT, "left_semi")
    xx = spots.select("replicate", F.posexplode("x").alias("i", "a"), "x").select("replicate", "i", "a", F.posexplode("x").alias("j", "b")).groupBy("replicate", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("x"), F.count(F.lit(1)).alias("n"))
    quad = xx.join(small(mm), ["i", "j"]).groupBy("replicate").agg(F.sum(F.col("x") * F.col("m")).alias("q"), F.max("n").alias("n"))
    genes = expr.agg(F.count_distinct("gene")).first()[0]
    out = sums.join(quad, "replicate").withColumn("loss", F.col("yy") - 2 * F.col("yx") + F.col("q"))
    return out.select("replicate", "n", "loss", F.sqrt(F.col("loss") / (F.col("n") * genes)).alias("sigma"))


def project_simplex(columns: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    """Euclidean projection of every column onto the simplex, entries not under ``floor``."""
    down = -np.sort(-columns, axis=0)
    total = np.cumsum(down, axis=0) - 1
    count = np.arange(1, len(columns) + 1)[:, None]
    last = np.count_nonzero(down > total / count, axis=0) - 1
    return np.maximum(columns - total[last, np.arange(columns.shape[1])] / (last + 1), floor)


def solve_loadings(cross_rows: np.ndarray, gram: np.ndarray, start: np.ndarray, epochs: int = 1000, tol: float = 1e-6) -> np.ndarray:
    """Rows x >= floor that minimise x G x' / 2 - x c', by accelerated projected gradient with restarts."""
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    x, y, t = start.copy(), start.copy(), 1.0
    for _ in range(epochs):
        new = np.maximum(y - step * (y @ gram - cross_rows), FLOOR)
        again = float(np.sum((y - new) * (new - x))) > 0
        t_new = 1.0 if again else (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new if again else new + (t - 1) / t_new * (new - x)
        change = np.max(np.abs(new - x).sum(axis=1) / np.maximum(new.sum(axis=1), FLOOR), initial=0.0)
        x, t = new, t_new
        if change < tol:
            break
    return x


def solve_weights(xx: np.ndarray, yx: np.ndarray, start: np.ndarray, pull: float = 0.0, centre: np.ndarray | None = None, epochs: int = 10_000) -> np.ndarray:
    """Columns on the simplex that minimise |Y - X M'|^2 / 2 + pull / 2 |M - centre|^2, from X'X and Y'X."""
    quad = xx + pull * np.eye(len(xx))
    lin = yx + (pull * centre if centre is not None else 0.0)
    step, tol = 1 / np.linalg.eigvalsh(quad)[-1], 1e-3 / len(yx)
    m, y, t = start.copy(), start.copy(), 1.0
    for epoch in range(epochs):
        new = project_simplex(y - step * (y @ quad - lin))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - m)
        change = np.abs(new - m).max()
        m, t = new, t_new
        if epoch > 5 and change < tol:
            break
    return m


@dataclass
class FactorModel:
    """Fitted weights (genes by factors), the table of loadings, and the loss after each iteration."""

    genes: list[str]
    weights: np.ndarray
    loadings: DataFrame
    sigma: dict[str, float]
    losses: list[float] = field(default_factory=list)


def packed_spots(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """One row per spot: its gene numbers and values (at most one entry per gene)."""
    cells = expr.join(genes, "gene").groupBy("replicate", "spot_id").agg(F.sort_array(F.collect_list(F.struct("g", "value"))).alias("c"))
    return cells.select(F.col("replicate").cast("string").alias("replicate"), "spot_id", F.col("c.g").alias("g"), F.col("c.value").cast("array<double>").alias("y"))


def flat_cells(g, y) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gene numbers, values and row numbers of all cells of a batch of sparse rows."""
    sizes = np.array([len(v) for v in g], np.int64)
    cols = np.concatenate([np.zeros(0, np.int64), *(np.asarray(v, np.int64) for v in g)])
    vals = np.concatenate([np.zeros(0), *(np.asarray(v, float) for v in y)])
    return cols, vals, np.repeat(np.arange(len(sizes)), sizes)


def spot_products(g, y, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Y M, sums of squares) of a batch of sparse rows (gene numbers, values), all rows at once."""
    cols, vals, owner = flat_cells(g, y)
    return summed(owner, vals, cols, weights, len(g)), np.bincount(owner, weights=vals * vals, minlength=len(g))


def summed(to: np.ndarray, vals: np.ndarray, of: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """n x columns: sums, by ``to``, of the values times the rows ``of`` the table; a column at a time, laid out in one piece."""
    return np.stack([np.bincount(to, weights=vals * column[of], minlength=n) for column in np.ascontiguousarray(table.T)], axis=1)


class _Sums:
    """X'X, Y'X, the sum of squares of Y and the number of spots per replicate, added up batch by batch."""

    def __init__(self, n_genes: int, k: int):
        self.n_genes, self.k, self.total = n_genes, k, {}

    def add(self, rep: str, g, y, x: np.ndarray) -> None:
        cols, vals, owner = flat_cells(g, y)
        s = self.total.setdefault(rep, [np.zeros((self.k, self.k)), np.zeros((self.n_genes, self.k)), 0.0, 0])
        s[0] += x.T @ x
        for i in range(self.k):
            s[1][:, i] += np.bincount(cols, weights=vals * x[owner, i], minlength=self.n_genes)
        s[2] += float((vals * vals).sum())
        s[3] += len(x)

    def rows(self) -> Iterator[pd.DataFrame]:
        for rep, (xx, yx, yy, n) in self.total.items():
            yield pd.DataFrame({"replicate": [rep], "spot_id": pd.array([None], dtype="Int64"), "x": [None], "sums": [np.concatenate((xx.ravel(), yx.ravel(), [yy, n])).tolist()]})


_PASS = "replicate string, spot_id long, x array<double>, sums array<double>"


def loadings_pass(spots: DataFrame, weights: dict[str, np.ndarray], with_loadings: bool) -> DataFrame:
    """(replicate, spot_id, x, sums): loadings of every spot for its replicate's weights; and, in rows without a spot,
    each task's sums for the next weights.

    ``spots`` holds (replicate, spot_id, g, y) and the former loadings x."""
    n_genes, k = next(iter(weights.values())).shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = _Sums(n_genes, k)
        for batch in batches:
            for rep, t in batch.groupby("replicate"):
                m = weights[rep]
                c, _ = spot_products(t["g"], t["y"], m)
                start = np.array(t["x"].tolist()) if with_loadings else np.repeat(np.array([np.sum(y) / k for y in t["y"]])[:, None], k, axis=1)
                x = solve_loadings(c, m.T @ m, np.maximum(start, FLOOR))
                sums.add(rep, t["g"], t["y"], x)
                yield pd.DataFrame({"replicate": t["replicate"], "spot_id": t["spot_id"], "x": list(x), "sums": [None] * len(t)})
        yield from sums.rows()

    return spots.mapInPandas(run, _PASS)


def loading_sums(spots: DataFrame, n_genes: int, k: int) -> dict[str, dict]:
    """The sums of given loadings x, per replicate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = _Sums(n_genes, k)
        for batch in batches:
            for rep, t in batch.groupby("replicate"):
                sums.add(rep, t["g"], t["y"], np.array(t["x"].tolist()))
        yield from sums.rows()

    return _sums(spots.select("replicate", "spot_id", "g", "y", "x").mapInPandas(run, _PASS), n_genes, k)


def _sums(found: DataFrame, n_genes: int, k: int) -> dict[str, dict]:
    """Per replicate: X'X, Y'X, the sum of squares of Y and the number of spots (factors x genes numbers each)."""
    flat = found.where("sums IS NOT NULL").select("replicate", F.posexplode("sums").alias("p", "v")).groupBy("replicate", "p").agg(F.sum("v").alias("v"))
    out: dict[str, dict] = {}
    for rep, rows in flat.toPandas().groupby("replicate"):
        v = rows.sort_values("p")["v"].to_numpy()
        out[rep] = {"xx": v[: k * k].reshape(k, k), "yx": v[k * k : -2].reshape(n_genes, k), "yy": v[-2], "n": v[-1]}
    return out


def _loss(s: dict, m: np.ndarray) -> float:
    return float(s["yy"] - 2 * np.sum(s["yx"] * m) + np.sum(s["xx"] * (m.T @ m)))


def fit_nmf(expr: DataFrame, factors: int, iterations: int = 50, seed: int = 0, tol: float = 1e-3, start: np.ndarray | None = None) -> FactorModel:
    """Alternate loadings and weights until the loss falls by less than ``tol`` of itself, ``iterations`` times at most.

    Replicates are weighted by their noise (sigma), re-estimated each iteration.  An iteration is one pass over the packed
    spots, which stay where they are; only the loadings are written anew."""
    genes = sorted(r.gene for r in expr.select("gene").distinct().collect())  # one short name per gene
    numbered = expr.sparkSession.createDataFrame(list(zip(genes, range(len(genes)), strict=True)), "gene string, g int")
    spots = materialize(packed_spots(expr, numbered), "factor-spots")
    names = sorted(r.replicate for r in spots.select("replicate").distinct().collect())
    rng = np.random.default_rng(seed)
    m = project_simplex(rng.gamma(1.0, 1.0, (len(genes), factors)) / len(genes)) if start is None else start
    sigma: dict[str, float] = {}
    losses: list[float] = []
    found = None
    for i in range(iterations):
        rows = spots.withColumn("x", F.lit(None).cast("array<double>")) if found is None else spots.join(found.where("spot_id IS NOT NULL").select(*SPOT, "x"), SPOT)
        after = materialize(loadings_pass(rows, dict.fromkeys(names, m), with_loadings=i > 0), "factor-loadings")
        if found is not None:
            discard(found)
        found = after
        sums = _sums(found, len(genes), factors)
        sigma = {r: float(np.sqrt(max(_loss(s, m), 1e-12) / (s["n"] * len(genes)))) for r, s in sums.items()}
        m = solve_weights(sum(s["xx"] / sigma[r] ** 2 for r, s in sums.items()), sum(s["yx"] / sigma[r] ** 2 for r, s in sums.items()), m)
        losses.append(sum(_loss(s, m) for s in sums.values()))
        if i and losses[-2] - losses[-1] < tol * losses[-2]:
            break
    loadings = found.where("spot_id IS NOT NULL").select(*SPOT, F.posexplode("x").alias("k", "v")).withColumn("k", F.col("k") + 1)
    return FactorModel(genes, m, loadings, sigma, losses)


def weights_table(model: FactorModel, spark) -> DataFrame:
    """(gene, k, weight) of a fitted model."""
    rows = [(g, k + 1, float(w)) for g, ws in zip(model.genes, model.weights, strict=True) for k, w in enumerate(ws)]
    return spark.createDataFrame(rows, "gene string, k int, weight double")
