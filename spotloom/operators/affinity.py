"""Spatial affinity: the partition function over the simplex, and the affinity matrix fitted to neighbouring loadings."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.scratch import discard, materialize
from spotloom.functions.small import packed, small
from spotloom.operators.graph import neighbourhood_enrichment


def log_partition(eta: np.ndarray) -> np.ndarray:
    """log of the integral of exp(-eta . z) over the simplex, for every row of ``eta``.

    With c = max(eta) and a = c - eta >= 0 the integral is exp(-c) times the sum over n of h_n(a) / (n + K - 1)!, h_n
    being the complete homogeneous symmetric polynomials.  All terms are non-negative, so nothing cancels however
    close the entries are.
    """
    top = eta.max(axis=1, keepdims=True)
    a = top - eta
    k = eta.shape[1]
    terms = int(2 * a.max(initial=0.0)) + 60
    # h[n] over the variables so far, each scaled by n! to stay in range together with the factorials below
    h = np.zeros((terms, len(eta)))
    h[0] = 1.0
    scale = np.maximum(a.max(axis=1), 1e-300)
    for j in range(k):
        b = a[:, j] / scale
        for n in range(1, terms):
            h[n] += b * h[n - 1]
    n = np.arange(terms)
    log_factorial = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, terms + k)))))
    logs = np.log(np.maximum(h, 1e-300)) + n[:, None] * np.log(scale) - log_factorial[n + k - 1][:, None]
    peak = logs.max(axis=0)
    return -top[:, 0] + peak + np.log(np.exp(logs - peak).sum(axis=0))


def mean_under(eta: np.ndarray) -> np.ndarray:
    """Mean of z under exp(-eta . z) on the simplex: minus the gradient of ``log_partition``."""
    base = log_partition(eta)
    return np.stack([np.exp(log_partition(np.concatenate((eta, eta[:, [m]]), axis=1)) - base) for m in range(eta.shape[1])], axis=1)


def fit_affinity(edges: DataFrame, loadings: DataFrame, factors: int, steps: int = 40, rate: float = 0.05, penalty: float = 1e-2, bound: float = 10.0, tol: float = 0.0, towards: np.ndarray | float = 0.0, start: np.ndarray | None = None) -> tuple[np.ndarray, list[float]]:
    """Symmetric matrix S that minimises <S, Z'AZ> + sum_i log_partition((AZ)_i S) + penalty/2 |S - towards|^2 over the spots;
    ends early when a step moves no entry by ``tol``."""
    return fit_affinities(edges, loadings, factors, {"all": None}, steps, rate, penalty, bound, tol, {"all": towards}, {"all": start})["all"]


def fit_affinities(edges: DataFrame, loadings: DataFrame, factors: int, groups: Mapping[str, Sequence[str] | None], steps: int = 40, rate: float = 0.05, penalty: float = 1e-2, bound: float = 10.0, tol: float = 0.0, towards: Mapping[str, np.ndarray | float] | None = None, start: Mapping[str, np.ndarray | None] | None = None) -> dict[str, tuple[np.ndarray, list[float]]]:
    """``fit_affinity`` for every one of ``groups`` (name to its replicates, None for all) by itself, in common passes; no
    replicate is in two.

    ``loadings`` (replicate, spot_id, k from 1, v) lie on the simplex.  The neighbour sums are joined and stored once; each Adam
    step is one pass for all groups that still move, whose tasks return a factors x factors gradient a group.
    """
    z = packed(loadings, factors)
    near = edges.select("replicate", "src", "dst").join(z.select("replicate", F.col("spot_id").alias("dst"), F.col("z").alias("zn")), ["replicate", "dst"])
    nu = near.groupBy("replicate", F.col("src").alias("spot_id")).agg(F.array(*[F.sum(F.col("zn")[i]) for i in range(factors)]).alias("nu"))
    table = materialize(nu.join(z, ["replicate", "spot_id"]).select("replicate", "nu", "z"), "affinity-rows")
    of = {r: g for g, members in groups.items() for r in members or []}
    whole = next((g for g, members in groups.items() if members is None), None)

    def sums(now: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[str, np.ndarray] = {}
            for t in batches:
                for g, own in t.groupby(t["replicate"].map(lambda r: of.get(r, whole)), sort=False):
                    if g in now:
                        s, v, z = now[g], np.array(own["nu"].tolist()), np.array(own["z"].tolist())
                        eta, linear = v @ s, v.T @ z
                        value = float(np.sum(linear * s) + log_partition(eta).sum())
                        grad = linear - v.T @ mean_under(eta)
                        total[g] = total.get(g, 0.0) + np.concatenate(([value, float(len(v))], grad.ravel()))
            yield pd.DataFrame({"g": list(total), "s": [v.tolist() for v in total.values()]})

        rows = table if whole is not None else table.where(F.col("replicate").isin([r for g in now for r in groups[g]]))
        flat = rows.mapInPandas(run, "g string, s array<double>").select("g", F.posexplode("s").alias("p", "v"))
        got = flat.groupBy("g", "p").agg(F.sum("v").alias("v")).toPandas()
        return {g: own.sort_values("p")["v"].to_numpy() for g, own in got.groupby("g")}

    to = {g: (towards or {}).get(g, 0.0) for g in groups}
    s = {g: np.zeros((factors, factors)) if (start or {}).get(g) is None else start[g].copy() for g in groups}
    m, v, losses, moving = dict.fromkeys(groups, 0.0), dict.fromkeys(groups, 0.0), {g: [] for g in groups}, list(groups)
    for i in range(1, steps + 1):
        found, still = sums({g: s[g] for g in moving}), []
        for g in moving:
            got = found.get(g, np.zeros(2 + factors * factors))
            n = max(got[1], 1)
            losses[g].append(got[0] / n + penalty / 2 * float(np.sum((s[g] - to[g]) ** 2)))
            grad = got[2:].reshape(factors, factors)
            grad = (grad + grad.T) / 2 / n + penalty * (s[g] - to[g])
            m[g], v[g] = 0.5 * m[g] + 0.5 * grad, 0.9 * v[g] + 0.1 * grad * grad
            new = np.clip(s[g] - rate * (m[g] / (1 - 0.5**i)) / (np.sqrt(v[g] / (1 - 0.9**i)) + 1e-8), -bound, bound)
            change, s[g] = np.abs(new - s[g]).max(), new
            if change >= tol:
                still.append(g)
        moving = still
        if not moving:
            break
    discard(table)
    return {g: (s[g], losses[g]) for g in groups}


def clamp(affinity: np.ndarray, bound: float) -> np.ndarray:
    """Entries cut to [-bound, bound]."""
    return np.clip(affinity, -bound, bound)


def rescale(affinity: np.ndarray, bound: float) -> np.ndarray:
    """The matrix scaled down so that no entry exceeds ``bound`` in size."""
    return affinity * min(1.0, bound / max(float(np.abs(affinity).max(initial=0.0)), 1e-300))


def centre(affinity: np.ndarray) -> np.ndarray:
    """The matrix less its mean entry."""
    return affinity - affinity.mean()


def adjust_affinity(affinity: DataFrame, bound: float) -> DataFrame:
    """(replicate, i, j, value, clamped, rescaled, centred) of small tables of affinities, one matrix per replicate."""
    w = Window.partitionBy("replicate")
    v = F.col("value")
    scaled = v * F.least(F.lit(1.0), bound / F.greatest(F.max(F.abs(v)).over(w), F.lit(1e-300)))
    return affinity.select("replicate", "i", "j", "value", F.greatest(F.lit(-bound), F.least(F.lit(bound), v)).alias("clamped"), scaled.alias("rescaled"), (v - F.avg(v).over(w)).alias("centred"))


def shuffles(trials: int, seed: int) -> list[tuple[int, int, int]]:
    """(trial, a, b) of the maps i -> (a i + b) mod n: distinct primes over 2^30, hence bijections for all n below."""
    out, p = [], (1 << 30) + 1 + 2 * ((seed * 7919) % 100_003)
    while len(out) < trials:
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            out.append((len(out), p, 104_729 * (len(out) + 1)))
        p += 2 * 1009
    return out


def numbered_spots(spots: DataFrame) -> DataFrame:
    """(replicate, spot_id, label, i, n): spots of a replicate numbered from 0 in the order of an MD5 of their id.

    Numbers come from the sizes of 4096 hash buckets and the ranks inside each, so no task sorts a replicate."""
    h = F.md5(F.col("spot_id").cast("string"))
    rows = spots.select("replicate", "spot_id", "label", h.alias("h"), F.substring(h, 1, 3).alias("bucket"))
    sizes = rows.groupBy("replicate", "bucket").agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy("replicate").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("replicate", "bucket", F.coalesce(F.sum("c").over(up), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("replicate")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("replicate", "bucket").orderBy("h", "spot_id")) - 1
    return rows.join(small(before), ["replicate", "bucket"]).select("replicate", "spot_id", "label", (F.col("before") + rank).alias("i"), "n")


def permutation_test(spots: DataFrame, edges: DataFrame, trials: int = 100, seed: int = 0) -> DataFrame:
    """(replicate, a, b, enrichment, p_adjacency, p_avoidance): labels shuffled within a replicate ``trials`` times.

    A shuffle gives spot number i the label of spot number (a i + b) mod n, spots being numbered in a random order once:
    no sort per trial.  Every edge is unfolded over the trials where it lies, labels are looked up by number, and sums per
    pair of labels are added before they move.  p-values count the shuffles that reach the observed value, plus one.
    """
    observed = neighbourhood_enrichment(spots, edges)
    rows = materialize(numbered_spots(spots), "numbered")
    at = lambda side, i: rows.select("replicate", F.col("spot_id").alias(side), F.col("i").alias(i))
    degree = edges.groupBy("replicate", "src").agg((1 / F.count(F.lit(1))).alias("w"))
    ends = edges.select("replicate", "src", "dst").join(degree, ["replicate", "src"]).join(at("src", "i"), ["replicate", "src"]).join(at("dst", "j"), ["replicate", "dst"])
    linked = materialize(ends.join(small(rows.groupBy("replicate").agg(F.max("n").alias("n"))), "replicate").select("replicate", "src", "i", "j", "w", "n"), "numbered-edges")
    every = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for t, a, b in shuffles(trials, seed)]))
    to = lambda c: ((F.col("e.a") * F.col(c) + F.col("e.b")) % F.col("n")).alias(c)
    label = small(rows.select("replicate", "i", "label"), 1_000_000)
    first, second = label.select("replicate", "i", F.col("label").alias("a")), label.select("replicate", F.col("i").alias("j"), F.col("label").alias("b"))
    moved = linked.withColumn("e", every).select("replicate", F.col("e.t").alias("trial"), to("i"), to("j"), "w")
    total = moved.join(first, ["replicate", "i"]).join(second, ["replicate", "j"]).groupBy("replicate", "trial", "a", "b").agg(F.sum("w").alias("total"))
    own = linked.select("replicate", "src", "i", "n").distinct().withColumn("e", every).select("replicate", F.col("e.t").alias("trial"), to("i"))
    size = own.join(first, ["replicate", "i"]).groupBy("replicate", "trial", "a").agg(F.count(F.lit(1)).alias("size"))
    grid = size.join(size.select("replicate", "trial", F.col("a").alias("b")), ["replicate", "trial"])  # labels by labels
    got = grid.join(total, ["replicate", "trial", "a", "b"], "left").select("replicate", "a", "b", (F.coalesce("total", F.lit(0.0)) / F.col("size")).alias("e"))
    # equal values that were added in different orders count as equal
    near = 1e-9
    both = got.join(small(observed), ["replicate", "a", "b"]).groupBy("replicate", "a", "b", "enrichment")
    return both.agg(((F.count_if(F.col("e") >= F.col("enrichment") - near) + 1) / (trials + 1)).alias("p_adjacency"), ((F.count_if(F.col("e") <= F.col("enrichment") + near) + 1) / (trials + 1)).alias("p_avoidance"))
