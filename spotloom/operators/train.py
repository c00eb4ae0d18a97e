"""The fit end to end: initialise, non-spatial iterations, spatial iterations with affinities, and the model's likelihood.

Spots stay distributed tables; what the driver holds is genes x factors weights and factors x factors affinities per
replicate.  A model is saved as Parquet tables and read back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.functions.scratch import materialize
from spotloom.functions.small import packed
from spotloom.operators import factors as fac
from spotloom.operators.affinity import fit_affinities, log_partition
from spotloom.operators.evaluate import nearest_in_space
from spotloom.operators.graph import symmetric_edges
from spotloom.operators.leiden import communities_near
from spotloom.operators.spatial_fit import colour_graph, spatial_loadings, superresolve
from spotloom.operators.trends import neighbour_groups

KEY = ["replicate", "spot_id"]


@dataclass(frozen=True)
class Plan:
    """Sizes and budgets of a fit; ``pull_weights`` and ``pull_affinity`` over 0 make parameters differ between replicates,
    drawn to the means of their groups.

    Groups map names to replicates; ``disjoint`` puts every replicate in a group of its own, and replicates that no group names
    form one more.  Without a pull a group's replicates share their parameters and groups must not overlap; with one a
    replicate may be in several, all of the same weight."""

    factors: int = 8
    start: str = "svd"  # or kmeans, leiden
    components: int = 50
    neighbours: int = 20
    retries: int = 3
    nmf_iterations: int = 20
    spatial_iterations: int = 5
    sweeps: int = 2
    affinity_steps: int = 30
    penalty: float = 1e-4
    pull_weights: float = 0.0
    pull_affinity: float = 0.0
    tol: float = 1e-4
    seed: int = 0
    weight_groups: Mapping[str, Sequence[str]] | str | None = None
    affinity_groups: Mapping[str, Sequence[str]] | str | None = None


def groups_of(names: Sequence[str], groups: Mapping[str, Sequence[str]] | str | None, apart: bool) -> dict[str, list[str]]:
    """Group name to replicates, every replicate of ``names`` in one group at least; ``apart`` forbids a second one."""
    if isinstance(groups, str):
        if groups != "disjoint":
            raise ValueError(f"unknown groups {groups}")
        return {r: [r] for r in names}
    out = {g: [r for r in names if r in set(members)] for g, members in (groups or {}).items()}
    unknown = sorted({r for members in (groups or {}).values() for r in members} - set(names))
    if unknown or not all(out.values()):
        raise ValueError(f"groups without replicates, or unknown ones: {unknown or [g for g, m in out.items() if not m]}")
    rest = [r for r in names if not any(r in m for m in out.values())]
    if rest:
        if "_default" in out:
            raise ValueError("the group name _default is kept for replicates without a group")
        out["_default"] = rest
    twice = sorted(r for r in names if sum(r in m for m in out.values()) > 1)
    if apart and twice:
        raise ValueError(f"replicates {twice} are in several groups, which cannot all share their parameters")
    return out


def group_means(now: Mapping[str, np.ndarray], groups: Mapping[str, Sequence[str]]) -> dict[str, list[np.ndarray]]:
    """Replicate to the means of all its groups."""
    bars = {g: sum(now[r] for r in members) / len(members) for g, members in groups.items()}
    return {r: [bars[g] for g, members in groups.items() if r in members] for r in now}


def bridge_groups(bridge: DataFrame, group: str = "group") -> dict[str, list[str]]:
    """A plan's groups from a many-to-many table of ``group`` and replicate, a row a member."""
    out: dict[str, list[str]] = {}
    for r in bridge.select(F.col(group).cast("string").alias("g"), F.col("replicate").cast("string").alias("r")).distinct().orderBy("g", "r").collect():
        out.setdefault(r.g, []).append(r.r)
    return out


def covariate_groups(covariate: DataFrame, width: int = 1) -> dict[str, list[str]]:
    """Sliding groups: for every value t of (replicate, t) with ``width`` values on both sides the replicates in that window."""
    rows = covariate.select(F.lit("all").alias("feature"), "replicate", "t")
    return bridge_groups(neighbour_groups(rows, width).join(rows, F.col("member") == F.col("t")), "centre")


@dataclass
class SpatialModel:
    genes: list[str]
    weights: dict[str, np.ndarray]
    affinity: dict[str, np.ndarray]
    sigma: dict[str, float]
    loadings: DataFrame  # replicate, spot_id, x
    losses: list[float] = field(default_factory=list)
    plan: Plan | None = None
    levels: dict[int, DataFrame] = field(default_factory=dict)  # what refine gives

    def save(self, folder: str) -> None:
        """Tables of loadings, weights, affinities, noise, the plan and all levels under ``folder`` (any store that Spark writes)."""
        spark = self.loadings.sparkSession
        self.loadings.write.parquet(f"{folder}/loadings")
        w = [(r, g, i, k + 1, float(v)) for r, m in self.weights.items() for i, (g, row) in enumerate(zip(self.genes, m, strict=True)) for k, v in enumerate(row)]
        spark.createDataFrame(w, "replicate string, gene string, g int, k int, w double").write.parquet(f"{folder}/weights")
        s = [(r, i + 1, j + 1, float(a[i, j])) for r, a in self.affinity.items() for i in range(len(a)) for j in range(len(a))]
        spark.createDataFrame(s, "replicate string, i int, j int, value double").write.parquet(f"{folder}/affinity")
        spark.createDataFrame([(r, v, i) for i, (r, v) in enumerate(self.sigma.items())], "replicate string, sigma double, place int").write.parquet(f"{folder}/noise")
        spark.createDataFrame(list(enumerate(map(float, self.losses))), "step int, loss double").write.parquet(f"{folder}/losses")
        for level, found in self.levels.items():
            found.select(*KEY, "x").write.parquet(f"{folder}/levels/{level}")
        about = {"plan": asdict(self.plan) if self.plan else None, "levels": sorted(self.levels)}
        spark.createDataFrame([(json.dumps(about),)], "about string").write.parquet(f"{folder}/about")

    @staticmethod
    def load(spark: SparkSession, folder: str, **changes) -> SpatialModel:
        """A saved model; ``changes`` replace settings of its plan.  A model saved without a plan takes the defaults for it."""
        read = lambda n: spark.read.parquet(f"{folder}/{n}")
        w, s = read("weights").toPandas(), read("affinity").toPandas()
        genes = w.drop_duplicates("g").sort_values("g")["gene"].tolist()
        weights = {r: t.pivot(index="g", columns="k", values="w").to_numpy() for r, t in w.groupby("replicate")}
        affinity = {r: t.pivot(index="i", columns="j", values="value").to_numpy() for r, t in s.groupby("replicate")}
        sigma = {r.replicate: r.sigma for r in read("noise").orderBy("place").collect()}
        losses = [r.loss for r in read("losses").orderBy("step").collect()]
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/about")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)  # not in models of older versions
        about = json.loads(read("about").first().about) if there else {"plan": None, "levels": []}
        plan = replace(Plan(**(about["plan"] or {"factors": len(next(iter(affinity.values())))})), **changes)
        return SpatialModel(genes, weights, affinity, sigma, read("loadings"), losses, plan, {i: read(f"levels/{i}") for i in about["levels"]})


def gene_gram(spots: DataFrame, right: np.ndarray, mean: np.ndarray | None = None, n: int = 0) -> np.ndarray:
    """Y'Y times a genes x few matrix, in one pass; tasks return genes x few sums.

    With the genes' ``mean`` over all ``n`` spots, Y stands for the centred matrix: its product differs by the outer product of
    the means, so sparse rows are never filled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(right.shape)
        for t in batches:
            if len(t):
                cols, vals, owner = fac.flat_cells(t["g"], t["y"])
                total += fac.summed(cols, vals, owner, fac.summed(owner, vals, cols, right, len(t)), len(total))
        yield pd.DataFrame({"row": np.arange(len(total)), "v": list(total)})

    parts = spots.select("g", "y").mapInPandas(run, "row int, v array<double>")
    sums = parts.groupBy("row").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(right.shape[1])]).alias("v")).toPandas()
    out = np.zeros(right.shape)
    if len(sums):
        out[sums["row"].to_numpy()] = np.array(sums["v"].tolist())
    return out if mean is None else out - n * np.outer(mean, mean @ right)


def right_vectors(spots: DataFrame, n_genes: int, n: int, seed: int = 0, passes: int = 6, mean: np.ndarray | None = None, n_spots: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The leading ``n`` right singular vectors and squared singular values of the spots x genes matrix (centred with
    ``mean``), by block power iteration."""
    n = min(n, n_genes)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_genes, min(n + 8, n_genes))))[0]
    for _ in range(passes):
        q = np.linalg.qr(gene_gram(spots, q, mean, n_spots))[0]
    small = q.T @ gene_gram(spots, q, mean, n_spots)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:n]
    return q @ vectors[:, order], np.maximum(values[order], 0.0)


def expression_components(spots: DataFrame, n_genes: int, n: int = 50, seed: int = 0, passes: int = 6) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((replicate, spot_id, z), genes x n weights, variances): principal components of sparse expression over all
    replicates of ``spots`` (packed: replicate, spot_id, g, y); signs are positive at the largest weight.

    Centring is implicit (``gene_gram``).  The driver holds genes x n numbers; a pass over the spots is a product."""
    sums = spots.select(F.explode(F.arrays_zip("g", "y")).alias("c")).groupBy("c.g").agg(F.sum("c.y").alias("s")).collect()  # a row a gene
    n_spots, mean = spots.count(), np.zeros(n_genes)
    for r in sums:
        mean[r.g] = r.s / max(1, n_spots)
    v, squares = right_vectors(spots, n_genes, n, seed, passes, mean, n_spots)
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    shift = mean @ v

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            if len(t):
                yield t[KEY].assign(z=list(fac.spot_products(t["g"], t["y"], v)[0] - shift))

    kind = spots.schema["spot_id"].dataType.simpleString()
    rows = spots.select(*KEY, "g", "y").mapInPandas(scores, f"replicate string, spot_id {kind}, z array<double>")
    return rows, v, squares / max(1, n_spots - 1)


def label_weights(spots: DataFrame, labels: DataFrame, n_genes: int, factors: int) -> np.ndarray:
    """Genes x factors: mean expression of the spots of each label (replicate, spot_id, label from 0)."""
    named = spots.select(*KEY, "g", "y").join(labels, KEY)
    cells = named.select("label", F.explode(F.arrays_zip("g", "y")).alias("c")).groupBy("label", "c.g").agg(F.sum("c.y").alias("s"))
    size = {r.label: r["count"] for r in named.groupBy("label").count().collect()}
    m = np.full((n_genes, factors), fac.FLOOR)
    for r in cells.collect():  # genes x factors
        m[r.g, r.label] = max(r.s / size[r.label], fac.FLOOR)
    return m


def leiden_labels(spots: DataFrame, n_genes: int, plan: Plan) -> DataFrame:
    """(replicate, spot_id, label from 0): ``plan.factors`` communities of the graph of nearest spots in ``plan.components``
    components, over all replicates.  Where the number is not met, the graph gets half as many neighbours again, up to
    ``plan.retries`` times.  Labels count by size."""
    scores, _, _ = expression_components(spots, n_genes, plan.components, plan.seed)
    rows = materialize(scores.withColumn("n", F.monotonically_increasing_id()), "start-scores")
    joint, near = rows.select(F.lit("all").alias("replicate"), F.col("n").alias("spot_id"), "z"), plan.neighbours
    for _ in range(plan.retries + 1):
        edges = materialize(symmetric_edges(nearest_in_space(joint, joint, near)), "start-edges")
        found, _, number = communities_near(edges, plan.factors)
        if number == plan.factors:
            break
        near = int(near * 1.5)
    else:
        raise ValueError(f"{number} communities instead of {plan.factors}, also with {near} neighbours: choose another start or number of factors")
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("spot_id").alias("first")).collect()  # a row a factor
    order = sorted(sizes, key=lambda r: (-r.size, r.first))
    names = spots.sparkSession.createDataFrame([(r.community, i) for i, r in enumerate(order)], "community long, label int")
    named = found.join(F.broadcast(names), "community").select(F.col("spot_id").alias("n"), "label")
    return materialize(rows.select(*KEY, "n").join(named, "n").drop("n"), "start-labels")


def initial_weights(spots: DataFrame, n_genes: int, plan: Plan) -> np.ndarray:
    """Weights on the simplex from singular vectors (signs by the larger mass), or from the mean expression of k-means clusters
    of the leading scores or of Leiden communities."""
    if plan.start == "svd":
        v, _ = right_vectors(spots, n_genes, plan.factors, plan.seed)
        v *= np.where(np.maximum(v, 0).sum(axis=0) >= np.maximum(-v, 0).sum(axis=0), 1.0, -1.0)
        m = np.maximum(v, fac.FLOOR)
    elif plan.start == "kmeans":
        v, _ = right_vectors(spots, n_genes, 20, plan.seed)

        def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in batches:
                if len(t):
                    yield t[["replicate", "spot_id", "g", "y"]].assign(f=list(fac.spot_products(t["g"], t["y"], v)[0]))

        rows = spots.select(*KEY, "g", "y").mapInPandas(scores, "replicate string, spot_id long, g array<int>, y array<double>, f array<double>")
        rows = materialize(rows.withColumn("features", array_to_vector("f")).drop("f"), "scores")
        named = KMeans(k=plan.factors, seed=plan.seed).fit(rows).transform(rows)
        m = label_weights(spots, named.select(*KEY, F.col("prediction").alias("label")), n_genes, plan.factors)
    elif plan.start == "leiden":
        m = label_weights(spots, leiden_labels(spots, n_genes, plan), n_genes, plan.factors)
    else:
        raise ValueError(f"unknown start {plan.start}")
    return m / m.sum(axis=0)


def _loss(sums: dict, m: np.ndarray) -> float:
    return fac._loss(sums, m)


def _weights(sums: dict[str, dict], sigma: dict[str, float], now: dict[str, np.ndarray], plan: Plan) -> dict[str, np.ndarray]:
    """Weights that a group's replicates share, or with a pull each one's own drawn to the means of its groups."""
    pull = plan.pull_weights
    groups = groups_of(sorted(now), plan.weight_groups, pull <= 0)
    if pull <= 0:
        out = {}
        for members in groups.values():
            xx, yx = (sum(sums[r][part] / sigma[r] ** 2 for r in members) for part in ("xx", "yx"))
            out |= dict.fromkeys(members, fac.solve_weights(xx, yx, now[members[0]]))
        return out
    bars = {r: np.mean([fac.project_simplex(b) for b in own], axis=0) for r, own in group_means(now, groups).items()}
    return {r: fac.solve_weights(s["xx"] / sigma[r] ** 2, s["yx"] / sigma[r] ** 2, now[r], pull, bars[r]) for r, s in sums.items()}


def _noise(sums: dict[str, dict], weights: dict[str, np.ndarray], n_genes: int) -> dict[str, float]:
    return {r: float(np.sqrt(max(_loss(s, weights[r]), 1e-12) / (s["n"] * n_genes))) for r, s in sums.items()}


def neighbour_terms(edges: DataFrame, loadings: DataFrame, affinity: dict[str, np.ndarray]) -> dict[str, tuple[float, float]]:
    """Per replicate: <S, Z'AZ> and the sum of log partitions over all spots, Z being loadings over their sums."""
    k = len(next(iter(affinity.values())))
    z = loadings.select(*KEY, F.transform("x", lambda v: v / F.aggregate("x", F.lit(0.0), lambda a, b: a + b)).alias("z"))
    near = edges.select("replicate", "src", "dst").join(z.select("replicate", F.col("spot_id").alias("dst"), F.col("z").alias("zn")), ["replicate", "dst"])
    nu = near.groupBy("replicate", F.col("src").alias("spot_id")).agg(F.array(*[F.sum(F.col("zn")[i]) for i in range(k)]).alias("nu"))
    rows = z.join(nu, KEY, "left").withColumn("nu", F.coalesce("nu", F.array(*[F.lit(0.0)] * k)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for r, own in t.groupby("replicate"):
                eta = np.array(own["nu"].tolist()) @ affinity[r]
                yield pd.DataFrame({"replicate": [r], "linear": [float((eta * np.array(own["z"].tolist())).sum())], "logs": [float(log_partition(eta).sum())]})

    got = rows.select("replicate", "z", "nu").mapInPandas(run, "replicate string, linear double, logs double").groupBy("replicate").agg(F.sum("linear").alias("linear"), F.sum("logs").alias("logs"))
    return {r.replicate: (r.linear, r.logs) for r in got.collect()}


def _spread(now: dict[str, np.ndarray], groups: dict[str, list[str]]) -> float:
    """Squared distances of the replicates' parameters to the means of their groups, each replicate's averaged."""
    return sum(float(np.mean([((now[r] - b) ** 2).sum() for b in bars])) for r, bars in group_means(now, groups).items())


def negative_log_likelihood(model: SpatialModel, sums: dict[str, dict], edges: DataFrame | None, plan: Plan) -> float:
    """Data term with its Gaussian constant; with ``edges`` also the neighbour term, the log partitions and the penalties."""
    n_genes, total = len(model.genes), 0.0
    cells = sum(s["n"] for s in sums.values())
    for r, s in sums.items():
        var = model.sigma[r] ** 2
        total += _loss(s, model.weights[r]) / (2 * var) + s["n"] * n_genes / 2 * np.log(2 * np.pi * var)
    if plan.pull_weights > 0:
        total += plan.pull_weights * _spread(model.weights, groups_of(sorted(model.weights), plan.weight_groups, False))
    if edges is not None:
        for r, (linear, logs) in neighbour_terms(edges, model.loadings, model.affinity).items():
            total += linear / 2 + logs + cells * plan.penalty / 2 * float((model.affinity[r] ** 2).sum())
        if plan.pull_affinity > 0:
            total += cells * plan.pull_affinity / 2 * _spread(model.affinity, groups_of(sorted(model.affinity), plan.affinity_groups, False))
    return float(total)


def fit(expr: DataFrame, edges: DataFrame, plan: Plan | None = None) -> SpatialModel:
    """Fit loadings, weights, noise and affinities of all replicates.

    ``expr`` (replicate: string, spot_id, gene, value) and ``edges`` (replicate, src, dst), both directions.  Losses are the
    data terms of the non-spatial iterations, then the likelihoods of the spatial ones; either part stops when its loss
    falls by less than ``tol`` of itself."""
    plan = plan or Plan()
    genes = sorted(r.gene for r in expr.select("gene").distinct().collect())  # one short name per gene
    spots, edges, names = _tables(expr, edges, genes)
    groups_of(names, plan.weight_groups, plan.pull_weights <= 0), groups_of(names, plan.affinity_groups, plan.pull_affinity <= 0)  # raise early
    start = initial_weights(spots, len(genes), plan)
    weights = dict.fromkeys(names, start)
    losses: list[float] = []
    x: DataFrame | None = None
    sums: dict[str, dict] = {}
    for i in range(plan.nmf_iterations):
        rows = spots.withColumn("x", F.lit(None).cast("array<double>")) if x is None else spots.join(x, KEY)
        found = materialize(fac.loadings_pass(rows, weights, with_loadings=x is not None), "train-loadings")
        x = found.where("spot_id IS NOT NULL").select(*KEY, "x")
        sums = fac._sums(found, len(genes), plan.factors)
        sigma = _noise(sums, weights, len(genes))
        weights = _weights(sums, sigma, weights, plan)
        losses.append(sum(_loss(s, weights[r]) for r, s in sums.items()))
        if i and losses[-2] - losses[-1] < plan.tol * abs(losses[-2]):
            break
    sigma = _noise(sums, weights, len(genes))
    model = SpatialModel(genes, weights, {r: np.zeros((plan.factors, plan.factors)) for r in names}, sigma, x, losses, plan)
    return _spatial(model, spots, edges)


def resume(model: SpatialModel, expr: DataFrame, edges: DataFrame, **changes) -> SpatialModel:
    """Further spatial iterations from a fitted or loaded model, with ``changes`` to its plan.

    With a pull that the model's plan did not have, shared parameters become each replicate's own.  ``expr`` must hold the
    model's replicates; genes and spots that the model does not know are left out, missing genes count as 0.  Losses go on in one list."""
    plan = replace(model.plan or Plan(factors=len(next(iter(model.affinity.values())))), **changes)
    if plan.factors != len(next(iter(model.affinity.values()))):
        raise ValueError("the number of factors of a fitted model cannot change")
    spots, edges, names = _tables(expr, edges, model.genes)
    if names != sorted(model.weights):
        raise ValueError(f"the model knows the replicates {sorted(model.weights)}, the table holds {names}")
    return _spatial(replace(model, plan=plan, levels={}), spots, edges)


def _tables(expr: DataFrame, edges: DataFrame, genes: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """(packed spots, edges, names of the replicates), the tables written."""
    numbered = expr.sparkSession.createDataFrame(list(zip(genes, range(len(genes)), strict=True)), "gene string, g int")
    spots = materialize(fac.packed_spots(expr, numbered), "train-spots")
    names = sorted(r.replicate for r in spots.select("replicate").distinct().collect())  # a row a replicate
    return spots, materialize(edges.select("replicate", "src", "dst"), "train-edges"), names


def _spatial(model: SpatialModel, spots: DataFrame, edges: DataFrame) -> SpatialModel:
    """The spatial iterations of ``model.plan``."""
    plan, genes, best = model.plan, model.genes, np.inf
    colours = colour_graph(edges) if plan.spatial_iterations else None
    for _ in range(plan.spatial_iterations):
        model.affinity = _affinities(model, edges, plan)
        z = spatial_loadings(spots.join(model.loadings, KEY), edges, model.weights, model.affinity, _shared_noise(model), rounds=plan.sweeps, tol=1e-3, colours=colours)
        moved = z.select(*KEY, F.transform("z", lambda v: v * F.col("s")).alias("x"))
        now = materialize(moved, "train-loadings")
        sums = fac.loading_sums(spots.join(now, KEY), len(genes), plan.factors)
        weights = _weights(sums, model.sigma, model.weights, plan)
        after = SpatialModel(genes, weights, model.affinity, _noise(sums, weights, len(genes)), now, model.losses, plan)
        value = negative_log_likelihood(after, sums, edges, plan)
        after.losses = [*model.losses, value]
        if value >= best:
            break
        done = np.isfinite(best) and best - value < plan.tol * abs(best)
        model, best = after, value
        if done:
            break
    return model


def _alike(model: SpatialModel) -> list[list[str]]:
    """Replicates that share weights and affinity, together; others by themselves."""
    groups: list[list[str]] = []
    for r in model.weights:
        for g in groups:
            if np.array_equal(model.weights[r], model.weights[g[0]]) and np.array_equal(model.affinity[r], model.affinity[g[0]]):
                g.append(r)
                break
        else:
            groups.append([r])
    return groups


def _shared_noise(model: SpatialModel) -> dict[str, float]:
    """Replicates that share weights and affinity share the mean of their noise."""
    return {r: float(np.mean([model.sigma[g] for g in group])) for group in _alike(model) for r in group}


def _affinities(model: SpatialModel, edges: DataFrame, plan: Plan) -> dict[str, np.ndarray]:
    """One affinity for the replicates of a group, or each one's own drawn to the means of its groups; all in common passes."""
    flat = model.loadings.select(*KEY, F.posexplode(F.transform("x", lambda v: v / F.aggregate("x", F.lit(0.0), lambda a, b: a + b))).alias("k", "v")).withColumn("k", F.col("k") + 1)
    groups = groups_of(sorted(model.weights), plan.affinity_groups, plan.pull_affinity <= 0)
    if plan.pull_affinity <= 0:
        start = {g: model.affinity[members[0]] for g, members in groups.items()}
        found = fit_affinities(edges, flat, plan.factors, groups, steps=plan.affinity_steps, penalty=plan.penalty, tol=1e-3, start=start)
        return {r: found[g][0] for g, members in groups.items() for r in members}
    both = plan.penalty + plan.pull_affinity
    bars = {r: np.mean(own, axis=0) * plan.pull_affinity / both for r, own in group_means(model.affinity, groups).items()}
    found = fit_affinities(edges, flat, plan.factors, {r: [r] for r in bars}, steps=plan.affinity_steps, penalty=both, tol=1e-3, towards=bars, start=model.affinity)
    return {r: found[r][0] for r in bars}


def refine(model: SpatialModel, tables: dict[str, DataFrame]) -> dict[int, DataFrame]:
    """Loadings (replicate, spot_id, x) of every level of ``downsample.hierarchy`` tables, from a model of the coarsest one.

    Weights and noise go down as they are; each level's loadings are solved below the bins of the level above
    (``superresolve``) and are the bins' loadings of the next.  Spots without expression get no loadings."""
    spark = model.loadings.sparkSession
    coarsest = tables["spots"].agg(F.max("level")).first()[0] or 0
    numbered = spark.createDataFrame([(g, i) for i, g in enumerate(model.genes)], "gene string, g int")
    sigma, weights = float(np.mean(list(model.sigma.values()))), np.mean(list(model.weights.values()), axis=0)
    out = {coarsest: model.loadings.select(*KEY, "x")}
    for level in range(coarsest - 1, -1, -1):
        bins = tables["bins"].where(F.col("level") == level + 1).select("replicate", "bin_id", "spot_id")
        above = out[level + 1].select("replicate", F.col("spot_id").alias("bin_id"), F.col("x").alias("xb"))
        spots = fac.packed_spots(tables["expression"].where(F.col("level") == level), numbered)
        cells = spots.join(bins, KEY).join(above, ["replicate", "bin_id"]).select("replicate", "bin_id", "spot_id", "g", "y", "xb")
        out[level] = materialize(superresolve(cells, weights, sigma).select(*KEY, "x"), "finer-loadings")
    return out


def simplex_table(model: SpatialModel) -> DataFrame:
    """(replicate, spot_id, k, v): loadings over their sums."""
    share = F.transform("x", lambda v: v / F.aggregate("x", F.lit(0.0), lambda a, b: a + b))
    return model.loadings.select(*KEY, F.posexplode(share).alias("k", "v")).withColumn("k", F.col("k") + 1)


def packed_loadings(loadings: DataFrame, factors: int) -> DataFrame:
    """(replicate, spot_id, x) from long loadings."""
    return packed(loadings, factors, out="x")
