"""Colouring, spatial and finer loadings, communities, components, bins, and the fit end to end."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.operators import leiden, affinity, cluster, factors, graph, spatial_fit, train


def ring(spark, n, chords=0, seed=1):
    rng = random.Random(seed)
    pairs = {(i, (i + 1) % n) for i in range(n)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(chords)}
    both = {(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b}
    return spark.createDataFrame([("r", a, b, 1.0) for a, b in sorted(both)], "replicate string, src long, dst long, distance double")


def test_colours_differ_along_edges(spark):
    edges = ring(spark, 60, 80)
    colour = {r.spot_id: r.colour for r in spatial_fit.colour_graph(edges).collect()}
    assert len(colour) == 60
    assert all(colour[r.src] != colour[r.dst] for r in edges.collect())


def test_spatial_sweeps_lower_the_objective(spark):
    rng = np.random.default_rng(2)
    m, n = factors.project_simplex(rng.gamma(0.5, 1, (20, 3))), 24
    y = np.maximum(rng.gamma(0.5, 10, (n, 3)) @ m.T, 1e-6)
    x = rng.gamma(1, 1, (n, 3))
    spots = spark.createDataFrame([("r", i, list(range(20)), y[i].tolist(), x[i].tolist()) for i in range(n)], "replicate string, spot_id long, g array<int>, y array<double>, x array<double>")
    edges, s_mat = ring(spark, n), np.array([[0.5, -0.2, 0.0], [-0.2, 0.3, 0.1], [0.0, 0.1, -0.4]])
    adj = np.zeros((n, n))
    for r in edges.collect():
        adj[r.src, r.dst] = 1

    def objective(s, z):
        return np.sum((y - s[:, None] * z @ m.T) ** 2) / 2 + np.sum((adj @ z @ s_mat) * z) / 2

    values = []
    for rounds in (1, 3):
        got = sorted(spatial_fit.spatial_loadings(spots, edges, m, s_mat, 1.0, rounds).collect(), key=lambda r: r.spot_id)
        z = np.array([r.z for r in got])
        assert z.sum(axis=1) == pytest.approx(1, abs=1e-6)
        values.append(objective(np.array([r.s for r in got]), z))
    assert values[1] <= values[0] + 1e-6 < objective(x.sum(axis=1), x / x.sum(axis=1, keepdims=True))


def test_finer_loadings_follow_bins(spark):
    rng = np.random.default_rng(3)
    m = factors.project_simplex(rng.gamma(0.5, 1, (15, 2)))
    x = rng.gamma(1, 5, (8, 2))
    y = x @ m.T
    cells = [("r", i // 4, i, list(range(15)), y[i].tolist(), x[4 * (i // 4) : 4 * (i // 4) + 4].sum(axis=0).tolist()) for i in range(8)]
    got = spatial_fit.superresolve(spark.createDataFrame(cells, "replicate string, bin_id int, spot_id long, g array<int>, y array<double>, xb array<double>"), m, 0.1, 5000)
    assert np.array([r.x for r in sorted(got.collect(), key=lambda r: r.spot_id)]) == pytest.approx(x, rel=1e-2, abs=1e-2)


def test_bins_solved_together_take_the_steps_of_each_by_itself(spark):
    """Bins of unlike sizes, more than one array of them, equal to the loop over the spots of one bin."""
    rng = np.random.default_rng(5)
    m = factors.project_simplex(rng.gamma(0.5, 1, (12, 3)))
    gram, cells, want, spot = m.T @ m / 0.2**2, [], {}, 0
    for b, n in enumerate([1, 7, 2, 5, 5, 9, 3]):
        y, xb = np.abs(rng.gamma(1, 5, (n, 3)) @ m.T + rng.normal(size=(n, 12)) / 5), rng.gamma(1, 5, 3) * n
        x = v = np.repeat(xb[None] / n, n, axis=0)
        step, t = 1 / (np.linalg.eigvalsh(gram)[-1] + n), 1.0
        for _ in range(3000):
            new = np.maximum(v - step * (v @ gram - y @ m / 0.2**2 + (v.sum(axis=0) - xb)), factors.FLOOR)
            u = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, change, x, t = new + (t - 1) / u * (new - x), np.abs(new - x).max(), new, u
            if change < 1e-8 * max(1.0, xb.max()):
                break
        for i in range(n):
            cells.append(("r", b, spot, list(range(12)), y[i].tolist(), xb.tolist()))
            want[spot] = x[i]
            spot += 1
    table = spark.createDataFrame(cells, "replicate string, bin_id int, spot_id long, g array<int>, y array<double>, xb array<double>")
    got = {r.spot_id: r.x for r in spatial_fit.superresolve(table, m, 0.2, 3000, at_once=3).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_communities_of_two_cliques(spark):
    pairs = [(a, b) for base in (0, 10) for a in range(base, base + 6) for b in range(base, base + 6) if a != b] + [(0, 10), (10, 0)]
    edges = spark.createDataFrame([("r", a, b) for a, b in pairs], "replicate string, src long, dst long")
    got = {r.spot_id: r.community for r in leiden.communities(edges).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[10]


def test_communities_beat_single_nodes(spark):
    rng = random.Random(4)
    points = [(rng.gauss(c, 1), rng.gauss(c, 1)) for c in (0, 6, 12) for _ in range(40)]
    spots = spark.createDataFrame([("r", i, x, y) for i, (x, y) in enumerate(points)], "replicate string, spot_id long, x double, y double")
    edges = graph.symmetric_edges(graph.knn_graph(spots, 5))
    labels = leiden.communities(edges).select("replicate", "spot_id", F.col("community").alias("label"))
    assert graph.modularity(labels, edges).first().modularity > 0.6


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (50, 4)) @ rng.normal(0, 1, (4, 4))
    long = spark.createDataFrame([("r", i, k + 1, float(x[i, k])) for i in range(50) for k in range(4)], "replicate string, spot_id long, k int, v double")
    out, values = cluster.principal_components(long, 2)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert values == pytest.approx(s[:2] ** 2 / 49)
    got = np.zeros((50, 2))
    for r in out.collect():
        got[r.spot_id, r.component - 1] = r.value
    assert np.abs(got) == pytest.approx(np.abs((x - x.mean(axis=0)) @ vt[:2].T))


def test_partition_is_balanced(spark):
    spots = spark.createDataFrame([("r", 16 * i + j, float(i), float(j)) for i in range(16) for j in range(16)], "replicate string, spot_id long, x double, y double")
    for got, bins in ((cluster.partition_bins(spots, 4), 16), (cluster.partition_bins(spots, per_bin=32), 8)):
        sizes = [r["count"] for r in got.groupBy("bin_id").count().collect()]
        assert len(sizes) == bins and sum(sizes) == 256 and max(sizes) <= 512 / bins


def test_affinity_fit_lowers_its_loss(spark):
    rng = np.random.default_rng(8)
    z = rng.dirichlet(np.ones(3), 40)
    long = spark.createDataFrame([("r", i, k + 1, float(z[i, k])) for i in range(40) for k in range(3)], "replicate string, spot_id long, k int, v double")
    s, losses = affinity.fit_affinity(ring(spark, 40, 20), long, 3, steps=25)
    assert np.allclose(s, s.T) and losses[-1] < losses[0]
    again, more = affinity.fit_affinity(ring(spark, 40, 20), long, 3, steps=3, start=s)
    assert more[0] < losses[0]


def test_permutations_against_direct_shuffles(spark):
    rng = random.Random(9)
    labels = [rng.choice("ab") for _ in range(30)]
    spots = spark.createDataFrame([("r", i, labels[i]) for i in range(30)], "replicate string, spot_id long, label string")
    edges = ring(spark, 30, 10)
    got = {(r.a, r.b): r for r in affinity.permutation_test(spots, edges, 20).collect()}
    order = {r.spot_id: r.i for r in affinity.numbered_spots(spots).collect()}
    assert sorted(order.values()) == list(range(30))
    at = {i: s for s, i in order.items()}
    pairs = [(r.src, r.dst) for r in edges.collect()]

    def enrichment(of):
        degree = {i: sum(a == i for a, _ in pairs) for i in range(30)}
        size = {x: sum(of[i] == x for i in range(30)) for x in "ab"}
        return {(x, y): sum(1 / degree[a] for a, b in pairs if of[a] == x and of[b] == y) / size[x] for x in "ab" for y in "ab"}

    seen = enrichment(labels)
    runs = [enrichment({i: labels[at[(a * order[i] + b) % 30]] for i in range(30)}) for _, a, b in affinity.shuffles(20, 0)]
    for key, r in got.items():
        assert r.enrichment == pytest.approx(seen[key])
        assert r.p_adjacency == pytest.approx((sum(e[key] >= seen[key] - 1e-9 for e in runs) + 1) / 21)
        assert r.p_avoidance == pytest.approx((sum(e[key] <= seen[key] + 1e-9 for e in runs) + 1) / 21)


@pytest.fixture(scope="module")
def planted(spark):
    """Two replicates with the same ids, whose expression follows three factors that change along a ring."""
    rng = np.random.default_rng(10)
    m = rng.gamma(0.3, 1, (30, 3))
    m /= m.sum(axis=0)
    rows, z = [], np.repeat(np.eye(3), 20, axis=0) + 0.05
    for r in ("r0", "r1"):
        y = np.maximum((z / z.sum(axis=1, keepdims=True) * 50) @ m.T + rng.normal(0, 0.05, (60, 30)), 0)
        rows += [(r, i, f"g{j:02d}", float(y[i, j])) for i in range(60) for j in range(30) if y[i, j] > 0]
    both = [(r, i, j) for r in ("r0", "r1") for i in range(60) for j in ((i + 1) % 60, (i - 1) % 60)]
    return m, spark.createDataFrame(rows, "replicate string, spot_id long, gene string, value double"), spark.createDataFrame(both, "replicate string, src long, dst long")


@pytest.mark.parametrize(("start", "pull"), [("svd", 0.0), ("kmeans", 0.5)])
def test_fit_recovers_planted_factors(spark, planted, tmp_path, start, pull):
    m, expr, edges = planted
    plan = train.Plan(factors=3, start=start, nmf_iterations=6, spatial_iterations=2, affinity_steps=8, sweeps=1, pull_weights=pull, pull_affinity=pull * 0.01)
    model = train.fit(expr, edges, plan)
    for w in model.weights.values():
        corr = np.corrcoef(m.T, w.T)[:3, 3:]
        assert sorted(corr.argmax(axis=1).tolist()) == [0, 1, 2] and corr.max(axis=1).min() > 0.9
    steps = model.losses[:6] if len(model.losses) >= 7 else model.losses[:-1]
    assert all(a >= b * (1 - 1e-9) for a, b in zip(steps[:-1], steps[1:], strict=True) if b > 0)
    assert model.loadings.count() == 120
    labels = {(r.replicate, r.spot_id): int(np.argmax(r.x)) for r in model.loadings.collect()}
    assert all(len({labels[r, i] for i in range(20 * b + 2, 20 * b + 18)}) == 1 for r in ("r0", "r1") for b in range(3))
    model.save(str(tmp_path / "model"))
    again = train.SpatialModel.load(spark, str(tmp_path / "model"))
    assert again.genes == model.genes and again.losses == pytest.approx(model.losses) and again.sigma == pytest.approx(model.sigma)
    assert all(np.allclose(again.weights[r], w) for r, w in model.weights.items()) and all(np.allclose(again.affinity[r], a) for r, a in model.affinity.items())
    assert again.loadings.count() == 120


def test_singular_vectors_equal_numpy(spark):
    rng = np.random.default_rng(11)
    y = rng.gamma(0.3, 1, (50, 12))
    spots = spark.createDataFrame([("r", i, list(range(12)), y[i].tolist()) for i in range(50)], "replicate string, spot_id long, g array<int>, y array<double>")
    v, _ = train.right_vectors(spots, 12, 3)
    want = np.linalg.svd(y, full_matrices=False)[2][:3].T
    assert np.abs((v * want).sum(axis=0)) == pytest.approx(1, abs=1e-6)


def planted_expression(spark, seed=11, spots=45, genes=30):
    """Two replicates whose spots express one of three sets of genes each, over noise; values are sparse."""
    rng = np.random.default_rng(seed)
    rows, group = [], {}
    for r in ("r0", "r1"):
        for i in range(spots):
            group[r, i] = i % 3
            for g in range(genes):
                v = rng.poisson(9 if g % 3 == i % 3 else 0.3)
                if v:
                    rows.append((r, i, f"g{g:02d}", float(v)))
    numbered = spark.createDataFrame([(f"g{g:02d}", g) for g in range(genes)], "gene string, g int")
    return spark.createDataFrame(rows, "replicate string, spot_id long, gene string, value double"), numbered, group, rows


def test_components_of_expression_equal_numpy(spark):
    expr, numbered, group, rows = planted_expression(spark)
    scores, weights, variances = train.expression_components(factors.packed_spots(expr, numbered), 30, 4, passes=25)
    keys = sorted(group)
    dense = np.zeros((len(keys), 30))
    for r, i, g, v in rows:
        dense[keys.index((r, i)), int(g[1:])] = v
    centred = dense - dense.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert variances[:2] == pytest.approx(s[:2] ** 2 / (len(keys) - 1), rel=1e-6)
    got = {(r.replicate, r.spot_id): np.array(r.z) for r in scores.collect()}
    mine = np.array([got[k] for k in keys])
    assert np.abs(mine[:, :2]) == pytest.approx(np.abs(centred @ vt[:2].T), abs=1e-4)
    assert mine.mean(axis=0) == pytest.approx(np.zeros(4), abs=1e-8)


def test_leiden_start_finds_planted_sets(spark):
    """Communities of expression are the planted groups in both replicates, and their mean expression starts the weights."""
    expr, numbered, group, _ = planted_expression(spark)
    spots = factors.packed_spots(expr, numbered)
    plan = train.Plan(factors=3, start="leiden", components=5, neighbours=10)
    named = {(r.replicate, r.spot_id): r.label for r in train.leiden_labels(spots, 30, plan).collect()}
    assert named.keys() == group.keys() and len({(named[k], group[k]) for k in group}) == 3
    m = train.label_weights(spots, spark.createDataFrame([(*k, v) for k, v in named.items()], "replicate string, spot_id long, label int"), 30, 3)
    for k, label in list(named.items())[:3]:
        assert sorted(np.argsort(-m[:, label])[:10] % 3) == [group[k]] * 10
    with pytest.raises(ValueError, match="communities instead of 80"):
        train.leiden_labels(spots.limit(20), 30, train.Plan(factors=80, components=3, neighbours=4, retries=0))


def test_affinities_of_groups_in_common_passes(spark, monkeypatch):
    """Every group's affinity is that of a fit by itself, and a step is one pass for all groups."""
    rng = np.random.default_rng(12)
    z = rng.dirichlet(np.ones(3), 80)
    long = spark.createDataFrame([(f"r{i % 2}", i // 2, k + 1, float(z[i, k])) for i in range(80) for k in range(3)], "replicate string, spot_id long, k int, v double")
    edges = ring(spark, 40, 20).drop("replicate").crossJoin(spark.createDataFrame([("r0",), ("r1",)], "replicate string"))
    passes, run = [], type(edges).mapInPandas
    monkeypatch.setattr(type(edges), "mapInPandas", lambda self, *a, **b: passes.append(1) or run(self, *a, **b))
    got = affinity.fit_affinities(edges, long, 3, {"a": ["r0"], "b": ["r1"]}, steps=3, towards={"a": 0.1})
    assert len(passes) == 3
    for g, r, to in (("a", "r0", 0.1), ("b", "r1", 0.0)):
        one = F.col("replicate") == r
        alone, losses = affinity.fit_affinity(edges.where(one), long.where(one), 3, steps=3, towards=to)
        assert got[g][0] == pytest.approx(alone) and got[g][1] == pytest.approx(losses)
