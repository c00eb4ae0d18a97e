import numpy as np
import pytest

from spotloom.operators import train


def test_groups_of_replicates(spark):
    names = ["a", "b", "c"]
    assert train.groups_of(names, None, True) == {"_default": names}
    assert train.groups_of(names, "disjoint", True) == {"a": ["a"], "b": ["b"], "c": ["c"]}
    assert train.groups_of(names, {"x": ["b", "a", "a"]}, True) == {"x": ["a", "b"], "_default": ["c"]}
    two = {"x": ["a", "b"], "y": ["b", "c"]}
    assert train.groups_of(names, two, False) == two
    for groups, apart in ((two, True), ({"x": ["d"]}, False), ({"x": []}, False), ("joint", False), ({"_default": ["a"]}, False)):
        with pytest.raises(ValueError):
            train.groups_of(names, groups, apart)
    sliding = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0), ("e", 2.0)], "replicate string, t double")
    assert train.covariate_groups(sliding) == {"2.0": ["a", "b", "c", "e"], "3.0": ["b", "c", "d", "e"]}


def test_replicate_in_two_groups_against_closed_form():
    """Inside the simplex the solution of the pulled least squares has a closed form; b is drawn to the means of both groups."""
    rng = np.random.default_rng(2)
    names, n, k = ["a", "b", "c"], 12, 3
    now = {r: rng.dirichlet(np.full(n, 20.0), k).T for r in names}
    x = {r: rng.gamma(2, 1, (40, k)) for r in names}
    sums = {r: {"xx": x[r].T @ x[r], "yx": (x[r] @ now[r].T + rng.normal(0, 0.005, (40, n))).T @ x[r]} for r in names}
    groups = {"left": ["a", "b"], "right": ["b", "c"]}
    plan = train.Plan(factors=k, pull_weights=3.0, weight_groups=groups)
    got = train._weights(sums, dict.fromkeys(names, 0.5), now, plan)
    mean = {g: sum(now[r] for r in m) / len(m) for g, m in groups.items()}
    drawn = {"a": mean["left"], "b": (mean["left"] + mean["right"]) / 2, "c": mean["right"]}
    for r in names:
        quad, lin = sums[r]["xx"] / 0.25 + 3 * np.eye(k), sums[r]["yx"] / 0.25 + 3 * drawn[r]
        nu = (lin.sum(axis=0) - quad.sum(axis=0)) / n
        want = (lin - nu) @ np.linalg.inv(quad)
        assert want.min() > 0 and got[r] == pytest.approx(want, abs=1e-3)
    spread = train._spread(now, groups)
    one = lambda r, g: ((now[r] - mean[g]) ** 2).sum()
    assert spread == pytest.approx(one("a", "left") + (one("b", "left") + one("b", "right")) / 2 + one("c", "right"))
    shared = train._weights(sums, dict.fromkeys(names, 0.5), now, train.Plan(factors=k, weight_groups={"x": ["a", "c"]}))
    assert shared["a"] is shared["c"] and not np.allclose(shared["a"], shared["b"])
    alone = train._weights({"b": sums["b"]}, {"b": 0.5}, {"b": now["b"]}, train.Plan(factors=k))
    assert shared["b"] == pytest.approx(alone["b"], abs=1e-9)


@pytest.fixture(scope="module")
def three(spark):
    """Three replicates with the same ids along a ring; the third has genes of its own kind."""
    rng = np.random.default_rng(10)
    rows, z = [], np.repeat(np.eye(2), 15, axis=0) + 0.05
    first, other = (rng.gamma(0.4, 1, (12, 2)) for _ in range(2))
    for r, m in (("a", first), ("b", first), ("c", other)):
        y = np.maximum((z / z.sum(axis=1, keepdims=True) * 50) @ (m / m.sum(axis=0)).T + rng.normal(0, 0.05, (30, 12)), 0)
        rows += [(r, i, f"g{j:02d}", float(y[i, j])) for i in range(30) for j in range(12) if y[i, j] > 0]
    both = [(r, i, j) for r in "abc" for i in range(30) for j in ((i + 1) % 30, (i - 1) % 30)]
    return spark.createDataFrame(rows, "replicate string, spot_id long, gene string, value double"), spark.createDataFrame(both, "replicate string, src long, dst long")


def test_fit_with_groups_saved_and_resumed(spark, three, tmp_path):
    expr, edges = three
    plan = train.Plan(factors=2, nmf_iterations=6, spatial_iterations=1, affinity_steps=4, sweeps=1, weight_groups={"x": ["a", "b"]}, affinity_groups="disjoint")
    model = train.fit(expr, edges, plan)
    assert np.array_equal(model.weights["a"], model.weights["b"]) and not np.allclose(model.weights["a"], model.weights["c"])
    assert not np.array_equal(model.affinity["a"], model.affinity["c"])
    one = train.fit(expr, edges, train.Plan(factors=2, nmf_iterations=6, spatial_iterations=0))
    two = train.fit(expr, edges, train.Plan(factors=2, nmf_iterations=6, spatial_iterations=0, weight_groups={"x": ["a", "b"]}))
    assert two.losses[-1] < one.losses[-1]  # the third replicate's genes differ
    model.levels = {0: model.loadings.limit(5), 1: model.loadings}
    model.save(str(tmp_path / "model"))
    again = train.SpatialModel.load(spark, str(tmp_path / "model"), affinity_steps=3)
    assert again.plan == train.replace(plan, affinity_steps=3)
    assert {i: t.count() for i, t in again.levels.items()} == {0: 5, 1: 90}
    (tmp_path / "model" / "about").rename(tmp_path / "apart")
    assert train.SpatialModel.load(spark, str(tmp_path / "model")).plan == train.Plan(factors=2)
    on = train.resume(again, expr, edges, pull_weights=0.5, weight_groups={"x": ["a", "b"], "y": ["b", "c"]})
    assert not np.array_equal(on.weights["a"], on.weights["b"])  # shared before, its own now
    assert len(on.losses) == len(model.losses) + 1 and on.loadings.count() == 90 and np.isfinite(on.losses[-1])
    with pytest.raises(ValueError):
        train.resume(again, expr, edges, factors=3)
    with pytest.raises(ValueError):
        train.resume(again, expr.where("replicate <> 'c'"), edges)
