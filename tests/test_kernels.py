"""Numerical kernels against direct evaluation."""

import itertools
import random

import numpy as np
import pytest

from spotloom.operators import affinity, evaluate, factors, graph


def test_partition_function_of_two_and_three_entries():
    rng = np.random.default_rng(1)
    for scale in (1e-3, 1.0, 30.0):
        e = rng.normal(0, scale, (20, 2))
        d = e[:, 0] - e[:, 1]
        want = -e[:, 1] + np.log(-np.expm1(-d) / d)
        assert affinity.log_partition(e) == pytest.approx(want, rel=1e-9, abs=1e-9)
    e = np.array([[0.3, -0.8, 1.4]])
    want = sum(np.exp(-e[0, k]) / np.prod([e[0, j] - e[0, k] for j in range(3) if j != k]) for k in range(3))
    assert affinity.log_partition(e)[0] == pytest.approx(np.log(want))


def test_mean_is_the_gradient():
    rng = np.random.default_rng(2)
    e, h = rng.normal(0, 1, (3, 6)), 1e-5
    mean = affinity.mean_under(e)
    assert mean.sum(axis=1) == pytest.approx(1)
    for k in range(6):
        step = np.zeros(6)
        step[k] = h
        slope = (affinity.log_partition(e + step) - affinity.log_partition(e - step)) / (2 * h)
        assert -slope == pytest.approx(mean[:, k], abs=1e-7)


def test_simplex_projection():
    rng = np.random.default_rng(3)
    c = rng.normal(0, 1, (7, 5))
    p = factors.project_simplex(c, 0.0)
    assert p.sum(axis=0) == pytest.approx(1)
    for j in range(5):  # no feasible direction comes closer
        for a, b in itertools.permutations(range(7), 2):
            q = p[:, j].copy()
            t = min(1e-4, q[a])
            q[a] -= t
            q[b] += t
            assert np.sum((q - c[:, j]) ** 2) >= np.sum((p[:, j] - c[:, j]) ** 2) - 1e-12


def test_loadings_meet_the_optimality_conditions():
    rng = np.random.default_rng(4)
    m = rng.gamma(1, 1, (30, 5))
    y = rng.gamma(1, 1, (12, 30))
    x = factors.solve_loadings(y @ m, m.T @ m, np.ones((12, 5)), 20_000, 1e-12)
    grad = x @ m.T @ m - y @ m
    assert np.all(grad[x > 1e-8] == pytest.approx(0, abs=1e-4))
    assert np.all(grad[x <= 1e-8] > -1e-4)


def test_best_matching():
    rng = random.Random(5)
    for n in (1, 3, 5):
        w = {(r, c): rng.randrange(20) for r in range(n) for c in range(n)}
        best = max(sum(w[r, p[r]] for r in range(n)) for p in itertools.permutations(range(n)))
        assert sum(w[r, c] for r, c in evaluate.best_matching(w).items()) == best
    with pytest.raises(ValueError):
        evaluate.best_matching({(0, 0): 1, (0, 1): 2})


@pytest.mark.parametrize("shape", ["uniform", "clusters", "line", "few"])
def test_knn_equals_brute_force(spark, shape):
    rng = random.Random(6)
    if shape == "uniform":
        points = [(rng.random(), rng.random()) for _ in range(300)]
    elif shape == "clusters":
        points = [(c + rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) for c in (0, 5, 1000) for _ in range(80)] + [(1e5, 1e5), (0.0, 0.0), (0.0, 0.0)]
    elif shape == "line":
        points = [(float(i // 2), 1.0) for i in range(100)]
    else:
        points = [(1.0, 2.0), (2.0, 2.0), (9.0, 9.0)]
    rows = [("a", i, x, y) for i, (x, y) in enumerate(points)] + [("b", 1000, 0.0, 0.0)]
    got = {(r.src, r.rank): r.dst for r in graph.knn_graph(spark.createDataFrame(rows, "replicate string, spot_id long, x double, y double")).collect()}
    want = {}
    for i, (x, y) in enumerate(points):
        near = sorted(((x - u) * (x - u) + (y - v) * (y - v), j) for j, (u, v) in enumerate(points) if j != i)[:6]
        want |= {(i, k + 1): j for k, (_, j) in enumerate(near)}
    assert got == want


def test_nmf_recovers_planted_factors(spark):
    rng = np.random.default_rng(7)
    m = rng.gamma(0.3, 1, (40, 3))
    m /= m.sum(axis=0)
    x = rng.gamma(0.5, 40, (150, 3))
    y = np.maximum(x @ m.T + rng.normal(0, 0.01, (150, 40)), 0)
    rows = [(f"r{i % 2}", i, f"g{j:02d}", float(y[i, j])) for i in range(150) for j in range(40) if y[i, j] > 0]
    model = factors.fit_nmf(spark.createDataFrame(rows, "replicate string, spot_id long, gene string, value double"), 3, iterations=12)
    assert model.losses[-1] < 0.05 * model.losses[0] and model.losses == sorted(model.losses, reverse=True)
    assert model.weights.sum(axis=0) == pytest.approx(1, abs=1e-6)
    corr = np.corrcoef(m.T, model.weights.T)[:3, 3:]
    assert sorted(corr.argmax(axis=1).tolist()) == [0, 1, 2] and corr.max(axis=1).min() > 0.95
