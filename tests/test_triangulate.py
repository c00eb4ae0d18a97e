"""Delaunay graphs against the empty-circle rule over all triples, and nearest rows against all pairs."""

import numpy as np
import pytest

from spotloom.operators import triangulate

SCHEMA = "replicate string, spot_id long, x double, y double"


def empty_circle_edges(points):
    """{(i, j)}: pairs with circles through both that hold no other point, of more than one size."""
    p, out = np.array(points), set()
    for i in range(len(p)):
        for j in range(i):
            d, mid = p[j] - p[i], (p[i] + p[j]) / 2
            rest = np.delete(p, [i, j], axis=0) - mid
            across, room = rest @ np.array([-d[1], d[0]]), (rest**2).sum(axis=1) - (d**2).sum() / 4
            flat = np.abs(across) <= 1e-12 * np.sqrt((rest**2).sum(axis=1)) * np.hypot(*d)
            if (room[flat] < 0).any():
                continue
            bound = room[~flat] / (2 * across[~flat])
            low = max(bound[across[~flat] < 0], default=-np.inf)
            high = min(bound[across[~flat] > 0], default=np.inf)
            if high - low > 1e-9 * max(1.0, min(abs(low), abs(high))):
                out |= {(i, j), (j, i)}
    return out


def clouds():
    rng = np.random.default_rng(1)
    blob = lambda x, y, s, n: rng.normal((x, y), s, (n, 2))
    return {
        "random": rng.uniform(0, 1, (160, 2)),
        "clusters": np.concatenate([blob(0, 0, 0.01, 70), blob(50, 3, 0.5, 60), blob(20, 90, 0.001, 30)]),
        "line": np.stack([np.arange(60) * 0.5, np.arange(60) * 0.25], axis=1),
        "grid": np.stack(np.meshgrid(np.arange(10.0), np.arange(9.0)), axis=-1).reshape(-1, 2),
        "rim": np.stack([np.cos(np.linspace(0, 6, 80)), np.sin(np.linspace(0, 6, 80))], axis=1) * np.linspace(1, 1.2, 80)[:, None],
        "skew": np.concatenate([rng.uniform(0, 1, (60, 2)) * [1000, 0.01], blob(500, 40, 1, 40)]),
        "two": np.array([[0.0, 0.0], [3.0, 4.0]]),
        "one": np.array([[1.0, 1.0]]),
    }


def test_delaunay_against_empty_circles(spark):
    """All clouds are replicates of one table, with the same ids; k is small, so many cells are cut again."""
    sets = clouds()
    rows = [(name, i, float(x), float(y)) for name, p in sets.items() for i, (x, y) in enumerate(p)]
    rows += [("random", 900, float(sets["random"][3][0]), float(sets["random"][3][1])), ("random", 901, None, 2.0)]  # the same place; no place
    got = triangulate.delaunay_graph(spark.createDataFrame(rows, SCHEMA), k=8).collect()
    for name, p in sets.items():
        mine = {(r.src, r.dst) for r in got if r.replicate == name}
        assert mine == empty_circle_edges(p), name
    assert all(r.distance == pytest.approx(float(np.hypot(*(sets[r.replicate][r.src] - sets[r.replicate][r.dst])))) for r in got)
    assert len(got) == len({(r.replicate, r.src, r.dst) for r in got})


def test_delaunay_cut_at_a_percentile(spark):
    p = np.random.default_rng(3).uniform(0, 1, (90, 2))
    spots = spark.createDataFrame([("r", i, float(x), float(y)) for i, (x, y) in enumerate(p)], SCHEMA)
    want = empty_circle_edges(p)
    cut = np.percentile([np.hypot(*(p[i] - p[j])) for i, j in want], 94.5)
    got = {(r.src, r.dst) for r in triangulate.delaunay_within(spots).collect()}
    assert got == {(i, j) for i, j in want if np.hypot(*(p[i] - p[j])) <= cut + 1e-12}


def test_nearest_object_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    objects = {"a": np.concatenate([rng.uniform(0, 1, (900, 2)), rng.normal(5, 0.01, (600, 2))]), "b": rng.normal(0, 1, (3, 2)), "c": np.ones((5, 2))}
    spots = {"a": rng.uniform(-1, 7, (200, 2)), "b": rng.normal(0, 9, (50, 2)), "c": rng.normal(0, 1, (4, 2)), "none": rng.normal(0, 1, (3, 2))}
    table = lambda t: [(r, i, float(x), float(y)) for r, p in t.items() for i, (x, y) in enumerate(p)]
    got = triangulate.nearest_object(spark.createDataFrame(table(spots), SCHEMA), spark.createDataFrame(table(objects), SCHEMA.replace("spot_id", "object_id"))).collect()
    assert len(got) == 254
    for r in got:
        d = np.sqrt(((objects[r.replicate] - spots[r.replicate][r.spot_id]) ** 2).sum(axis=1))
        assert r.distance == pytest.approx(d.min()) and r.object_id == int(d.argmin())
    assert triangulate.nearest_object(spark.createDataFrame([], SCHEMA), spark.createDataFrame(table(objects), SCHEMA.replace("spot_id", "object_id"))).count() == 0
    assert triangulate.delaunay_graph(spark.createDataFrame([], SCHEMA)).count() == 0
