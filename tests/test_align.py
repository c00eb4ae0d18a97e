import numpy as np
import pytest

from spotloom.operators import align, cluster, graph

ROWS = "replicate string, spot_id long, z array<double>"


def by_hand(x: dict, k: int, least: float = 0.1, sharp: float = 7.5):
    """The same merges on dense matrices."""
    sharp = sharp / np.mean([(v**2).sum() for m in x.values() for v in m])
    names, match = sorted(x), {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            d = ((x[a][:, None] - x[b][None]) ** 2).sum(axis=2)
            there, back = np.argsort(d, axis=1)[:, :k], np.argsort(d.T, axis=1)[:, :k]
            match[a, b] = [(p, q) for p in range(len(d)) for q in there[p] if p in back[q]]
    share = {(a, b): max(len({p for p, _ in m}) / len(x[a]), len({q for _, q in m}) / len(x[b])) for (a, b), m in match.items()}
    x, side = {r: m.copy() for r, m in x.items()}, {r: {r} for r in x}
    for a, b in sorted(share, key=lambda p: (-share[p], p)):
        if share[a, b] < least or side[a] is side[b]:
            continue
        stays, moves = sorted((side[a], side[b]), key=lambda s: (-sum(len(x[r]) for r in s), min(s)))
        found = []
        for (p, q), m in match.items():
            if p in moves and q in stays:
                found += [(x[p][i], x[q][j] - x[p][i]) for i, j in m]
            if q in moves and p in stays:
                found += [(x[q][j], x[p][i] - x[q][j]) for i, j in m]
        at, by = (np.array(v) for v in zip(*found))
        for r in moves:
            w = np.exp(-sharp * ((x[r][:, None] - at[None]) ** 2).sum(axis=2))
            x[r] = x[r] + w @ by / w.sum(axis=1, keepdims=True)
            side[r] = stays
        stays |= moves
    return x


@pytest.fixture(scope="module")
def shifted():
    """Three kinds of spots in three replicates of other sizes, two of them shifted, one without the third kind."""
    rng = np.random.default_rng(1)
    centre = np.array([[4.0, 0, 0, 0], [0, 4.0, 0, 0], [0, 0, 4.0, 0]])
    kinds = {"a": [30, 20, 20], "b": [20, 25, 15], "c": [20, 20, 0]}
    shift = {"a": np.zeros(4), "b": np.array([0.6, 0.5, 0.4, 1.0]), "c": np.array([-0.5, 0.3, 0.2, -1.2])}
    label = {r: np.repeat(range(3), n) for r, n in kinds.items()}
    return {r: centre[label[r]] + rng.normal(0, 0.2, (len(label[r]), 4)) + shift[r] for r in kinds}, label


def frame(spark, x):
    return spark.createDataFrame([(r, i, m[i].tolist()) for r, m in x.items() for i in range(len(m))], ROWS)


@pytest.mark.parametrize("block", [2048, 16])
def test_equal_to_dense_merges_and_shift_vanishes(spark, shifted, block):
    x, label = shifted
    got: dict = {r: np.zeros_like(m) for r, m in x.items()}
    for r in align.align_replicates(frame(spark, x), k=10, block=block).collect():
        got[r.replicate][r.spot_id] = r.z
    want = by_hand(x, 10)
    for r in x:
        assert got[r] == pytest.approx(want[r], abs=1e-9)
    for r in ("b", "c"):
        for kind in set(label[r].tolist()):
            gap = lambda t, r=r, kind=kind: np.abs(t[r][label[r] == kind].mean(axis=0) - t["a"][label["a"] == kind].mean(axis=0)).max()
            assert gap(got) < 0.25 * gap(x)


def test_replicates_that_stay(spark, shifted):
    x, _ = shifted
    one = {"a": x["a"]}
    assert {(r.spot_id, *r.z) for r in align.align_replicates(frame(spark, one)).collect()} == {(i, *map(float, m)) for i, m in enumerate(x["a"])}
    assert align.align_replicates(frame(spark, one).limit(0)).count() == 0
    apart = align.align_replicates(frame(spark, x), k=10, least=1.1).collect()
    assert all(r.z == pytest.approx(x[r.replicate][r.spot_id]) for r in apart)


def test_domains_of_shifted_replicates(spark):
    """The same two bands in both replicates, one of them shifted by more than a band's width: domains are shared once corrected."""
    rng = np.random.default_rng(5)
    rows, values = [], []
    for r, shift in (("r0", [0.0, 0.0, 0.0]), ("r1", [0.1, 0.1, 0.8])):
        for i in range(60):
            rows.append((r, i, float(i % 20), float(i // 20)))
            own = np.array([1.0, 0.1, 0.1] if i % 20 < 10 else [0.1, 1.0, 0.1]) + shift
            values += [(r, i, k + 1, float(v)) for k, v in enumerate(own + rng.uniform(0, 0.1, 3))]
    spots = spark.createDataFrame(rows, "replicate string, spot_id long, x double, y double")
    edges = graph.symmetric_edges(graph.knn_graph(spots, 3))
    got = cluster.domains(spots, edges, spark.createDataFrame(values, "replicate string, spot_id long, k int, v double"), 2, k=35, batch_correct=True).collect()
    sides = {left: {r.smoothed for r in got if (r.spot_id % 20 < 9 if left else r.spot_id % 20 > 10)} for left in (True, False)}
    assert len(got) == 120 and len(sides[True]) == len(sides[False]) == 1 and sides[True] != sides[False]
