"""Meta-spots on a chunked grid, levels, communities to a number, domains, and components per replicate."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.jobs import cli
from spotloom.operators import cluster, downsample, graph, train
from spotloom.sources import io


def cloud(spark, sizes=(150, 90), seed=3):
    """Replicates with the same ids; the second has an empty middle."""
    rng = random.Random(seed)
    rows = []
    for r, n in enumerate(sizes):
        for i in range(n):
            x = rng.uniform(0, 3) if r == 0 else rng.choice([rng.uniform(0, 0.9), rng.uniform(2.1, 3)])
            rows.append((f"r{r}", i, x, rng.uniform(0, 2)))
    return rows, spark.createDataFrame(rows, "replicate string, spot_id long, x double, y double")


def lattice(points, rate, chunks):
    """All grid points of one replicate, chunk by chunk, with their numbers on the common lattice."""
    x0, y0 = min(p[0] for p in points), min(p[1] for p in points)
    step = (max(p[0] for p in points) - x0) / chunks
    used = {(max(0, min(chunks - 1, int(np.ceil((x - x0) / step) - 1))), max(0, int(np.ceil((y - y0) / step) - 1))) for x, y in points}
    side = round((len(points) * rate / len(used)) ** 0.5)
    h = step / side
    return {(cx * side + i, cy * side + j): (x0 + (cx * side + i) * h, y0 + (cy * side + j) * h) for cx, cy in used for i in range(side + (cx == chunks - 1)) for j in range(side)}


def test_grid_points_against_brute_force(spark):
    rows, spots = cloud(spark)
    got = {(r.replicate, r.spot_id): (r.gx, r.gy) for r in downsample.chunked_grid(spots, 0.3, 4, tune=False).collect()}
    assert len(got) == len(rows)
    for rep in ("r0", "r1"):
        own = {i: (x, y) for r, i, x, y in rows if r == rep}
        grid = lattice(list(own.values()), 0.3, 4)
        for i, (x, y) in own.items():
            best = min((round((x - px) ** 2 + (y - py) ** 2, 12), at) for at, (px, py) in grid.items())
            assert got[rep, i] == best[1]


def test_grid_errors_and_empty_table(spark):
    _, spots = cloud(spark, (12, 8))
    with pytest.raises(ValueError, match="fewer than two grid points"):
        downsample.chunked_grid(spots, 0.05, 4, tune=False)
    flat = spark.createDataFrame([("r", i, 1.0, float(i)) for i in range(30)], spots.schema)
    with pytest.raises(ValueError, match="fewer than two grid points"):
        downsample.chunked_grid(flat, 0.5, 2, tune=False)
    assert downsample.chunked_grid(spots.limit(0), 0.3).count() == 0


def test_chunk_search_against_a_loop(spark):
    rows, spots = cloud(spark, (400, 230))
    got = downsample.tuned_chunks(spots, 0.2, 8)

    def search(points, rate, chunks):
        way, now = 0, chunks
        for nudge in range(chunks // 2):
            c = chunks + way * nudge
            x0, y0 = min(p[0] for p in points), min(p[1] for p in points)
            step = (max(p[0] for p in points) - x0) / c
            used = {(max(0, int(np.ceil((x - x0) / step) - 1)), max(0, int(np.ceil((y - y0) / step) - 1))) for x, y in points}
            share = len(points) * rate / len(used)
            turn = -1 if round(share**0.5) ** 2 > share else 1
            if way and way != turn:
                return c
            way, now = turn, chunks + turn * nudge
        return now

    assert got == {rep: search([(x, y) for r, _, x, y in rows if r == rep], 0.2, 8) for rep in ("r0", "r1")}


def test_levels_keep_the_sums(spark, tmp_path):
    _, spots = cloud(spark)
    expr = spots.select("replicate", "spot_id", F.concat(F.lit("g"), (F.col("spot_id") % 3).cast("string")).alias("gene"), (F.col("spot_id") % 7 + 1).cast("double").alias("value"))
    tables = downsample.hierarchy(spots, expr, 3, 0.4, 2, k=3)
    sums = {(r.replicate, r.level): r.s for r in tables["expression"].groupBy("replicate", "level").agg(F.sum("value").alias("s")).collect()}
    assert all(sums[rep, level] == pytest.approx(sums[rep, 0]) for rep in ("r0", "r1") for level in (1, 2))
    n = {(r.replicate, r.level): r["count"] for r in tables["spots"].groupBy("replicate", "level").count().collect()}
    assert all(n[rep, 0] > n[rep, 1] > n[rep, 2] for rep in ("r0", "r1"))
    below = {(r.replicate, r.level): r["count"] for r in tables["bins"].groupBy("replicate", "level").count().collect()}
    assert all(below[rep, level] == n[rep, level - 1] for rep in ("r0", "r1") for level in (1, 2))
    again = {(r.replicate, r.level, r.spot_id, r.gene): r.value for r in downsample.rebin_expression(expr, tables["bins"]).collect()}
    assert again == pytest.approx({(r.replicate, r.level, r.spot_id, r.gene): r.value for r in tables["expression"].collect()})
    io.write_sample(tables, str(tmp_path / "sample"))
    assert io.read_sample(spark, str(tmp_path / "sample"), "spots", ["r1"], 2).count() == n["r1", 2]


def test_domains_over_replicates(spark):
    """Two bands with loadings of their own, the same in both replicates: two domains, shared by the replicates."""
    rng = np.random.default_rng(5)
    rows, values = [], []
    for r in ("r0", "r1"):
        for i in range(40):
            rows.append((r, i, float(i % 20), float(i // 20)))
            own = np.array([1.0, 0.1]) if i % 20 < 10 else np.array([0.1, 1.0])
            values += [(r, i, k + 1, float(v)) for k, v in enumerate(own + rng.uniform(0, 0.02, 2))]
    spots = spark.createDataFrame(rows, "replicate string, spot_id long, x double, y double")
    edges = graph.symmetric_edges(graph.knn_graph(spots, 3))
    got = cluster.domains(spots, edges, spark.createDataFrame(values, "replicate string, spot_id long, k int, v double"), 2, k=25).collect()
    assert len(got) == 80
    sides = {left: {r.smoothed for r in got if (r.spot_id % 20 < 9 if left else r.spot_id % 20 > 10)} for left in (True, False)}
    assert len(sides[True]) == len(sides[False]) == 1 and sides[True] != sides[False]


def test_components_by_replicate_equal_numpy(spark):
    rng = np.random.default_rng(6)
    x = {r: rng.normal(0, 1, (30, 4)) @ rng.normal(0, 1, (4, 4)) for r in ("r0", "r1")}
    long = spark.createDataFrame([(r, i, k + 1, float(m[i, k])) for r, m in x.items() for i in range(30) for k in range(4)], "replicate string, spot_id long, k int, v double")
    got = {(r.replicate, r.spot_id, r.component): r.value for r in cluster.components_by_replicate(long, 2).collect()}
    for r, m in x.items():
        c = m - m.mean(axis=0)
        want = np.abs(c @ np.linalg.svd(c, full_matrices=False)[2][:2].T)
        assert np.abs([[got[r, i, 1], got[r, i, 2]] for i in range(30)]) == pytest.approx(want)


def test_loadings_go_down_the_levels(spark):
    """Spots on the left and right express genes of their own; so do the finest loadings, and bins sum up their spots."""
    rng = np.random.default_rng(7)
    spots = [("r0", i, float(i % 12) + rng.uniform(0, 0.2), float(i // 12) + rng.uniform(0, 0.2)) for i in range(96)]
    cells = [("r0", i, f"g{j}", float((10 if (j < 4) == (x < 6) else 0.2) + rng.uniform(0, 0.1))) for _, i, x, _ in spots for j in range(8)]
    tables = downsample.hierarchy(spark.createDataFrame(spots, "replicate string, spot_id long, x double, y double"), spark.createDataFrame(cells, "replicate string, spot_id long, gene string, value double"), 2, 0.4, 2, k=3)
    top = lambda n: tables[n].where("level = 1").drop("level")
    model = train.fit(top("expression"), top("edges"), train.Plan(factors=2, nmf_iterations=8, spatial_iterations=1, affinity_steps=3, sweeps=1))
    found = train.refine(model, tables)
    assert sorted(found) == [0, 1] and found[0].count() == 96
    side = {r.spot_id: int(np.argmax(r.x)) for r in found[0].collect()}
    left, right = ({side[i] for _, i, x, _ in spots if (x < 6) == (s == 0)} for s in (0, 1))
    assert len(left) == len(right) == 1 and left != right
    sums: dict = {}
    of = {r.spot_id: r.bin_id for r in tables["bins"].collect()}
    for r in found[0].collect():
        sums[of[r.spot_id]] = sums.get(of[r.spot_id], 0) + np.array(r.x)
    for r in found[1].collect():
        assert int(np.argmax(sums[r.spot_id])) == int(np.argmax(r.x))


def test_command_line(spark, tmp_path):
    assert cli.expand(["factors=linear:2:4:3", "start=choice:svd:kmeans"]) == [{"factors": f, "start": s} for f in (2, 3, 4) for s in ("svd", "kmeans")]
    assert [p["penalty"] for p in cli.expand(["penalty=log:1e-4:1e-2:3"])] == pytest.approx([1e-4, 1e-3, 1e-2])
    for bad in ("factor=choice:1", "factors=square:1:2:3", "factors=linear:1:2"):
        with pytest.raises(ValueError):
            cli.expand([bad])
    rng = np.random.default_rng(8)
    cells = [("r0", i, f"g{j}", float(rng.gamma(1, 1) + 5 * (j % 2 == i % 2))) for i in range(20) for j in range(6)]
    io.write_sample({"expression": spark.createDataFrame(cells, "replicate string, spot_id long, gene string, value double"), "edges": spark.createDataFrame([("r0", i, (i + s) % 20) for i in range(20) for s in (1, 19)], "replicate string, src long, dst long")}, str(tmp_path / "sample"))
    small = ["--set", "nmf_iterations=2", "--set", "spatial_iterations=1", "--set", "sweeps=1", "--set", "affinity_steps=2"]
    cli.main(["grid", "--sample", str(tmp_path / "sample"), "--out", str(tmp_path / "out"), "--grid", "factors=choice:2:3", *small])
    runs = spark.read.parquet(str(tmp_path / "out" / "runs")).orderBy("run").collect()
    assert [r.run for r in runs] == [0, 1] and all(np.isfinite(r.loss) for r in runs)
    assert [len(train.SpatialModel.load(spark, str(tmp_path / "out" / f"run={i}")).affinity["r0"]) for i in (0, 1)] == [2, 3]
