"""Approximate nearest rows against the exact ones."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.operators.evaluate import nearest_in_space
from spotloom.operators.near_rows import nearest_about

SCHEMA = "replicate string, spot_id long, z array<double>"


def recall(spark, rows, k, **how):
    """(share of exact neighbours found, rows); equally far neighbours count as found."""
    table = spark.createDataFrame(rows, SCHEMA).cache()
    exact = nearest_in_space(table, table, k).groupBy("replicate", "src").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
    got = nearest_about(table, k, **how).cache()
    assert got.groupBy("replicate", "src", "dst").count().where("count > 1").isEmpty() and got.where("src = dst").isEmpty()
    place = {(r, i): np.array(z) for r, i, z in rows}
    for r in got.limit(50).collect():
        assert r.distance == pytest.approx(np.linalg.norm(place[r.replicate, r.src] - place[r.replicate, r.dst]))
    hits = got.join(exact, ["replicate", "src"]).where("distance <= far + 1e-9").count()
    return hits / exact.agg(F.sum("n")).first()[0], got.count()


@pytest.mark.parametrize("kind", ["uniform", "clustered", "copies"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    n = 3000
    z = rng.random((n, 10))
    if kind == "clustered":
        z = rng.normal(size=(30, 10))[rng.integers(0, 30, n)] * 3 + rng.normal(size=(n, 10))
    if kind == "copies":
        z[: n // 3] = z[0]  # a third of all rows are equal
    rows = [("b" if i % 3 else "a", i // 3 * 3 if i % 3 == 0 else i, v.tolist()) for i, v in enumerate(z)]
    share, number = recall(spark, rows, 10)
    assert share >= 0.95 and number == 10 * n


def test_small_replicates_are_complete(spark):
    rows = [("a", i, [float(i), 0.0]) for i in range(6)] + [("b", 1, [0.0, 0.0]), ("c", 1, [1.0, 0.0]), ("c", 2, [2.0, 0.0])]
    got = nearest_about(spark.createDataFrame(rows, SCHEMA), 10).collect()
    assert len(got) == 6 * 5 + 2 and {r.dst for r in got if r.replicate == "a" and r.src == 0 and r.rank == 1} == {1}
    assert nearest_about(spark.createDataFrame([], SCHEMA), 3).collect() == []


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables are not here")
def test_registered_query_finds_the_exact_neighbours(spark):
    from spotloom.jobs.queries import QUERIES

    d = "/root/testdata/sf0.001"
    exact, about = (QUERIES[q](spark, d).select("replicate", "src", "dst").cache() for q in ("knn_in_loadings", "knn_in_loadings_about"))
    assert about.count() == exact.count()
    assert exact.join(about, ["replicate", "src", "dst"]).count() >= 0.95 * exact.count()


def test_blocks_far_from_zero_and_bounded_tasks(spark):
    """Matrix products lose digits far from zero and at copies; the result is that of differences, and few pairs share a task."""
    from spotloom.operators import evaluate

    rng = np.random.default_rng(6)
    z = 1e5 + rng.normal(size=(600, 5))
    z[300:330] = z[0]
    rows = spark.createDataFrame([("r", i, "ab"[i % 2], z[i].tolist()) for i in range(600)], "replicate string, spot_id long, label string, z array<double>")
    d = np.round(np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)), 12)
    np.fill_diagonal(d, np.inf)
    got = {(r.src, r["rank"]): r.dst for r in nearest_in_space(rows, rows, 4, block=64).collect()}
    assert got == {(i, r + 1): int(j) for i in range(600) for r, j in enumerate(np.lexsort((np.arange(600), d[i]))[:4])}
    np.fill_diagonal(d, 0.0)
    same = np.arange(600) % 2
    own, other = (d * (same[:, None] == same)).sum(axis=1) / 299, (d * (same[:, None] != same)).sum(axis=1) / 300
    assert abs(evaluate.silhouette(rows, block=64).first().silhouette - np.mean((other - own) / np.maximum(own, other))) < 1e-9
    blocks = evaluate._blocks(rows, 16, ["spot_id", "z"])
    shares = evaluate._block_pairs(blocks, blocks).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in shares) == 38 * 38 and max(r["count"] for r in shares) <= 40


def test_few_rounds_on_a_sphere(spark):
    """Rows without clusters in 64 dimensions: large leaves leave little to rounds, each of which moves 2k + 1 vectors a row."""
    from spotloom.operators import near_rows

    z = np.random.default_rng(8).normal(size=(2400, 64)).astype(np.float32)
    z /= np.linalg.norm(z, axis=1)[:, None]
    rows = [("r", i, v.tolist()) for i, v in enumerate(z)]
    for how in ({"rounds": 1}, {"rounds": 1, "leaf": 700}):
        share, number = recall(spark, rows, 10, **how)
        assert share >= 0.97 and number == 10 * len(z)
    # floats stay floats as long as no row loses by it
    assert near_rows._packed(spark.createDataFrame(rows, SCHEMA)).schema["z"].dataType.simpleString() == "array<float>"
    assert near_rows._packed(spark.createDataFrame([*rows, ("r", 9999, [0.1] * 64)], SCHEMA)).schema["z"].dataType.simpleString() == "array<double>"
