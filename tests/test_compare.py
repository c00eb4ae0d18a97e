"""Tests and percentiles against direct evaluation, and keys that repeat in other replicates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.functions.small import exact_percentile
from spotloom.operators import compare, expression, graph, loadings


def test_incomplete_beta():
    x = np.linspace(0, 1, 11)
    assert np.allclose(compare.incomplete_beta(1.0, 1.0, x), x)
    assert np.allclose(compare.incomplete_beta(2.0, 3.0, x), 6 * x**2 - 8 * x**3 + 3 * x**4)
    # one degree of freedom: the Cauchy distribution; two: an algebraic form
    t = np.array([0.3, 1.0, 12.7])
    assert np.allclose(compare.incomplete_beta(0.5, 0.5, 1 / (1 + t * t)), 1 - 2 / np.pi * np.arctan(t))
    assert np.allclose(compare.incomplete_beta(1.0, 0.5, 2 / (2 + t * t)), 1 - t / np.sqrt(2 + t * t))
    assert np.allclose(compare.normal_tails(np.array([0.0, 1.959963984540054])), [1, 0.05])


@pytest.mark.parametrize("n", [1, 2, 57, 20_000])
def test_exact_percentile(spark, n):
    rng = np.random.default_rng(n)
    rows = [(g, float(v)) for g in ("a", "b") for v in np.round(rng.normal(size=n), 3 if g == "a" else 9)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for share in (0.0, 0.05, 0.5, 0.945, 0.99, 1.0):
        got = {r.g: r.p for r in exact_percentile(df, ["g"], "v", share, "p").collect()}
        for g in ("a", "b"):
            assert got[g] == pytest.approx(np.quantile([v for h, v in rows if h == g and v is not None], share))


def test_ranks_and_rank_tests(spark):
    rng = random.Random(1)
    rows = [("x", rng.choice("ab"), float(rng.randrange(40))) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, g string, v double")
    values = sorted(v for *_, v in rows)
    rank = {v: (values.index(v) + 1 + len(values) - values[::-1].index(v)) / 2 for v in set(values)}
    assert all(r.rank == rank[r.v] for r in compare.average_ranks(df, ["k"], "v", parts=7).collect())
    got = compare.mann_whitney(df, ["k"], "g", "v", "a").first()
    a, b = ([v for _, g, v in rows if g == h] for h in "ab")
    assert got.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got.p == pytest.approx(math.erfc(abs(got.z) / math.sqrt(2)))
    one = compare.wilcoxon(df.withColumn("v", F.col("v") - 19.5), ["k"], "v").first()
    assert one.n == 500 and one.w == pytest.approx(sum(r for r, d in [(sum(abs(u - 19.5) < abs(v - 19.5) for u in values) + (sum(abs(u - 19.5) == abs(v - 19.5) for u in values) + 1) / 2, v - 19.5) for v in values] if d > 0))


def test_gene_map_against_dense_product(spark):
    rng = np.random.default_rng(3)
    m, s = rng.random((7, 3)), rng.random((3, 3))
    w = spark.createDataFrame([(f"g{i}", k + 1, float(m[i, k])) for i in range(7) for k in range(3)], "gene string, k int, w double")
    a = spark.createDataFrame([(i + 1, j + 1, float(s[i, j])) for i in range(3) for j in range(3)], "i int, j int, value double")
    one, both = compare.gene_map(w, a)
    assert all(r.value == pytest.approx((m @ s)[int(r.gene[1:]), r.k - 1]) for r in one.collect())
    got = both.collect()
    assert len(got) == 49 and all(r.value == pytest.approx((m @ s @ m.T)[int(r.a[1:]), int(r.b[1:])]) for r in got)


@pytest.fixture(scope="module")
def twins(spark):
    """Two replicates with the same ids: a line of four spots each, loadings ten times larger in the second."""
    spots = [(r, i, float(i), 0.0, "ab"[i // 2]) for r in ("p", "q") for i in range(4)]
    edges = [(r, i, j, 1.0) for r in ("p", "q") for i in range(4) for j in (i - 1, i + 1) if 0 <= j < 4]
    z = [(r, i, k, s * (i + 1.0) * k) for r, s in (("p", 1.0), ("q", 10.0)) for i in range(4) for k in (1, 2)]
    return (
        spark.createDataFrame(spots, "replicate string, spot_id long, x double, y double, label string"),
        spark.createDataFrame(edges, "replicate string, src long, dst long, distance double"),
        spark.createDataFrame(z, "replicate string, spot_id long, k int, v double"),
    )


def test_ids_may_repeat_in_other_replicates(twins):
    spots, edges, z = twins
    got = {(r.replicate, r.spot_id): r.v for r in graph.neighbour_sum(edges, z).where("k = 1").collect()}
    assert got == {(r, i): s * (4.0 if i == 1 else 6.0 if i == 2 else 2.0 if i == 0 else 3.0) for r, s in (("p", 1), ("q", 10)) for i in range(4)}
    assert {(r.replicate, r.spot_id): round(r.v, 6) for r in loadings.l1_normalize(z).where("k = 1").collect()} == {(r, i): round(1 / 3, 6) for r in "pq" for i in range(4)}
    linear = {(r.replicate, r.i, r.j): r.value for r in graph.affinity_linear_term(edges, z).collect()}
    assert linear["p", 1, 1] == 2 * (2 + 6 + 12) and linear["q", 1, 2] == 100 * 2 * 2 * (2 + 6 + 12)
    smooth = {(r.replicate, r.spot_id): r.smoothed for r in graph.smooth_labels(spots, edges).collect()}
    assert smooth == {(r, i): "ab"[i // 2] for r in "pq" for i in range(4)}
    assert {(r.replicate, round(r.modularity, 9)) for r in graph.modularity(spots, edges).collect()} == {("p", round(2 * (2 / 6 - 0.25), 9)), ("q", round(2 * (2 / 6 - 0.25), 9))}
    enrich = {(r.replicate, r.a, r.b): r.enrichment for r in graph.neighbourhood_enrichment(spots, edges).collect()}
    assert enrich["p", "a", "a"] == enrich["q", "b", "b"] == 0.75
    assert {(r.replicate, r.i, r.j): r.value for r in loadings.gram(z).withColumn("replicate", F.lit("all")).collect()}["all", 1, 1] == 30 * 101
    knn = graph.knn_graph(spots, 1).collect()
    assert {(r.replicate, r.src, r.dst) for r in knn} == {(r, i, j) for r in "pq" for i, j in ((0, 1), (1, 0), (2, 1), (3, 2))}
    assert graph.drop_disconnected(spots, edges.where("replicate = 'p'")).count() == 4


def test_correlation_of_genes_counts_zeros(spark):
    expr = spark.createDataFrame([("r", 1, "a", 2.0), ("r", 1, "b", 1.0), ("r", 2, "a", 1.0), ("r", 3, "b", 3.0)], "replicate string, spot_id long, gene string, value double")
    got = expression.gene_correlation(expr).first()
    assert got.value == pytest.approx(np.corrcoef([2, 1, 0], [1, 0, 3])[0, 1])
