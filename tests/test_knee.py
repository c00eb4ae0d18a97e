"""The knee of sorted weights against the same rule walked step by step."""

import numpy as np
import pytest

from spotloom.operators.enrich import signature_by_knee


def walk(w, sensitivity, high):
    """Genes (numbers) of one factor's signature."""
    order = sorted(range(len(w)), key=lambda i: (w[i], f"g{i:02d}"), reverse=high)
    v = np.array([w[i] for i in order])
    v = (v.max() - v if high else v - v.min()) / max(v.max() - v.min(), 1e-300)
    n = len(v)
    d = np.round(v - np.arange(n) / max(n - 1, 1), 12)
    edge = lambda i, sign: all(sign * d[i] >= sign * d[j] for j in (max(i - 1, 0), min(i + 1, n - 1)))
    at = limit = None
    for i in range(n - 1):
        if edge(i, 1):
            at, limit = i, d[i] - sensitivity / max(n - 1, 1)
        if at is not None and edge(i, -1):
            limit = 0.0
        if at is not None and d[i + 1] < limit:
            return set(order[: at + 1] if high else order[:at])
    return set(order)


@pytest.mark.parametrize("high", [True, False])
def test_signatures(spark, high):
    rng = np.random.default_rng(12)
    curves = [np.round(rng.gamma(0.3, 1, 40), 3), np.round(rng.gamma(2, 1, 25), 2), np.linspace(0, 1, 9), np.ones(5), np.array([3.0]), np.exp(np.arange(20) / 3), np.log1p(np.arange(20)), rng.integers(0, 4, 30).astype(float)]
    rows = [(k, f"g{i:02d}", float(x)) for k, w in enumerate(curves) for i, x in enumerate(w)]
    for sensitivity in (1.0, 3.0):
        got: dict = {k: set() for k in range(len(curves))}
        for r in signature_by_knee(spark.createDataFrame(rows, "k int, gene string, w double"), sensitivity, high).collect():
            got[r.k].add(int(r.gene[1:]))
        assert got == {k: walk(w, sensitivity, high) for k, w in enumerate(curves)}


def test_over_representation_computes_expression_once(spark, monkeypatch):
    """Weights and background read one written table; genes are listed once, not once per use."""
    from spotloom.jobs import queries
    from spotloom.sources import views

    calls, plain = [], views.expression
    monkeypatch.setattr(views, "expression", lambda *a: calls.append(1) or plain(*a))
    plan = queries.QUERIES["over_representation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "l_quantity" not in plan
