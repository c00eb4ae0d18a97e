import hashlib
import random
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from spotloom.llm.mixing import Plan, mix
from spotloom.llm.queries import MIX_PLAN, source_domain


def deal(budget, children):
    """{name: (weight, cap)} to {name: amount}: fill in turn whoever is full first, by exact fractions."""
    order = sorted(children, key=lambda c: (float(children[c][1]) / children[c][0], c))
    left, weight, out = budget, sum(w for w, _ in children.values()), {}
    for i, c in enumerate(order):
        w, cap = children[c]
        if Fraction(cap, w) > Fraction(left, weight):
            return out | {d: children[d][0] * left // weight for d in order[i:]}
        out[c], left, weight = cap, left - cap, weight - w
    return out


def brute_force(rows, plan, domain=lambda s: (s or "")[:1]):
    tokens = defaultdict(int)
    for _, t, lang, source in rows:
        tokens[domain(source), lang or "", source or ""] += len((t or "").encode().split())
    cap = {k: v * plan.max_epochs for k, v in tokens.items()}

    def caps(depth, under):
        out = defaultdict(int)
        for k, v in cap.items():
            if k[:depth] == under:
                out[k[depth]] += v
        return out

    weight = lambda table, n: table.get(n, plan.default_weight)
    total = min(sum(tokens.values()) * plan.budget[0] // plan.budget[1], sum(cap.values()))
    budgets = {}
    for dom, b1 in deal(total, {n: (weight(plan.domain_weights, n), c) for n, c in caps(0, ()).items()}).items():
        for lang, b2 in deal(b1, {n: (weight(plan.lang_weights, n), c) for n, c in caps(1, (dom,)).items()}).items():
            for src, b3 in deal(b2, {n: (weight(plan.source_weights, n), c) for n, c in caps(2, (dom, lang)).items()}).items():
                budgets[dom, lang, src] = b3
    out = []
    for leaf, b in budgets.items():
        own = [(i, len((t or "").encode().split())) for i, t, lang, source in rows if (domain(source), lang or "", source or "") == leaf]
        epochs = b // tokens[leaf] if tokens[leaf] else 0
        rest, run = b - epochs * tokens[leaf], 0
        place = lambda d: (hashlib.md5(f"{plan.seed}:{epochs + 1}:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] is not None, d[0] or 0, d[1])
        for i, n in sorted(own, key=place):
            run += n
            out.append((i, *leaf, n, b, epochs + (run <= rest and epochs < plan.max_epochs)))
    return sorted(out, key=repr)


def test_edge_cases(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["en", "de", None]), rng.choice(["a1", "a2", "b1", "b2", "c1", None])) for i in range(400)]
    rows += [(900 + i, "long " * 300, "en", "a1") for i in range(200)]
    rows += [(3, rows[3][1], rows[3][2], rows[3][3]), (None, "x y z", "en", "a1"), (5000, None, "en", "z9"), (5001, "", "en", "z9"), (5002, "t " * 20_000, "fr", "b1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("copies", F.lit(9)).withColumn("bucket", F.lit("x"))
    for plan in (Plan({"a": 5, "b": 1}, {"en": 3}, {"a2": 7}, budget=(1, 2)), Plan({"b": 9}, budget=(1, 1), max_epochs=3), Plan(budget=(5, 1), max_epochs=2)):
        got = mix(docs, F.substring(F.coalesce("source", F.lit("")), 1, 1), plan).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_force(rows, plan)


def test_empty_table(spark, docs_of):
    assert mix(docs_of([]), F.col("source"), Plan()).collect() == []


def test_domains_of_any_source_name(spark, docs_of):
    """Numbers of any length; digits that are not ASCII are no number."""
    names = {"src99999999999": "d3", "s" + "12345678901234567890": "d2", "x00000000000000000000104y7": "d0", "src7": "d3", "none": "", "": "", None: "", "a\u0663b": "", "5\u0663": "d1"}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "doc_id long, source string").withColumn("text", F.lit("one two")).withColumn("lang", F.lit("en"))
    got = {r.source: r.domain for r in docs.select("source", source_domain().alias("domain")).collect()}
    assert got == names
    assert mix(docs, source_domain(), MIX_PLAN).count() == len(names)
