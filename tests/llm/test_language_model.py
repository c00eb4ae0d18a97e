"""The language model against direct counting in plain dictionaries."""

import math
import random
from collections import Counter, defaultdict

import pytest

from spotloom.llm import language_model as lm


def reference_scores(rows):
    """doc order: (base, score) by counting words as strings."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = [[*(lower(t or "").encode().split()), "END"] for _, t in rows]
    train = [t for (i, _), t in zip(rows, tokens) if lm.in_training(i)]
    c1, c2, after, before = Counter(), Counter(), defaultdict(set), defaultdict(set)
    for t in train:
        for u, v in zip(["START", *t], t):
            c1[v] += 1
            c2[u, v] += 1
            after[u].add(v)
            before[v].add(u)
    n, v_size, pairs = sum(c1.values()), len(c1), len(c2)

    def disc(values):
        k = [sum(1 for x in values if x == j) for j in (1, 2, 3, 4)]
        if min(k) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = k[0] / (k[0] + 2 * k[1])
        return [0] + [min(max(j - (j + 1) * y * k[j] / k[j - 1], 0.05), j - 0.05) for j in (1, 2, 3)]

    d2, d1 = disc(c2.values()), disc([len(x) for x in before.values()])
    rest = sum(d1[min(len(x), 3)] for x in before.values()) / pairs if pairs else 1.0

    def p(u, v):
        k = len(before[v]) if v in before else 0
        low = (k - d1[min(k, 3)]) / pairs if k else 0.0
        low += rest / (v_size + 1)
        total = sum(c2[u, w] for w in after[u]) if u in after else 0
        if not total:
            return low
        c = c2.get((u, v), 0)
        return (c - d2[min(c, 3)] if c else 0) / total + sum(d2[min(c2[u, w], 3)] for w in after[u]) / total * low

    base = [sum(math.log10((c1.get(v, 0) + 1) / (n + v_size + 1)) for v in t) for t in tokens]
    score = [sum(math.log10(p(u, v)) for u, v in zip(["START", *t], t)) for t in tokens]
    # the distribution after a seen and an unseen context adds up to 1 with the unknown word
    for u in ("START", "never"):
        assert sum(p(u, v) for v in c1) + p(u, "unknown word") == pytest.approx(1)
    return base, score, n, [sum(v in c1 for v in t) for t in tokens]


def test_matches_direct_counting(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join("aBé"[rng.randrange(3)] * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "x\x0by\tz\n"), (503, "the " * 3000), (None, "aa bb"), (5, rows[5][1])]
    docs = docs_of(rows)
    got = sorted((r for r in lm.score(docs, lm.train(docs)).collect()), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    base, score, n, known = reference_scores(rows)
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    assert [r.base_score for r in got] == pytest.approx(base)
    assert [r.score for r in got] == pytest.approx(score)
    assert {r.train_tokens for r in got} == {n}
    assert [r.n_known for r in got] == known


def test_columns_named_like_results_change_nothing(spark, docs_of):
    docs = docs_of([(i, "a b c d"[: 1 + i % 7] * (1 + i % 3)) for i in range(30)])
    named = docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "shard").withColumnRenamed("n_chars", "raw")
    plain, clash = (sorted(map(tuple, lm.score(d, lm.train(d)).collect())) for d in (docs, named))
    assert clash == plain


def test_empty_table(spark, docs_of):
    docs = docs_of([])
    assert lm.score(docs, lm.train(docs)).count() == 0


def test_runs_survive_packing():
    import numpy as np

    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 2**64, 50, dtype=np.uint64).repeat(4), rng.integers(0, 2**64, 200, dtype=np.uint64)
    n = rng.integers(1, 2**40, 200, dtype=np.uint64)
    got = lm.unpack_pairs(lm.pack_pairs(u, v, n))
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(u.tolist(), v.tolist(), n.tolist()))


@pytest.mark.parametrize("kind", ["pairs-{}.npy", "pairs-{}-n.npy", "words-{}.npy", "words-{}-before.npy"])
def test_lost_or_short_arrays_raise(spark, docs_of, kind):
    from pathlib import Path

    import numpy as np

    docs = docs_of([(i, f"a b{i % 9} c{i % 4} d") for i in range(60)])
    m = lm.train(docs)
    lengths = m.pair_lengths if kind.startswith("pairs") else m.word_lengths
    assert sum(m.pair_lengths.values()) == m.pairs and sum(m.word_lengths.values()) >= m.vocabulary
    file = Path(m.folder) / kind.format(max(lengths, key=lengths.get))
    whole = np.load(file)
    file.unlink()
    with pytest.raises(Exception, match="gone or cut short"):
        lm.score(docs, m).collect()
    np.save(file, whole[:-1])
    with pytest.raises(Exception, match="entries where the model lists"):
        lm.score(docs, m).collect()
    np.save(file, whole)
    lm._mapped.cache_clear()
    assert lm.score(docs, m).count() == 60
