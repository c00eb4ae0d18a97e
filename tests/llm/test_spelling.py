import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spotloom.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def corpus(seed, stems=40, docs=120):
    """Stems in frequent and rare spellings over few letters, so that many bigrams are shared and repeat."""
    rng = random.Random(seed)
    letters = "abcé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(stems)]

    def spoilt(w):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:i] + rng.choice(letters) * (kind > 0) + w[i + (kind < 2) :]

    words = []
    for w in base:
        words += [w] * rng.choice([1, 60, 900])
        for _ in range(5):
            v = spoilt(w)
            words += [v] * rng.choice([1, 2, 40])
            words += [spoilt(v)] * rng.choice([1, 2])
    rng.shuffle(words)
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words[i::docs])) for i in range(docs)]
    return rows + [rows[3], rows[3], (None, rows[4][1]), (7, None), (8, ""), (9, "1234 --- ab"), (11, "ÀÉÿ×÷ÀÉÿ " * 3), (12, "zzzzzzzz,yyyyyyyy_" * 40_000), (13, "q" * 50_000 + " " + "q" * 50_000 + "." + "q" * 49_999 + "." + "q" * 49_999)]


@pytest.mark.parametrize("seed,list_limit", [(1, 200), (2, 3), (3, 0)])
def test_against_brute_force(spark, docs_of, seed, list_limit):
    rows = corpus(seed)
    docs = docs_of(rows).repartition(6)
    for name in ("word", "n", "form", "gram", "pos", "last"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = [tuple(r) for r in spelling.variants(docs, list_limit=list_limit).collect()]
    want = brute_force(rows)
    assert any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)
    assert sorted(got, key=repr) == want


@pytest.mark.parametrize("letters", ["ab", "abcd", "abcdefgh"])
def test_pivots_survive_one_edit(letters):
    """Of two words within one edit, the one whose prefix ends earlier has a pivot in the other's prefix, with one side equal."""
    rng = random.Random(5)
    grams = [a + b for a in letters for b in letters]
    weight = {g: rng.randrange(1, 50) for g in grams}
    rank = {g: i for i, g in enumerate(sorted(grams, key=lambda g: (weight[g], g)))}
    for _ in range(20_000):
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 12)))
        i, kind = rng.randrange(len(a)), rng.randrange(3)
        b = a[:i] + rng.choice(letters) * (kind > 0) + a[i + (kind < 2) :]
        assert (spelling.letter_sign(a) ^ spelling.letter_sign(b)).bit_count() <= 2
        if a == b or len(b) < 7:
            continue
        (pa, va, la), (pb, vb, lb) = (spelling.prefix_and_pivots(w, rank, weight) for w in (a, b))
        (x, piv), (y, pre) = ((a, va), (b, pb)) if la <= lb else ((b, vb), (a, pa))
        assert {k for _, p in piv for k in (x[: p + 2] + "<", ">" + x[p:])} & {k for _, p in pre for k in (y[: p + 2] + "<", ">" + y[p:])}
        (p, q) = sorted(i for _, i in piv)
        assert q - p >= 2
        three = sorted((rank[x[i : i + 2]], i) for i in range(len(x) - 1))[:3]
        cost = min(weight[x[i : i + 2]] + weight[x[j : j + 2]] for _, i in three for _, j in three if j - i >= 2)
        assert sum(weight[g] for g, _ in piv) == cost and len(pre) <= 7


def test_long_words_are_compared_from_their_ends():
    rng = random.Random(6)
    for _ in range(5000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 8)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 8)))
        assert a == b or spelling.one_edit(a, b) == one_edit(a, b)


def test_a_full_table_of_words_is_passed_on(spark, docs_of):
    rows = [(i, f"letters{chr(97 + i % 20)} common") for i in range(200)]
    small = {tuple(r) for r in spelling.word_counts(docs_of(rows), hold=3).collect()}
    assert small == {tuple(r) for r in spelling.word_counts(docs_of(rows)).collect()} and len(small) >= 20


def test_empty_table(spark, docs_of):
    assert spelling.variants(docs_of([])).collect() == []
    assert spelling.variants(docs_of([(1, None), (2, "short a b")])).collect() == []
