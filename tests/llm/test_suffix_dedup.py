"""The suffix operator against brute force over all windows of the least length."""

import random
from collections import defaultdict

import pytest

from spotloom.llm.suffix_dedup import repeated_passages

pytestmark = pytest.mark.filterwarnings("ignore")


def covered_by_brute_force(rows, least):
    """(doc, word) positions inside a window of ``least`` words that another document holds."""
    where = defaultdict(set)
    words = {i: t.encode().split() for i, t in rows if i is not None and t}
    for i, w in words.items():
        for p in range(len(w) - least + 1):
            where[tuple(w[p : p + least])].add((i, p))
    out = set()
    for hits in where.values():
        if len({i for i, _ in hits}) > 1:
            out |= {(i, p + k) for i, p in hits for k in range(least)}
    return out


def covered_by_result(result):
    out = set()
    for r in result:
        out |= {(r.doc_id, r.start + k) for k in range(r.n_words)}
        out |= {(r.other_id, r.other_start + k) for k in range(r.n_words)}
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    passages = [[word() for _ in range(rng.randrange(20, 120))] for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [[word() for _ in range(rng.randrange(0, 80))]]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), [word() for _ in range(rng.randrange(0, 40))]]
        rows.append((i, " ".join(x for p in parts for x in p)))
    rows += [(200 + i, rows[3][1]) for i in range(4)]
    twice = [word() for _ in range(60)]
    rows += [(400, " ".join([*twice, "x", "y", *twice])), (401, " ".join(["z", *twice])), (402, " ".join([*twice] * 9)), (403, " ".join([*twice] * 7))]
    rows += [(300, "go " * 90), (301, "go " * 90 + "on"), (302, None), (303, ""), (None, rows[5][1]), (304, "short text")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_covers_what_brute_force_covers(spark, docs_of, seed):
    rows = corpus(seed)
    got = repeated_passages(docs_of(rows)).collect()
    texts = dict(r for r in rows if r[0] is not None)
    for r in got:
        a, b = (texts[r.doc_id] or "").split(), (texts[r.other_id] or "").split()
        assert a[r.start : r.start + r.n_words] == b[r.other_start : r.other_start + r.n_words]
        assert r.n_words >= 50 and r.doc_id != r.other_id
    assert covered_by_result(got) == covered_by_brute_force(rows, 50)


def test_repeat_that_holds_a_more_common_passage(spark, docs_of):
    """Two documents share some words before (or after) a passage that many documents between them hold."""
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(10**6)
    some = lambda n: [word() for _ in range(n)]
    rows = []
    for case in range(12):
        common, own = some(40), some(12)
        pair = [*own, *common] if case % 2 else [*common, *own]
        rows += [(case * 20 + i, " ".join([*some(30), *(pair if i in (0, 12) else common), *some(30)])) for i in range(13)]
    got = repeated_passages(docs_of(rows)).collect()
    assert {(r.other_id, r.doc_id, r.n_words) for r in got} == {(case * 20, case * 20 + 12, 52) for case in range(12)}
    assert covered_by_result(got) == covered_by_brute_force(rows, 50)


@pytest.mark.parametrize("decoys", [1, 9])
def test_documents_that_quote_the_passage_do_not_hide_it(spark, docs_of, decoys):
    """By id, documents that each quote 20 words of a repeated passage lie between its two holders."""
    rng = random.Random(decoys)
    some = lambda n: ["w%d" % rng.randrange(10**6) for _ in range(n)]
    rows = []
    for case in range(20):
        p, base = some(55), case * 20
        rows.append((base, " ".join(some(30) + p + some(30))))
        for d in range(decoys):
            at = rng.randrange(35)
            rows.append((base + 1 + d, " ".join(some(40) + p[at : at + 20] + some(40))))
        rows.append((base + 19, " ".join(some(25) + p + some(35))))
    got = repeated_passages(docs_of(rows)).collect()
    assert {(r.other_id, r.doc_id, r.n_words) for r in got} == {(case * 20, case * 20 + 19, 55) for case in range(20)}


def test_several_texts_of_one_id_and_clashing_columns(spark, docs_of):
    """One text of an id is a copy; the passage in its other text is still found.  Repeated rows count once."""
    rng = random.Random(3)
    some = lambda n: ["w%d" % rng.randrange(10**6) for _ in range(n)]
    p, copy = some(120), " ".join(some(80))
    rows = [(1, copy), (2, " ".join(p + some(20))), (5, copy), (5, " ".join(some(20) + p)), (5, " ".join(some(20)))]
    docs = docs_of(rows + rows[1:4]).withColumnRenamed("lang", "seed").withColumnRenamed("source", "rep").withColumnRenamed("n_chars", "packed")
    assert sorted((r.other_id, r.doc_id, r.n_words) for r in repeated_passages(docs).collect()) == [(1, 5, 80), (2, 5, 120)]


def test_empty_table(spark, docs_of):
    assert repeated_passages(docs_of([])).count() == 0
