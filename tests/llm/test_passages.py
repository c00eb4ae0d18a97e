import random

import numpy as np
import pytest

from spotloom.llm import passages


def links_by_hand(rows, reach, bits):
    """Pairs of (doc, pos) that ``linked`` defines, over the whole sorted table."""
    rows = sorted(set(rows))
    runs = []
    for seed, doc, pos in rows:
        if not runs or runs[-1][0] != (seed, doc):
            runs.append(((seed, doc), []))
        runs[-1][1].append(pos)
    out = set()
    for n, ((seed, doc), places) in enumerate(runs):
        for s in range(1, reach + 1):
            if n >= s:
                (other, d), at = runs[n - s]
                if other >> bits == seed >> bits and d != doc:
                    out |= {((d, at[-1]), (doc, p)) for p in places}
        opens = n == 0 or runs[n - 1][0][0] >> bits != seed >> bits
        if opens and n + 1 < len(runs) and runs[n + 1][0][0] >> bits == seed >> bits and runs[n + 1][0][1] != doc:
            out |= {((doc, p), (runs[n + 1][0][1], runs[n + 1][1][0])) for p in places[:-1]}
    return out


@pytest.mark.parametrize(("reach", "bits"), [(1, 0), (3, 0), (4, 4)])
def test_links_do_not_depend_on_partitions(spark, reach, bits):
    """A hot seed that covers several range partitions, and seeds of one row, of one document, of many."""
    rng = random.Random(1)
    rows = [((7 << bits) + rng.randrange(1 << bits), i, 0) for i in range(3000)] + [(7 << bits, 10, p) for p in range(1, 40)]
    rows += [((s << bits) + rng.randrange(1 << bits), rng.randrange(50), rng.randrange(100)) for s in range(-300, 300) if s != 7 for _ in range(rng.randrange(1, 5))]
    rows += [(99 << bits, 5, p) for p in range(20)]
    rows = sorted(set(rows))
    got = passages.neighbour_links(spark.createDataFrame(rows, "seed long, doc_id long, pos int").repartition(3), reach, bits).collect()
    want = links_by_hand(rows, reach, bits)
    have = {((r.doc_a, r.pos_a), (r.doc_b, r.pos_b)) for r in got}
    assert want <= have
    if bits == 0:  # a partition's first run may count as its group's first: a few links more, all between equal seeds
        at = {}
        for s, d, p in rows:
            at.setdefault((d, p), set()).add(s)
        assert all(at[a] & at[b] and a[0] != b[0] for a, b in have)
        assert len(have) <= len(want) + 100 * reach


def test_few_rows_in_many_partitions(spark):
    """Groups whose rows lie in more than two partitions are still linked in all pairs."""
    rows = [(s, d, 0) for s in range(3) for d in range(4)]
    got = passages.neighbour_links(spark.createDataFrame(rows, "seed long, doc_id long, pos int").repartition(12), 8).collect()
    assert {(r.doc_a, r.doc_b) for r in got} == {(a, b) for a in range(4) for b in range(a + 1, 4)}


@pytest.mark.parametrize("k", [1, 5, 50])
def test_window_hashes_depend_on_the_words_alone(k):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 200).astype(np.uint64)
    b = np.concatenate((rng.integers(0, 2**63, 77).astype(np.uint64), a))
    assert (passages.window_hashes(a, k) == passages.window_hashes(b, k)[77:]).all()
    assert len(set(passages.window_hashes(b, k).tolist())) == len(b) - k + 1
    assert len(passages.window_hashes(a[: k - 1], k)) == 0


def test_shared_windows_are_sampled_on_both_sides():
    rng = np.random.default_rng(2)
    for vocabulary in (3, 50, 10**6):
        for _ in range(50):
            common = rng.integers(0, vocabulary, 6)
            texts = [np.concatenate((rng.integers(0, vocabulary, rng.integers(0, 30)), common, rng.integers(0, vocabulary, rng.integers(0, 30)))).astype(np.uint64) for _ in range(2)]
            whole = [set((passages.window_hashes(t, 5) >> np.uint64(16)).tolist()) for t in texts]
            picks = [set((passages.seed_rows(t, 5, 3)[0].view(np.uint64) >> np.uint64(16)).tolist()) for t in texts]
            assert picks[0] & whole[1] == picks[1] & whole[0]
