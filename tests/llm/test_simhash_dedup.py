import random

import pytest
import xxhash

from spotloom.llm import simhash_dedup as sd


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """Smallest id per row by comparing all pairs."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_edge_cases(spark, docs_of):
    rng = random.Random(4)
    base = [" ".join("w%d" % rng.randrange(900) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:30]):
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "One Two"), (204, "one two"), (7, base[7]), (None, base[8]), (205, "Éa b c"), (206, "x " * 40_000)]
    docs = docs_of(rows).withColumnRenamed("lang", "component_id").withColumnRenamed("source", "fp")
    got = sd.simhash_components(docs)
    fps = [fingerprint(t) for _, t in rows]
    roots = components(fps)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots)}
    want = sorted(((rows[i][0], f"{fps[i]:016x}", least[roots[i]]) for i in range(len(rows))), key=repr)
    found = got.collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=repr) == want
    assert sum(r.kept for r in found) == len(set(roots))


@pytest.mark.parametrize("limit", [2, 6, 1024])
def test_long_posting_lists_lose_no_link(spark, limit):
    """Dense clusters through pairs, five-byte lists and hubs give the components of all pairs."""
    rng = random.Random(limit)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for _ in range(rng.randrange(0, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = sd.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), list_limit=limit)
    label = {f: f for f in signed}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for r in links.collect():
        label[root(r.u)] = root(r.v)
    got, want = [root(f) for f in signed], components(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_empty_table(spark, docs_of):
    assert sd.simhash_components(docs_of([])).collect() == []
