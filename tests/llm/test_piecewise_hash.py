import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.llm import piecewise_hash as ph


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuéß") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def chunks(raw, size):
    """The chunks of a text, byte by byte."""
    def pattern(i):
        total = 0
        for b in (bytes(ph.WINDOW) + raw)[i + 1 : i + 1 + ph.WINDOW]:
            total = (total * 0x100000001B3 + b) % 2**64
        with np.errstate(over="ignore"):
            return int(ph._mixed(np.array([total], np.uint64))[0])

    out, start = [], 0
    for i in range(len(raw)):
        if pattern(i) % size == size - 1:
            out.append(raw[start : i + 1])
            start = i + 1
    return out + ([raw[start:]] if start < len(raw) else [])


def test_cuts_are_those_of_a_loop_also_over_blocks(monkeypatch):
    rng = random.Random(1)
    long = prose(random.Random(9), 300).encode()
    whole = ph.fingerprint(long)
    for block in (1 << 20, 50, 7, 3):
        monkeypatch.setattr(ph, "_BLOCK", block)
        for n in (0, 1, 5, 30, 120):
            raw = prose(rng, n).encode()
            for size in (3, 6, 24):
                with np.errstate(over="ignore"):
                    single = ph._cuts(raw, size)
                    doubled = ph._joined_up(*single)
                for got, want in ((single, chunks(raw, size)), (doubled, chunks(raw, 2 * size))):
                    assert got[1].tolist() == list(map(len, want))
                    assert got[0].tolist() == [sum((b + 1) * pow(int(ph._BASE), i, 2**64) for i, b in enumerate(c)) % 2**64 for c in want]
        assert ph.fingerprint(long) == whole


def test_edit_distance_against_a_table():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice(["AA", "AB", "BA", "CC"]) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + 2 * (x != y), row[j] + 1, row[j - 1] + 1)
        assert len(a) + len(b) - 2 * ph._common(a, b) == row[-1]


def test_likeness_of_edits_and_strangers():
    rng = random.Random(3)
    close, far = [], []
    for n in [3, 8, 20, 60, 150, 400, 1500, 6000] * 6:
        text, other = prose(rng, n), prose(rng, n)
        mark = ph.fingerprint(text.encode())
        close.append(ph.likeness(mark, ph.fingerprint(ph.edited(text, other).encode())))
        far.append(ph.likeness(mark, ph.fingerprint(other.encode())))
        moved = other[: len(other) // 2] + text + other[len(other) // 2 :] if n > 100 else text
        assert ph.likeness(mark, ph.fingerprint(moved.encode())) > 0.3
    assert min(close) > 0.5 and sorted(close)[5] > 0.6 and max(far) < 0.35 and sum(far) / len(far) < 0.1
    assert all(c > f for c, f in zip(close, far))
    assert ph.likeness(ph.fingerprint(b""), ph.fingerprint(b"")) == 1.0 and ph.likeness(ph.fingerprint(b""), ph.fingerprint(b"words")) == 0.0
    long = ph.fingerprint(b"x " * 300_000)
    assert ph.likeness(long, ph.fingerprint(b"x " * 300_000)) == 1.0


def brute_force(rows, text_hash):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash[r[1] or ""]))
    out = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        q = len(t) // 4
        new = t[: len(t) - q] + following[:q]
        a, b, c = (ph.fingerprint(x.encode()) for x in (t, new, following))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, ph.likeness(a, b), ph.likeness(a, c)))
    return sorted(out, key=repr)


def rows_of(kind):
    rng = random.Random(4)
    rows = [(i * 13 % 997, prose(rng, rng.choice([0, 1, 2, 5, 40, 300]))) for i in range(300)]
    if kind == "odd":
        rows += [(None, None), (None, "no id"), (None, prose(rng, 30)), (5, ""), (6, None), (7, "ß"), (8, "x" * 500_000), rows[10], rows[10], (rows[11][0], "other text")]
    if kind == "hot":
        rows += [(400, f"text {i} " + prose(rng, 5)) for i in range(200)] + [(None, f"text {i}") for i in range(150)]
    return {"one": rows[:1], "two": rows[:2]}.get(kind, rows)


@pytest.mark.parametrize("kind", ["plain", "odd", "hot", "one", "two"])
def test_against_brute_force(spark, docs_of, kind):
    rows = rows_of(kind)
    docs = docs_of(rows).repartition(5)
    text_hash = {r.t: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    for name in ("part", "h", "guest", "place", "fingerprint", "raw"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = [tuple(r) for r in ph.likenesses(docs).collect()]
    assert sorted(got, key=repr) == brute_force(rows, text_hash)


def test_a_hot_id_fills_several_parts(spark, docs_of):
    rows = rows_of("hot")
    ids = docs_of(rows).select("doc_id", F.xxhash64("text").alias("h"))
    n = ids.withColumn("part", ph._part(ids, 16)).groupBy("part").count().collect()
    assert max(r["count"] for r in n) < 90 and len(n) >= 12


def test_empty_table(spark, docs_of):
    assert ph.likenesses(docs_of([])).collect() == []
