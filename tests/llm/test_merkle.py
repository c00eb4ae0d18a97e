import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spotloom.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])])


def tree(nodes, fan_out=8):
    """(root, for each node its list of (position, siblings))."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fan_out, len(nodes))) for i in range(0, len(nodes), fan_out)]
        for run in runs:
            for at, i in enumerate(run):
                for o in owners[i]:
                    paths[o].append((at, [nodes[j] for j in run if j != i]))
        owners = [[o for i in run for o in owners[i]] for run in runs]
        nodes = [H(*[nodes[i] for i in run]) for run in runs]
    return nodes[0], paths


def brute_force(rows, fan_out=8):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (own, *tree([leaf(r) for r in own], fan_out))
    root, tops = tree([trees[v][1] for v in langs], fan_out)
    out = []
    for k, lang in enumerate(langs):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            path = path + tops[k]
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now = (r[0], r[1].translate({c: c + 32 for c in range(65, 91)}), *r[2:])
            at = leaf(now)
            for pos, others in path:
                at = H(*others[:pos], at, *others[pos:])
            out.append((r[0], leaf(r), subroot, root, H(*[s for _, others in path for s in others]), at, at == root))
    return sorted(out, key=repr)


def corpus(n, langs, seed=1):
    rng = random.Random(seed)
    rows = [(i * 7 % 100_003, rng.choice(["Ab c", "ab c", "É Z", "x"]) * rng.randrange(0, 9), rng.choice(langs), rng.choice(["s", None, "ß"]), rng.choice([3, None])) for i in range(n)]
    rows += [rows[5], rows[5], (None, "No id", langs[0], "s", 1), (None, None, None, None, None), (rows[7][0], "Other text", rows[7][2], "s", 9), (90_001, "A" * 300_000, langs[0], "s", 300_000)]
    return rows


@pytest.mark.parametrize("n,langs,fan_out", [(700, ["en", "de", None, "é", ""], 8), (90, ["en"], 8), (130, [f"l{i}" for i in range(40)], 8), (61, ["en", "de"], 2), (500, ["en", "de", None], 3)])
def test_against_brute_force(spark, n, langs, fan_out):
    rows = corpus(n, langs)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("grp", "leaf", "at", "g", "path", "row_no", "size", "present"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = merkle.tampered_proofs(docs, fan_out)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(rows, fan_out)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_one_group_of_each_size(spark, n):
    rows = [(i, f"Text {i}", "en", "s", 5) for i in range(n)]
    got = merkle.tampered_proofs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == (brute_force(rows) if rows else [])


def test_targets_met_by_shuffle_give_the_same_paths(spark, monkeypatch):
    rows = corpus(600, ["en", "de", "fr"], 4)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", -1)
    got = merkle.tampered_proofs(spark.createDataFrame(rows, SCHEMA), 3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_force(rows, 3)


def test_a_changed_sibling_breaks_every_proof_above_it(spark):
    """Folding needs all siblings: any other digest in a path leads elsewhere."""
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    leaves = docs.select("doc_id", F.col("lang").alias("grp"), merkle.leaf_digest([F.col("text")]).alias("leaf"), F.monotonically_increasing_id().alias("row_no"))
    found = merkle.manifest(leaves)
    bad = F.transform("path", lambda s: F.struct(s["at"].alias("at"), F.unhex(F.sha2(F.hex(s["others"]), 256)).alias("others")))
    both = found.rows.select(merkle.fold(F.col("leaf"), F.col("path")).alias("good"), merkle.fold(F.col("leaf"), bad).alias("bad"), "doc_id").collect()
    assert all(r.good == found.root.hex() and r.bad != r.good for r in both) and len(both) == 20
