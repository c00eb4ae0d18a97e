import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.llm import quality_classifier as qc

SMALL = qc.Settings(epochs=30)


def corpus(seed, n=600):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        words = [word() for _ in range(rng.randrange(10, 120))]
        if not good:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "###" for w in words] if kind == 1 else [w for w in words for _ in range(6)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_calibration(spark, docs_of):
    rows, labels = corpus(1)
    docs = docs_of(rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = qc.fit(docs, table, ~held, s=SMALL)
    got = {r.doc_id: r.s for r in docs.select("doc_id", model.score(F.col("text")).alias("s")).collect()}
    out = [(got[i], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.5) == y for s, y in out) / len(out) > 0.95
    assert abs(np.mean([s for s, _ in out]) - np.mean([y for _, y in out])) < 0.1


def test_held_out_labels_are_never_read(spark, docs_of):
    rows, labels = corpus(2, 200)
    docs = docs_of(rows)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y, t) for i, y, t in labels]
    nets = [qc.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int"), ~held, s=SMALL).network for x in (labels, turned)]
    assert np.array_equal(nets[0].w1, nets[1].w1) and nets[0].temperature == nets[1].temperature


def test_word_vectors_equal_direct_sums(spark, docs_of):
    s = qc.Settings(buckets=256, dims=8)
    texts = ["a b c a b", "", "x x x YELL !!", "long " * 3000]
    at, sign = qc.index_vectors(s)
    want, known = np.zeros((256, 8)), qc._Hashed(256)
    for t in texts:
        ids = [known[w] for w in qc.tokens_of(t)]
        for i, w in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    for k in range(s.index_ones):
                        want[w, at[ids[j], k]] += sign[ids[j], k]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    got = qc.word_vectors(docs_of(list(enumerate(texts))).repartition(3), s=s)
    assert got == pytest.approx(want / np.where(norm == 0, 1, norm), abs=1e-6)


def test_edge_cases(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "a b"), (3, "a b"), (4, "w " * 60_000)]
    docs = docs_of(rows).withColumnRenamed("lang", "y").withColumnRenamed("source", "score")
    labels = spark.createDataFrame([(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = qc.fit(docs, labels, F.lit(True), s=SMALL)
    got = docs.select("doc_id", model.score(F.col("text")).alias("s")).collect()
    assert len(got) == 6 and {round(r.s, 9) for r in got} == {0.5}
    one = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (4, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = qc.fit(docs, one, F.lit(True), s=SMALL)
    assert all(r.s > 0.9 for r in docs.select(model.score(F.col("text")).alias("s")).collect())
    assert qc.fit(docs.limit(0), labels.limit(0), F.lit(True), s=SMALL) is not None
