"""Quality classifier: random-indexing word vectors, pooled per document, scored by a two-layer numpy network.

Random indexing gives every word a fixed sparse ternary *index vector* and learns its *word vector* as the sum of the
index vectors of its neighbours over the whole corpus.  Words are hashed into ``buckets`` rows, which bounds the
matrix whatever the vocabulary: 16,384 x 48 integers, 3 MB.  Each task adds up its own matrix over all its texts;
the matrices are then added in two levels of Spark shuffles, one small block of rows per key.

A document is the mean of its tokens' unit word vectors and of their index vectors.  Tokens are letter runs and
runs of other signs, plus marks for repeated and all-capital words, so layout and shouting have word vectors too.  The network
(tanh hidden layer, logistic output) is fitted on the driver from at most ``sample_rows`` labelled documents, a
documented bound (each is about 100 numbers); its probabilities are calibrated by a temperature on a fifth of those rows, which
the weights have not seen.

Only labels of rows for which ``learn_from`` holds are read.  Labels, language, source and id are never inputs.

Defined results: null text counts as empty; an empty text has the zero vector and gets that vector's score; labels
that are null are ignored and several labels of one document are averaged (0.5 and more counts as 1); with fewer than ten rows or
two classes to learn from, every score is the share of label 1 (0.5 without labels); repeated rows repeat; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_BLOCK = 256


@dataclass(frozen=True)
class Settings:
    """Sizes of the model; all bounded, whatever the corpus."""

    buckets: int = 1 << 14
    dims: int = 48
    window: int = 2
    index_ones: int = 2
    hidden: int = 32
    sample_rows: int = 20_000
    epochs: int = 40
    seed: int = 7


class _Hashed(dict):
    """Word to bucket, remembered for up to 100,000 words at a time."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode()) % self.buckets
        return value


def tokens_of(text: str) -> list[str]:
    """Lower-cased tokens; ``<rep>`` follows a token equal to the one before it, ``<caps>`` an all-capital word."""
    out, before = [], None
    for t in _TOKENS.findall(text):
        low = t.lower()
        out.append(low)
        if low == before:
            out.append("<rep>")
        elif t != low and len(t) > 1 and t.isupper():
            out.append("<caps>")
        before = low
    return out


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of every bucket's index vector."""
    rng = np.random.default_rng(s.seed)
    return rng.integers(0, s.dims, (s.buckets, s.index_ones)), rng.choice(np.array([-1, 1]), (s.buckets, s.index_ones))


def _bucket_runs(texts: Iterable[str], known: _Hashed, limit: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token buckets of consecutive texts with each token's text number, about ``limit`` tokens at a time."""
    ids, sizes, total = [], [], 0
    for t in texts:
        own = list(map(known.__getitem__, tokens_of(t)))
        ids.append(own)
        sizes.append(len(own))
        total += len(own)
        if total >= limit:
            yield np.fromiter((b for x in ids for b in x), np.int64, total), np.array(sizes)
            ids, sizes, total = [], [], 0
    if sizes:
        yield np.fromiter((b for x in ids for b in x), np.int64, total), np.array(sizes)


def _contexts(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray, sign: np.ndarray, s: Settings) -> np.ndarray:
    """Sum of neighbours' index vectors per bucket, flat, for one run of texts."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    total = np.zeros(s.buckets * s.dims)
    for gap in range(1, s.window + 1):
        left, right = ids[:-gap], ids[gap:]
        same = text[:-gap] == text[gap:]
        left, right = left[same], right[same]
        for word, other in ((left, right), (right, left)):
            for k in range(s.index_ones):
                total += np.bincount(word * s.dims + at[other, k], weights=sign[other, k], minlength=total.size)
    return total


def _sum_blocks(rows: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """Add up the payloads of each key in a stream, holding one block per key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, payload in zip(*(b.column(n).to_pylist() for n in [*keys, "payload"]), strict=True):
                more = np.frombuffer(payload, "<i8")
                sums[tuple(key)] = sums[tuple(key)] + more if tuple(key) in sums else more
        if sums:
            cols = {n: pa.array([k[i] for k in sums], pa.int32()) for i, n in enumerate(keys)}
            yield pa.RecordBatch.from_pydict(cols | {"payload": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    schema = ", ".join(f"{k} int" for k in keys) + ", payload binary"
    return rows.select(*keys, "payload").repartition(partitions, *keys).mapInArrow(run, schema)


def word_vectors(docs: DataFrame, text_col: str = "text", s: Settings | None = None) -> np.ndarray:
    """Unit word vectors (buckets x dims, float32) from all texts of ``docs``."""
    s = s or Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign = index_vectors(s)
        known, total, seen = _Hashed(s.buckets), np.zeros(s.buckets * s.dims), False
        for b in batches:
            for ids, sizes in _bucket_runs((x.as_py() or "" for x in b.column(0)), known):
                total += _contexts(ids, sizes, at, sign, s)
                seen = True
        if seen:
            blocks = total.astype("<i8").reshape(-1, _BLOCK * s.dims)
            slot = TaskContext.get().partitionId() % 16  # the same for every attempt of a task
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(range(len(blocks)), pa.int32()),
                "slot": pa.array([slot] * len(blocks), pa.int32()),
                "payload": pa.array([x.tobytes() for x in blocks], pa.binary()),
            })

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "block int, slot int, payload binary")
    sums = _sum_blocks(_sum_blocks(parts, ["block", "slot"], 64), ["block"], 16)
    table = np.zeros((s.buckets, s.dims))
    for row in sums.collect():  # buckets x dims integers, whatever the corpus
        table[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.payload, "<i8").reshape(_BLOCK, s.dims)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm == 0, 1, norm)).astype(np.float32)


def pool(texts: list[str], words: np.ndarray, known: _Hashed, s: Settings) -> np.ndarray:
    """One row per text: mean unit word vector, mean index vector, log length."""
    at, sign = index_vectors(s)
    plain = np.zeros((s.buckets, s.dims), np.float32)
    for k in range(s.index_ones):
        np.add.at(plain, (np.arange(s.buckets), at[:, k]), sign[:, k])
    both = np.hstack([words, plain])
    out = np.zeros((len(texts), 2 * s.dims + 1), np.float32)
    done = 0
    for ids, sizes in _bucket_runs(texts, known, 40_000):
        full = np.flatnonzero(sizes)
        if full.size:
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[full]
            out[done + full, :-1] = np.add.reduceat(both[ids], starts, axis=0) / sizes[full, None]
        out[done : done + len(sizes), -1] = np.log1p(sizes)
        done += len(sizes)
    return out


@dataclass
class Network:
    """Standardised inputs, tanh hidden layer, logistic output divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def constant_network(share: float, width: int) -> Network:
    """Scores every input with ``share``."""
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def fit_network(x: np.ndarray, y: np.ndarray, s: Settings) -> Network:
    """Adam on the log loss over four fifths of the rows; the temperature minimises the log loss of the rest."""
    if len(y) < 10 or y.min() == y.max():
        return constant_network(float(y.mean()) if len(y) else 0.5, x.shape[1])
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    held, kept = order[:cut], order[cut:]
    mean, scale = x[kept].mean(axis=0), x[kept].std(axis=0) + 1e-3
    z, t = (x[kept] - mean) / scale, y[kept]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(s.epochs):
        mixed = rng.permutation(len(t))
        for i in range(0, len(t), 256):
            rows = mixed[i : i + 256]
            h = np.tanh(z[rows] @ p[0] + p[1])
            err = (_sigmoid(h @ p[2] + p[3][0]) - t[rows]) / len(rows)
            back = np.outer(err, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ err + 1e-4 * p[2], np.array([err.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    z = net.logits(x[held])
    net.temperature = min(np.geomspace(0.25, 8, 60), key=lambda c: -np.mean(y[held] * np.log(_sigmoid(z / c) + 1e-12) + (1 - y[held]) * np.log(_sigmoid(-z / c) + 1e-12)))
    return net


@dataclass
class QualityModel:
    """What scoring needs; about 4 MB, sent to the workers as a broadcast variable."""

    words: np.ndarray
    network: Network
    settings: Settings

    def score(self, text: Column) -> Column:
        """Probability of label 1, as a column expression (an Arrow-batched function)."""
        shared = text_session().sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def quality_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = shared.value
            known = _Hashed(model.settings.buckets)
            for texts in batches:
                rows = pool([x or "" for x in texts], model.words, known, model.settings)
                yield pd.Series(model.network.probabilities(rows), dtype="float64")

        return quality_score(text)


def text_session():
    """The running session; expressions alone do not carry it."""
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", s: Settings | None = None) -> QualityModel:
    """Word vectors from all of ``docs``, the network from labelled rows for which ``learn_from`` (over doc_id) holds."""
    s = s or Settings()
    words = word_vectors(docs, text_col, s)
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learn_from)
    marked = marked.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    n = marked.count()
    share = min(1.0, s.sample_rows / max(n, 1))
    sample = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(1 << 30)) < int(share * 0.95 * (1 << 30)) if share < 1 else F.lit(True))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashed(s.buckets)
        for b in batches:
            rows = pool([x.as_py() or "" for x in b.column(1)], shared.value, known, s)
            yield pa.RecordBatch.from_pydict({"y": b.column(0), "row": pa.array([r.tobytes() for r in rows], pa.binary())})

    # the sample is bounded by sample_rows, so it may be broadcast: texts then stay where they are read
    got = texts.join(F.broadcast(sample), "doc_id").select("y", "text").mapInArrow(run, "y double, row binary").collect()
    got.sort(key=lambda r: (r.y, r.row))
    x = np.array([np.frombuffer(r.row, np.float32) for r in got], np.float64).reshape(-1, 2 * s.dims + 1)
    return QualityModel(words, fit_network(x, np.array([r.y for r in got]), s), s)
