"""Language-model scoring: an interpolated modified Kneser-Ney bigram model in memory-mapped sorted hash arrays.

Counting.  Each task turns its texts into sorted runs of distinct (context, word) pairs with counts, one packed run per
shard and block of texts.  Shards are dealt by context and the word's top four bits, so a context that precedes a third of
all words still spreads over sixteen shards.  A shard merges its runs and writes two arrays to the shared folder: the
sorted 64-bit hashes of its pairs and their counts.  What the model needs about single words (token count, number of
different words before it, number of words seen once, twice, more often after it) is summed in a second shuffle and stored
the same way, sharded by the word's hash.  Nothing but a few sums per shard and the lengths of its arrays reaches the driver;
a listed array that is missing or of another length when a task maps it raises, so a lost file never scores as unseen.

Scoring.  Tasks memory-map the arrays: pages are shared by all workers of a machine and none is copied into a worker.
A block of texts looks up its distinct words and pairs in sorted order, shard by shard.

The number of shards grows with the input.  Pairs are all kept, none is pruned.  Words and pairs are told apart by 64-bit
hashes.

The folder must be a path that all machines mount (``file:`` scheme), because other stores cannot be mapped.

Defined results: null text counts as empty, an empty text is one end token; rows with a null id belong to the training
rows by the remainder of the empty text; repeated rows count and are scored as often as they occur; without training
rows every probability is 1; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.functions.scratch import scratch_dir

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
#: Tokens that no word can equal, since words hold no white space.
_END, _START = xxhash.xxh64_intdigest(b" "), xxhash.xxh64_intdigest(b"\n")
_BLOCK = 1_000_000
_LISTED = pa.struct([("shard", pa.int32()), ("length", pa.int64())])
_FIELDS = ["tokens", "before", "once", "twice", "often", "follows"]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def in_training(doc_id: int | None, modulus: int = 7, held: int = 2) -> bool:
    """Whether a row belongs to the training rows: CRC-32 of its id as text, not ``held`` modulo ``modulus``."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus != held


def token_blocks(ids: list, texts: list[bytes | None], known: _Words) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, tokens per text, token hashes with one end token per text), about a million tokens at a time."""
    own, sizes, tokens, total = [], [], [], 0
    for i, t in zip(ids, texts, strict=True):
        words = (t or b"").translate(_LOWER).split()
        got = list(map(known.__getitem__, words))
        got.append(_END)
        own.append(i)
        sizes.append(len(got))
        tokens.append(np.array(got, _U))
        total += len(got)
        if total >= _BLOCK:
            yield own, np.array(sizes), np.concatenate(tokens)
            own, sizes, tokens, total = [], [], [], 0
    if own:
        yield own, np.array(sizes), np.concatenate(tokens)


def contexts(sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The token before each token; the start token at the beginning of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = _START
    return out


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = (u ^ (u >> _U(31))) * _U(0x9E3779B97F4A7C15) + v * _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(29)
    return h * _U(0xBF58476D1CE4E5B9)


def pair_shard(u: np.ndarray, v: np.ndarray, shards: int) -> np.ndarray:
    h = (u ^ ((v >> _U(60)) * _U(0xD6E8FEB86659FD93))) * _U(0xA0761D6478BD642F)
    return ((h >> _U(33)) % _U(shards)).astype(np.int64)


def word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _U(20)) % _U(shards)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes, so that leading zero bytes of small numbers cost nothing."""
    tool, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        packed = tool.compress(a.view(np.uint8).reshape(-1, 8).T.tobytes())
        out.append(np.array([len(a), len(packed)], "<u8").tobytes() + packed)
    return b"".join(out)


def _unpack(raw: bytes) -> list[np.ndarray]:
    tool, out, at = zstandard.ZstdDecompressor(), [], 0
    while at < len(raw):
        n, size = np.frombuffer(raw, "<u8", 2, at).tolist()
        at += 16
        planes = np.frombuffer(tool.decompress(raw[at : at + size], max_output_size=max(8 * n, 1)), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view("<u8") if n else np.zeros(0, "<u8"))
        at += size
    return out


def _gaps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=_U(0))


def _sorted_sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order with the sums of their values."""
    if not len(keys):
        return (keys, *values)
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[at], *(np.add.reduceat(v[by], at) for v in values))


def pack_pairs(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> bytes:
    """A run of distinct pairs with counts: contexts as gaps with lengths, words as numbers in a sorted list."""
    by = np.lexsort((v, u))
    u, v, n = u[by], v[by], n[by]
    at = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    names, number = np.unique(v, return_inverse=True)
    return _pack(_gaps(u[at]), np.diff(np.append(at, len(u))), _gaps(names), number, n)


def unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, lengths, names, number, n = _unpack(raw)
    return np.repeat(np.cumsum(u, dtype=_U), lengths.astype(np.int64)), np.cumsum(names, dtype=_U)[number.astype(np.int64)], n


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under its final name in one step, so that repeated attempts do no harm."""
    own = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, os.path.join(folder, f"{name}.npy"))


def _smallest(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _save_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """Counts as bytes; those of 255 and more in a list of their own."""
    large = np.flatnonzero(counts >= 255)
    _save(folder, f"{name}-n", np.minimum(counts, 255).astype(np.uint8))
    _save(folder, f"{name}-at", _smallest(large))
    _save(folder, f"{name}-large", _smallest(counts[large]))


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the few sums that all probabilities share."""

    folder: str
    shards: int
    word_shards: int
    train_tokens: int
    vocabulary: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float
    #: Entries of the arrays that were written, by shard; other shards are empty.
    pair_lengths: dict[int, int]
    word_lengths: dict[int, int]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of items seen once to four times; (0.5, 1, 1.5) if undefined."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c <= 0, 0.0, c - np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)])


def _folder(spark: SparkSession) -> str:
    where = urlparse(f"{scratch_dir(spark)}/language-model-{uuid.uuid4().hex}")
    if where.scheme not in ("", "file"):
        raise ValueError("arrays are memory-mapped: spark.checkpoint.dir must be a mounted folder (file: scheme)")
    path = unquote(where.path)
    os.makedirs(path, exist_ok=True)
    return path


def train(docs: DataFrame, learns: Callable[[int | None], bool] = in_training, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count the rows whose id ``learns`` accepts and store the model."""
    spark = docs.sparkSession
    folder = _folder(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    word_shards = max(1, shards // 4)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            pairs = [(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if learns(i)]
            for _, sizes, v in token_blocks([p[0] for p in pairs], [p[1] for p in pairs], known):
                u = contexts(sizes, v)
                _, at, n = np.unique(pair_hash(u, v), return_index=True, return_counts=True)
                u, v = u[at], v[at]
                shard = pair_shard(u, v, shards)
                by = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[by], np.arange(shards + 1))
                full = np.flatnonzero(np.diff(cuts))
                parts = [by[cuts[s] : cuts[s + 1]] for s in full]
                yield pa.RecordBatch.from_pydict({"shard": pa.array(full, pa.int32()), "run": pa.array([pack_pairs(u[p], v[p], n[p].astype(_U)) for p in parts], pa.binary())})

    def merge_pairs(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        u, v, n = (np.concatenate(x) for x in zip(*(unpack_pairs(r) for r in t.column("run").to_pylist()), strict=True))
        h = pair_hash(u, v)
        by = np.argsort(h, kind="stable")
        h = h[by]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        u, v, n, h = u[by][at], v[by][at], np.add.reduceat(n[by], at), h[at]
        _save(folder, f"pairs-{shard}", h)
        _save_counts(folder, f"pairs-{shard}", n)
        one = np.ones(len(n), _U)
        left = _sorted_sums(u, (n == 1).astype(_U), (n == 2).astype(_U), (n > 2).astype(_U), n)
        right = _sorted_sums(v, n, one)
        none_l, none_r = np.zeros(len(left[0]), _U), np.zeros(len(right[0]), _U)
        words, *fields = _sorted_sums(
            np.concatenate((left[0], right[0])),
            *(np.concatenate(p) for p in ((none_l, right[1]), (none_l, right[2]), (left[1], none_r), (left[2], none_r), (left[3], none_r), (left[4], none_r))),
        )
        to = word_shard(words, word_shards)
        own = np.unique(to).tolist()
        out = [_pack(_gaps(words[to == s]), *(f[to == s] for f in fields)) for s in own]
        c = [int((n == k).sum()) for k in range(1, 5)]
        first = [i == 0 for i in range(len(own))]
        wrote = {"origin": pa.array([shard if x else -1 for x in first], pa.int32()), "length": pa.array([len(h)] * len(own), pa.int64())}
        return pa.table({"shard": pa.array(own, pa.int32()), "run": pa.array(out, pa.binary()), **wrote, **{f"c{k}": pa.array([c[k - 1] if x else 0 for x in first], pa.int64()) for k in range(1, 5)}})

    def merge_words(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        parts = [_unpack(r) for r in t.column("run").to_pylist()]
        words, *fields = _sorted_sums(np.concatenate([np.cumsum(p[0], dtype=_U) for p in parts]), *(np.concatenate([p[k] for p in parts]) for k in range(1, 7)))
        _save(folder, f"words-{shard}", words)
        for name, f in zip(_FIELDS, fields, strict=True):
            _save(folder, f"words-{shard}-{name}", _smallest(f))
        tokens, before = fields[0], fields[1]
        sums = {f"c{k}": int(np.sum(t.column(f"c{k}").to_numpy())) for k in range(1, 5)}
        sums |= {f"w{k}": int((before == k).sum()) for k in range(1, 5)}
        sums |= {"w": int((before > 0).sum()), "tokens": int(tokens.sum()), "pairs": int(before.sum())}
        listed = [{"shard": a, "length": n} for a, n in zip(t.column("origin").to_pylist(), t.column("length").to_pylist(), strict=True) if a >= 0]
        files = {"wrote": pa.array([{"shard": shard, "length": len(words)}], _LISTED), "read": pa.array([listed], pa.list_(_LISTED))}
        return pa.table({**{k: pa.array([v], pa.int64()) for k, v in sums.items()}, **files})

    counts = ", ".join(f"c{k} long" for k in range(1, 5))
    merged = rows.mapInArrow(runs, "shard int, run binary").groupBy("shard").applyInArrow(merge_pairs, f"shard int, run binary, origin int, length long, {counts}")
    sums = merged.groupBy("shard").applyInArrow(merge_words, f"{counts}, w1 long, w2 long, w3 long, w4 long, w long, tokens long, pairs long, wrote struct<shard: int, length: long>, read array<struct<shard: int, length: long>>")
    lists = [F.collect_list("wrote").alias("wrote"), F.flatten(F.collect_list("read")).alias("read")]  # a row a shard, whose number is a setting
    total = sums.agg(*[F.sum(c).alias(c) for c in sums.columns if c not in ("wrote", "read")], *lists).first().asDict()
    words, pairs = ({r["shard"]: r["length"] for r in total.pop(c)} for c in ("wrote", "read"))
    total = {k: v or 0 for k, v in total.items()}
    word_d = discounts([total[f"w{k}"] for k in range(1, 5)])
    held = word_d[0] * total["w1"] + word_d[1] * total["w2"] + word_d[2] * (total["w"] - total["w1"] - total["w2"])
    rest = held / total["pairs"] if total["pairs"] else 1.0
    return Model(folder, shards, word_shards, total["tokens"], total["w"], total["pairs"], discounts([total[f"c{k}"] for k in range(1, 5)]), word_d, rest, pairs, words)


@lru_cache(maxsize=4096)
def _mapped(path: str, length: int | None = None) -> np.ndarray:
    """An array file, mapped; a missing file, or one that does not hold ``length`` entries, raises."""
    try:
        array = np.load(path, mmap_mode="r")
    except (FileNotFoundError, EOFError, ValueError) as e:
        raise RuntimeError(f"{path}: the model's array is gone or cut short; is the folder shared by all executors?") from e
    if length is not None and len(array) != length:
        raise RuntimeError(f"{path}: {len(array)} entries where the model lists {length}")
    return array


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of sorted ``wanted`` values in sorted ``keys``, and whether they are there."""
    at = np.searchsorted(keys, wanted)
    there = at < len(keys)
    there[there] = keys[at[there]] == wanted[there]
    return at, there


def _word_fields(m: Model, words: np.ndarray) -> dict[str, np.ndarray]:
    """The stored fields of sorted distinct words; zero where unknown."""
    out = {f: np.zeros(len(words), np.int64) for f in _FIELDS}
    shard = word_shard(words, m.word_shards)
    for s in np.unique(shard).tolist():
        if s not in m.word_lengths:  # no training word falls there
            continue
        keys = _mapped(f"{m.folder}/words-{s}.npy", m.word_lengths[s])
        own = np.flatnonzero(shard == s)
        at, there = _look_up(keys, words[own])
        for f in _FIELDS:
            out[f][own[there]] = _mapped(f"{m.folder}/words-{s}-{f}.npy", m.word_lengths[s])[at[there]]
    return out


def _pair_counts(m: Model, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    shard, h = pair_shard(u, v, m.shards), pair_hash(u, v)
    by = np.lexsort((h, shard))
    cuts = np.searchsorted(shard[by], np.arange(m.shards + 1))
    out = np.zeros(len(u), np.int64)
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        if s not in m.pair_lengths:  # no training pair falls there
            continue
        keys = _mapped(f"{m.folder}/pairs-{s}.npy", m.pair_lengths[s])
        own = by[cuts[s] : cuts[s + 1]]
        at, there = _look_up(keys, h[own])
        n = _mapped(f"{m.folder}/pairs-{s}-n.npy", m.pair_lengths[s])[at[there]].astype(np.int64)
        large = np.flatnonzero(n == 255)
        if large.size:
            where = np.searchsorted(_mapped(f"{m.folder}/pairs-{s}-at.npy"), at[there][large])
            n[large] = _mapped(f"{m.folder}/pairs-{s}-large.npy")[where]
        out[own[there]] = n
    return out


def token_scores(m: Model, sizes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: log10 of the model's probability, log10 of the add-one unigram probability, token count in training."""
    before = contexts(sizes, tokens)
    words, number = np.unique(np.concatenate((tokens, before)), return_inverse=True)
    f = _word_fields(m, words)
    v, u = number[: len(tokens)], number[len(tokens) :]
    low = (_discounted(f["before"], m.word_discounts) / max(m.pairs, 1) + m.word_rest / (m.vocabulary + 1)) if m.pairs else np.full(len(words), 1 / (m.vocabulary + 1))
    d = m.pair_discounts
    held = d[0] * f["once"] + d[1] * f["twice"] + d[2] * f["often"]
    follows = np.maximum(f["follows"], 1)
    back = np.where(f["follows"] > 0, held / follows, 1.0)
    high = _discounted(_pair_counts(m, before, tokens), d) / follows[u]
    base = np.log10((f["tokens"][v] + 1) / (m.train_tokens + m.vocabulary + 1))
    return np.log10(high + back[u] * low[v]), base, f["tokens"][v]


def score(docs: DataFrame, m: Model, learns: Callable[[int | None], bool] = in_training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (base 10 logs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            for ids, sizes, tokens in token_blocks(b.column(0).to_pylist(), b.column(1).to_pylist(), known):
                full, base, count = token_scores(m, sizes, tokens)
                at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                total = np.add.reduceat(full, at)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([not learns(i) for i in ids], pa.bool_()),
                    "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), at), pa.int64()),
                    "train_tokens": pa.array(np.full(len(ids), m.train_tokens), pa.int64()),
                    "base_score": np.add.reduceat(base, at), "score": total, "perplexity": 10 ** np.minimum(-total / sizes, 300),
                })

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
