"""Document fingerprints by context-triggered piecewise hashing, and their likeness.

A rolling hash over seven bytes cuts a text into chunks wherever it meets the block size's pattern, so a cut depends on the
bytes next to it only and chunks away from an edit stay as they are.  Every chunk gives one symbol of twelve bits (two base-64
characters).  The block size doubles with the text's length so that a text has about ``CHUNKS`` chunks; the fingerprint holds
the symbols for that size and for twice it: ``size:symbols:symbols``.  Two fingerprints are compared where they share a
block size, by edit distance (a replacement counts as a deletion and an insertion), scaled to 0..1.

Neighbours in the order of ids: texts move once.  Ids and text hashes alone are read first; quantiles of the ids give
parts, and the first row of every part is dealt to the part before as well, as a guest.  A sorted part then holds each row
beside its successor.  An id that fills several parts by itself (a null id, say) is spread over them by text hash.

Defined results: null text counts as empty; two empty texts have likeness 1, an empty and another text 0; null ids
come first; rows of equal id are ordered by text hash, and rows equal in both lie in one part; a single row is its own
successor; very long texts are hashed in blocks, whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.functions.scratch import materialize
from spotloom.functions.text import bind, text_of

WINDOW, CHUNKS, SMALLEST = 7, 64, 3
_CODES = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables["up"]) < n:
        size = 1 << max(14, (n - 1).bit_length())
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables["up"], _tables["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _rolling(data: np.ndarray) -> np.ndarray:
    """For every byte from the ``WINDOW``-th on, a mixed hash of the ``WINDOW`` bytes that end there."""
    total = np.zeros(len(data) - WINDOW + 1, dtype=np.uint64)
    for j in range(WINDOW):
        total = total * np.uint64(0x100000001B3) + data[j : j + len(total)]
    return _mixed(total)


def _power_of(n: np.ndarray) -> np.ndarray:
    """The base to the power of each ``n``, by squaring."""
    out, square, n = np.ones(len(n), np.uint64), _BASE, n.copy()
    while n.any():
        out = np.where(n & 1, out * square, out)
        square, n = square * square, n >> 1
    return out


def _cuts(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomial hash and length of each chunk of ``raw`` at block size ``size`` (the rest after the last cut included),
    and whether it ends where the pattern of twice the size is met too."""
    parts, lengths, wide = [], [], []
    carry, carried = np.uint64(0), 0  # hash and length of the chunk that is open
    for start in range(0, len(raw), _BLOCK):
        count = min(_BLOCK, len(raw) - start)
        data = np.frombuffer(raw, dtype=np.uint8, offset=start, count=count).astype(np.uint64)
        back = min(start, WINDOW - 1)
        seen = np.frombuffer(raw, dtype=np.uint8, offset=start - back, count=back + count).astype(np.uint64)
        rolled = _rolling(np.concatenate((np.zeros(WINDOW - 1 - back, np.uint64), seen)))
        ends = np.flatnonzero(rolled % np.uint64(size) == np.uint64(size - 1)) + 1
        up, down = _power_tables(count + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up[:count], dtype=np.uint64)))
        starts, stops = np.append(0, ends), np.append(ends, count)
        found, long = (sums[stops] - sums[starts]) * down[starts], stops - starts
        found[0] = carry + found[0] * _power_of(np.array([carried]))[0]  # its bytes stand behind the carried ones
        long[0] += carried
        carry, carried = found[-1], int(long[-1])
        parts.append(found[:-1])
        lengths.append(long[:-1])
        wide.append(rolled[ends - 1] % np.uint64(2 * size) == np.uint64(2 * size - 1))
    if carried:
        parts.append(np.array([carry]))
        lengths.append(np.array([carried]))
        wide.append(np.array([False]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(parts), np.concatenate(lengths), np.concatenate(wide)


def _joined_up(parts: np.ndarray, lengths: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and length of the chunks at twice the block size, put together from those at the single size."""
    if not len(parts):
        return parts, lengths
    ends = np.flatnonzero(np.append(wide[:-1], True))  # the text's end closes the last one
    starts = np.append(0, ends[:-1] + 1)
    before = np.cumsum(lengths) - lengths
    place = before - np.repeat(before[starts], ends - starts + 1)
    return np.add.reduceat(parts * _power_of(place), starts), np.add.reduceat(lengths, starts)


def _symbols(parts: np.ndarray, lengths: np.ndarray) -> str:
    codes = (_mixed(parts + lengths.astype(np.uint64)) >> np.uint64(52)).astype(np.int64)
    return np.stack((_CODES[codes >> 6], _CODES[codes & 63]), axis=1).tobytes().decode()


def block_size(n_bytes: int) -> int:
    size = SMALLEST
    while size * CHUNKS < n_bytes:
        size *= 2
    return size


def fingerprint(raw: bytes) -> str:
    """``size:symbols:symbols`` of the UTF-8 bytes of a text."""
    size = block_size(len(raw))
    with np.errstate(over="ignore"):
        parts, lengths, wide = _cuts(raw, size)
        while len(parts) < CHUNKS // 4 and size > SMALLEST:  # a repetitive text meets the pattern too rarely
            size //= 2
            parts, lengths, wide = _cuts(raw, size)
        return f"{size}:{_symbols(parts, lengths)}:{_symbols(*_joined_up(parts, lengths, wide))}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a machine word or more of it at a time."""
    at: dict[str, int] = {}
    for i, symbol in enumerate(a):
        at[symbol] = at.get(symbol, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for symbol in b:
        hit = row & at.get(symbol, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def likeness(one: str, other: str) -> float:
    """1 - (edit distance / symbols of both), at the block size where two fingerprints agree best; 0 if they share none."""
    if one == other:
        return 1.0
    (size_a, *a), (size_b, *b) = one.split(":"), other.split(":")
    found = 0.0
    for i, size in ((0, int(size_a)), (1, 2 * int(size_a))):
        j = 0 if size == int(size_b) else 1 if size == 2 * int(size_b) else None
        if j is not None and a[i] and b[j]:
            left, right = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (a[i], b[j]))
            found = max(found, 2 * _common(left, right) / (len(left) + len(right)))
    return found


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, guest, doc_id, raw), sorted: results of each row that is no guest, from it and the row after it."""
    last: tuple | None = None

    def result(row: tuple, text: str, mark: str) -> tuple:
        own, doc_id, own_mark = row
        changed = edited(own, text)
        same = changed == own
        raw = b"" if same else changed.encode()
        new_mark = own_mark if same else fingerprint(raw)
        sha = hashlib.sha256(own.encode() if same else raw).hexdigest()
        return doc_id, len(own), sha, own_mark, new_mark, likeness(own_mark, new_mark), likeness(own_mark, mark)

    part = None
    for batch in batches:
        out = []
        for p, guest, doc_id, raw in zip(*(batch.column(i) for i in range(4))):
            data = raw.as_py()
            text, mark = data.decode(), fingerprint(data)
            if last is not None and p.as_py() == part:
                out.append(result(last, text, mark))
            last, part = (None if guest.as_py() else (text, doc_id.as_py(), mark)), p.as_py()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        cols = zip(*out) if out else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], [c.split()[0] for c in _RESULT.split(", ")])


def _below(edges: Column, n: int, value: Column) -> Column:
    """How many of ``n`` ascending edges lie below ``value``, by halving."""

    def further(step: int):
        return lambda at: F.when((at + step <= n) & (F.get(edges, at + step - 1) < value), at + step).otherwise(at)

    at = F.lit(0)
    for bit in reversed(range(n.bit_length())):
        at = bind(at, further(1 << bit))
    return at


def _longs(values: list) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]).cast("array<long>")


def _part(ids: DataFrame, parts: int) -> Column:
    """The part of a row (doc_id, h): parts ascend with (doc_id, h), nulls first, and have rows alike in number."""
    shares = [i / parts for i in range(1, parts)] or [0.5]
    got = ids.agg(F.percentile_approx("doc_id", shares, 20 * parts).alias("q"), F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    fills: dict[int, int] = {}
    for edge in got.q or []:
        fills[edge] = fills.get(edge, 0) + 1
    edges = sorted(fills)
    nulls = max(1, round(parts * (got["all"] - got.n) / max(1, got["all"])))
    first, own = [nulls], []  # first part of each interval; parts of the id at its upper edge, if that fills several
    for edge in edges:
        own.append(fills[edge] if fills[edge] > 1 else 0)
        first.append(first[-1] + 1 + own[-1])
    unit = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    inside = lambda n: F.least(F.floor(unit * n), n - 1)

    def of(at: Column) -> Column:
        hot = (F.get(_longs(own), at) > 0) & (F.get(_longs(edges), at) == F.col("doc_id"))
        return F.get(_longs(first), at) + F.when(hot, 1 + inside(F.get(_longs(own), at))).otherwise(0)

    ordinary = bind(_below(_longs(edges), len(edges), F.col("doc_id")), of)
    return F.when(F.col("doc_id").isNull(), inside(F.lit(nulls))).otherwise(ordinary).cast("long")


def likenesses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts_a_task: int = 4) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = materialize(rows.select("doc_id", "h"), "piecewise-ids")
    part = _part(ids, parts_a_task * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heads = ids.withColumn("part", part).groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("head")).orderBy("part").collect()  # a row a part
    size = heads[-1].part + 1 if heads else 1
    head_id, head_h, before = ([None] * size for _ in range(3))
    for i, r in enumerate(heads):
        head_id[r.part], head_h[r.part], before[r.part] = r.head.doc_id, r.head.h, heads[i - 1].part
    at = F.col("part").cast("int")
    is_head = F.col("doc_id").eqNullSafe(F.get(_longs(head_id), at)) & (F.col("h") == F.get(_longs(head_h), at))
    stay = F.struct(F.col("part").alias("to"), F.lit(False).alias("guest"))
    go = F.struct(F.get(_longs(before), at).alias("to"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("part", part).withColumn("place", F.explode(F.when(is_head, F.array(stay, go)).otherwise(F.array(stay))))
    keys = [F.asc_nulls_first(c) for c in ("part", "guest", "doc_id", "h")]
    dealt = dealt.select(F.col("place.to").alias("part"), F.col("place.guest").alias("guest"), "doc_id", "h", F.col("text").cast("binary").alias("raw"))
    ordered = dealt.repartition("part").sortWithinPartitions(*keys)
    return ordered.select("part", "guest", "doc_id", "raw").mapInArrow(_beside, _RESULT)
