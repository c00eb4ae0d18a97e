"""SimHash near-dedup through an inverted index on byte positions.

Two 64-bit fingerprints within three bits agree in at least five of their eight positional bytes.  Plain postings of
single bytes would pair a 256th of the corpus with every row, so the index is keyed by small *sets* of positions
chosen such that five agreeing bytes always hold one set in full: the eight triples inside either half.  A pair met in a
posting list is tallied (how many positional bytes agree), kept from five on, and verified by its bit count.

Posting lists longer than ``list_limit`` are not paired.  They are refined to all five-byte sets that hold the triple,
which loses no pair, and lists that are long even then are linked through hubs: a hub is any value that differs from
a member in at most one bit of the three free bytes, or at most two; every value of the second kind is within three
bits of every value of the first, so linking all of a hub's members to one of the first kind is exact for components
and linear in the list's length.

Equal fingerprints are one node, so copies are never paired with each other.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any other; rows
with null ids take part and get the component's smallest id; repeated rows repeat in the result; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.functions.scratch import materialize
from spotloom.llm.components import connected_components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(raw: bytes, width: int = 3) -> int:
    """SimHash of the words of a UTF-8 text: majority bits of XXH64 (seed 42) over its ``width``-word shingles."""
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())]
    bits = np.unpackbits(np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp, row_no) for every row, fp being the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_py() or b"", width) for x in b.column(1)]  # one text in Python at a time
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return cols.mapInArrow(run, "doc_id long, fp long").withColumn("row_no", F.monotonically_increasing_id())


def fingerprint_of(text: Column, width: int = 3) -> Column:
    """The fingerprint as a column expression, for a few rows that are looked up again."""

    @F.pandas_udf("long")
    def of_text(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint((t or "").encode(), width) for t in texts], dtype="int64")

    return of_text(text.cast("string"))


def _mask(positions) -> int:
    value = sum(255 << (8 * p) for p in positions)
    return value - (1 << 64) if value >> 63 else value


_TRIPLES = [_mask(c) for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
_FIVES = [_mask(c) for c in combinations(range(8), 5)]


def _keyed(rows: DataFrame, masks: list[int]) -> DataFrame:
    parts = [F.struct(F.lit(m).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for m in masks]
    return rows.select("fp", F.explode(F.array(*parts)).alias("e")).select("e.mask", "e.key", "fp")


def _pairs(lists: DataFrame, bits: int) -> DataFrame:
    """Verified pairs of each posting list: tally of shared positional bytes, then the bit count."""
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    tally = sum(F.when(diff.bitwiseAND(F.lit(_mask([p])).cast("long")) == 0, 1).otherwise(0) for p in range(8))
    match = (F.col("a.mask") == F.col("b.mask")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    return lists.alias("a").join(lists.alias("b"), match & (tally >= 8 - bits) & (F.bit_count(diff) <= bits)).select(
        F.col("a.fp").alias("u"), F.col("b.fp").alias("v")
    )


def _sized(lists: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Posting lists of two or more rows, apart by whether they are longer than ``limit``."""
    sizes = lists.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = materialize(lists.join(sizes, ["mask", "key"]), "postings")
    return known.where(F.col("n") <= limit).drop("n"), known.where(F.col("n") > limit).drop("n")


def _hubs(lists: DataFrame) -> DataFrame:
    """Links of long five-byte lists through hub values; see the module's text."""
    flips = [1 << b for b in range(64)]
    free = [f - (1 << 64) if f >> 63 else f for f in flips]
    loose = F.array(*[F.lit(f).cast("long") for f in free])
    loose = F.filter(loose, lambda f: f.bitwiseAND(F.col("mask")) == 0)
    rows = lists.select("mask", "fp", loose.alias("free"))
    one = F.concat(F.array(F.lit(0).cast("long")), F.col("free"))
    two = F.flatten(F.transform("free", lambda f, i: F.transform(F.slice("free", i + 2, F.size("free")), lambda g: f.bitwiseXOR(g))))
    near = rows.select("mask", "fp", F.explode(one).alias("d"), F.lit(True).alias("near"))
    far = rows.select("mask", "fp", F.explode(two).alias("d"), F.lit(False).alias("near"))
    at = near.union(far).select("mask", F.col("fp").bitwiseXOR(F.col("d")).alias("hub"), "fp", "near")
    centre = at.where("near").groupBy("mask", "hub").agg(F.min("fp").alias("u"))
    return at.join(centre, ["mask", "hub"]).where("u <> fp").select("u", F.col("fp").alias("v")).distinct()


def fingerprint_links(fps: DataFrame, bits: int = 3, list_limit: int = 1024) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of distinct fingerprints within ``bits`` (at most 3)."""
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees pairs of up to three differing bits")
    short, long = _sized(_keyed(fps, _TRIPLES), list_limit)
    found = _pairs(short, bits)
    if not long.isEmpty():
        wide = [F.when(F.col("mask").bitwiseAND(F.lit(m).cast("long")) == F.col("mask"), F.lit(m).cast("long")) for m in _FIVES]
        fives = long.select("fp", F.explode(F.array_compact(F.array(*wide))).alias("mask")).distinct()
        short, long = _sized(fives.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"), list_limit)
        found = found.union(_pairs(short, bits))
        if not long.isEmpty():
            if bits < 3:
                raise ValueError("hubs link pairs within three bits; raise list_limit for fewer bits")
            found = found.union(_hubs(long))
    return found


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3, list_limit: int = 1024) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id, component_size (rows),
    kept (true for one row of each component), fp."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_no")))
    nodes = materialize(rows.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "fp-nodes")
    groups = connected_components(fingerprint_links(nodes.select("fp"), bits, list_limit))
    joined = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    sums = joined.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("component_size")).where("component_size > 1")
    labels = joined.select("fp", "component").join(sums, "component")
    labels = materialize(labels.select("fp", F.col("first.doc_id").alias("first_id"), F.col("first.row_no").alias("first_row"), "component_size"), "fp-labels")
    alone = F.col("component_size").isNull()
    return rows.join(labels, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("component_id"),
        F.coalesce("component_size", F.lit(1)).cast("long").alias("component_size"),
        (alone | (F.col("row_no") == F.col("first_row"))).alias("kept"),
        "fp",
    )
