"""Repeated passages from sparse suffix arrays.

Only suffixes at content-selected positions are kept (minimisers of ``k``-word windows over ``span`` windows), so the array
holds about ``2 / (span + 1)`` of all suffixes, and every window of ``least`` words has one of them, picked by its words
alone.  Windows whose anchor occurs elsewhere are then keyed by all their words, sorted, and each is linked to the nearest
equal one before it of another document: equal windows are interchangeable, so every window that some other document
holds is linked to a holder, whatever other documents share on either side.  Links are extended word by word to
the left and right on the texts themselves, which also verifies them.

Result: maximal matches of ``least`` words or more, with the word positions on both sides, between class representatives
(per pair of documents as many as cover all words that its matches cover on either side); a member of a class of equal texts gets one row for its whole text against its representative.

Defined results: see ``passages``; repeated rows of one id count once, and if an id has several texts each is compared;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.llm import passages

SCHEMA = "doc_id long, start long, n_words long, other_id long, other_start long"


def extended(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Maximal equal stretches (start in a, start in b, length) around seeds, of ``least`` words or more.

    Texts that repeat themselves match along many diagonals; longest first, a stretch is left out if others cover
    all its words on both sides.
    """
    out = set()
    for shift in {y - x for x, y in seeds}:
        lo, hi = max(0, -shift), min(len(a), len(b) - shift)
        if hi - lo < least:
            continue
        breaks = np.flatnonzero(a[lo:hi] != b[lo + shift : hi + shift])
        edges = np.concatenate(([-1], breaks, [hi - lo]))
        xs = np.unique([x for x, y in seeds if y - x == shift]) - lo
        xs = xs[(xs >= 0) & (xs < hi - lo)]
        at = np.unique(np.searchsorted(edges, xs, side="right"))
        for left, right in zip(edges[at - 1].tolist(), edges[np.minimum(at, len(edges) - 1)].tolist(), strict=True):
            if right - left - 1 >= least:
                out.add((left + 1 + lo, left + 1 + lo + shift, right - left - 1))
    in_a, in_b, kept = np.zeros(len(a), bool), np.zeros(len(b), bool), []
    for x, y, n in sorted(out, key=lambda m: (-m[2], m[0], m[1])):
        if not (in_a[x : x + n].all() and in_b[y : y + n].all()):
            kept.append((x, y, n))
            in_a[x : x + n], in_b[y : y + n] = True, True
    return sorted(kept)


def anchors(texts: DataFrame, least: int, k: int, span: int) -> DataFrame:
    """(seed, doc_id, first, last): the minimiser of every ``least``-word window, with the windows (by start) that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = passages.WordHashes()
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = known.of(raw)
                n = len(words) - least + 1
                if n <= 0:
                    continue
                hashes = passages.window_hashes(words, k)
                picks = np.lib.stride_tricks.sliding_window_view(hashes, span)[:n].argmin(axis=1) + np.arange(n)
                # a run of equal windows counts as its first
                runs = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
                at, first = np.unique(runs[np.searchsorted(runs, picks, side="right") - 1], return_index=True)
                for col, x in zip(cols, (hashes[at].view(np.int64), np.full(len(at), doc, np.int64), first.astype(np.int32), (np.append(first[1:], n) - 1).astype(np.int32)), strict=True):
                    col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["seed", "doc_id", "first", "last"])

    return texts.mapInArrow(run, "seed long, doc_id long, first int, last int")


def shared_windows(texts: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """(seed, doc_id, pos) of the ``least``-word windows whose anchor occurs elsewhere; the seed is the whole window's hash."""
    order = ["seed", "doc_id", "first"]

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(0).to_numpy()
            # seeds at the ends of a batch may go on in the next one; a row too many is harmless
            keep = (s == s[:1]) | (s == s[-1:])
            keep[1:] |= s[1:] == s[:-1]
            keep[:-1] |= s[1:] == s[:-1]
            yield b.filter(pa.array(keep)).select(["doc_id", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = passages.WordHashes()
        for b in batches:
            for doc, packed, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                hashes = passages.window_hashes(known.of(passages.unpack(packed)), least)
                wanted = np.zeros(len(hashes), bool)
                for s in spans:
                    wanted[s["first"] : s["last"] + 1] = True
                pos = np.flatnonzero(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes[pos].view(np.int64), np.full(len(pos), doc, np.int64), pos.astype(np.int32))], ["seed", "doc_id", "pos"])

    dealt = passages.materialize(rows, "anchors").repartitionByRange(*order).sortWithinPartitions(*order)
    found = dealt.mapInArrow(repeated, "doc_id long, first int, last int").groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    found = passages.materialize(found, "anchored-docs")
    packed = passages.packed_texts(texts).join(found, "doc_id")
    return packed.select("doc_id", "packed", "spans").mapInArrow(run, "seed long, doc_id long, pos int")


def repeated_passages(docs: DataFrame, least: int = 50, k: int = 20, span: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_words, other_id, other_start): words that a document shares with one of smaller id."""
    if k + span - 1 > least:
        raise ValueError("k + span - 1 must not exceed the least length, or matches would be missed")
    members = passages.text_classes(docs, id_col, text_col)
    texts = passages.texts_of(docs, id_col, text_col)
    rows = passages.without_members(anchors(texts, least, k, span), members)
    links = passages.neighbour_links(shared_windows(texts, rows.select("seed", "doc_id", "first", "last"), least))
    # windows of one diagonal less than their length apart lie in one stretch
    shift, block = (F.col("pos_b") - F.col("pos_a")).alias("shift"), F.floor(F.col("pos_a") / least).alias("block")
    links = links.groupBy("doc_a", "doc_b", shift, block).agg(F.min("pos_a").alias("pos_a")).withColumn("pos_b", F.col("pos_a") + F.col("shift"))
    pairs = passages.document_pairs(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = passages.WordHashes()
        for b in batches:
            out = []
            for lo, hi, seeds, ta, tb in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                x, y = known.of(passages.unpack(ta)), known.of(passages.unpack(tb))
                out += [(hi, q, n, lo, p) for p, q, n in extended(x, y, [(s["x"], s["y"]) for s in seeds], least)]
            names = ["doc_id", "start", "n_words", "other_id", "other_start"]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(names)})

    found = passages.with_texts(pairs, texts).mapInArrow(run, SCHEMA)
    zero = F.lit(0).cast("long")
    copies = members.where(F.col("n_words") >= least).select("doc_id", zero.alias("start"), "n_words", F.col("rep").alias("other_id"), zero.alias("other_start"))
    return found.union(copies).distinct()
