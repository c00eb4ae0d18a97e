"""What the passage operators share: text classes, sampled k-word seeds, links inside seed groups, and texts of linked rows.

Equal texts form a class whose smallest id stands for it; the others are members and take no part in the search.
Seeds are sampled by content: a k-word window is kept if its hash is a multiple of ``rate``, so a window that two texts share
is kept in both or in neither, however short the unedited stretch around it.  ``all_links`` links every pair of documents of a
seed, in blocks, ``linked_pairs`` finds the pairs that two links tie, ``passage_pairs`` those of them that may share a passage.  ``neighbour_links`` sorts seeds over range partitions (a hot seed may cover many of them), those of equal
hash by the words around them, and links each to the ``reach`` nearest occurrences before it in other documents, in time
and space linear in the group's size.

Rows with null ids or null texts, and texts without words, take part in nothing and give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.scratch import discard, materialize
from spotloom.functions.text import words_of

_BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to 300,000 words at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, raw: bytes) -> np.ndarray:
        words = raw.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * n, base))), dtype=np.uint64)
    return _powers


def running_hash(words: np.ndarray) -> np.ndarray:
    """Sums of the words times powers of the base, from the first word on."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers_to(len(words) + 1)[0][: len(words)], dtype=np.uint64)))


def window_hashes(words: np.ndarray, k: int, upto: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every k consecutive words: differences of one running sum (``upto``), whatever k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    upto = running_hash(words) if upto is None else upto
    total = (upto[k:] - upto[:-k]) * _powers_to(len(words) + 1)[1][:n]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Members of text classes other than the smallest id: (doc_id, rep, n_words, alone), ``alone`` if the id has no other text."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropna()
    rows = materialize(rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.size(words_of(text)).cast("long").alias("n_words")), "text-digests")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = rows.join(groups, "digest").where("doc_id <> rep").select("doc_id", "rep", "n_words").distinct()
    several = rows.groupBy("doc_id").agg((F.min("digest") == F.max("digest")).alias("alone"))
    return materialize(members.join(several, "doc_id").select("doc_id", "rep", "n_words", "alone"), "text-members")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, raw): ids and UTF-8 texts without nulls."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw")).dropna()


def without_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` (doc_id and more) of documents whose only text is not a copy of another document's."""
    return rows.join(members.where("alone").select("doc_id"), "doc_id", "left_anti")


_NEAR, _WIDE = 12, 24


def seed_rows(words: np.ndarray, k: int, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions of a text's sampled windows; of equal ones the first and the last.

    The upper 48 bits of a key are the window's hash, the lower ones hashes of the 12 and 24 words that begin with it
    (even hashes) or end with it (odd ones), so that rows of a seed sort by context on either side.
    """
    upto = running_hash(words)
    h = window_hashes(words, k, upto)
    at = np.flatnonzero(h % np.uint64(rate) == 0)
    if not at.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    by = np.argsort(h[at], kind="stable")
    change = h[at[by[1:]]] != h[at[by[:-1]]]
    at = at[by[np.concatenate(([True], change)) | np.append(change, True)]]
    key, side = h[at], (h[at] >> np.uint64(16)) & np.uint64(1) == 1
    mark = np.zeros(len(at), np.uint64)
    for n, low in ((_NEAR, np.uint64(8)), (_WIDE, np.uint64(0))):
        longer = window_hashes(words, n, upto)
        begin = np.where(side, at + k - n, at)
        ok = (begin >= 0) & (begin < len(longer))
        mark[ok] |= (longer[begin[ok]] >> np.uint64(56)) << low
    return ((key >> np.uint64(16) << np.uint64(16)) | mark).view(np.int64), at.astype(np.int32)


def seeds(texts: DataFrame, k: int, rate: int) -> DataFrame:
    """(seed, doc_id, pos) of the sampled windows of ``texts`` (doc_id, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            ids, poss, vals = [], [], []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key, at = seed_rows(known.of(raw), k, rate)
                ids.append(np.full(len(at), doc, np.int64))
                poss.append(at)
                vals.append(key)
            if ids:
                yield pa.RecordBatch.from_pydict({"seed": np.concatenate(vals), "doc_id": np.concatenate(ids), "pos": np.concatenate(poss)})

    return texts.mapInArrow(run, "seed long, doc_id long, pos int")


#: Kinds of window: not sampled (there only because a frequent seed is near), sampled, sampled and in the list of frequent ones.
CLOSE, SAMPLED, FREQUENT = 0, 1, 2


def frequent_seeds(texts: DataFrame, k: int, rate: int, often: int, most: int = 200_000) -> np.ndarray:
    """Sorted seeds (without context) that about ``often`` rows or more have, counted in an eighth of the documents (in all of them below 256).

    The list decides how the pairs of a seed are found, not which, so neither the estimate nor ``most``, the seeds that the driver holds, loses any."""
    share = 8 if often >= 256 else 1
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    counts = seeds(some, k, rate).groupBy(F.shiftright("seed", 16).alias("seed")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often / share)
    return np.sort(np.array([r.seed for r in counts.orderBy(F.desc("n"), "seed").limit(most).collect()], np.int64))


def _listed(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def windows_near(h: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """Places of the windows ``h`` within ``reach`` of the places ``at`` (sorted); of equal ones of a stretch the first and the last."""
    out = []
    cut = np.flatnonzero(np.diff(at) > 2 * reach) + 1
    for part in np.split(at, cut):
        low, high = max(0, int(part[0]) - reach), min(len(h), int(part[-1]) + reach + 1)
        near = np.zeros(high - low, bool)
        for p in part.tolist():
            near[max(0, p - reach - low) : p + reach + 1 - low] = True
        place = low + np.flatnonzero(near)
        by = place[np.argsort(h[place], kind="stable")]
        change = h[by[1:]] != h[by[:-1]]
        out.append(by[np.concatenate(([True], change)) | np.append(change, True)])
    return np.concatenate(out)


def seeds_about(texts: DataFrame, k: int, rate: int, frequent: np.ndarray, reach: int) -> DataFrame:
    """(seed without context, kind, doc_id, pos): the sampled windows of ``texts`` and every window within ``reach`` of one that is ``frequent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            ids, poss, vals, kinds = [], [], [], []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = known.of(raw)
                key, at = seed_rows(words, k, rate)
                seed = key >> np.int64(16)
                hot = _listed(seed, frequent)
                kind = np.where(hot, FREQUENT, SAMPLED)
                if hot.any():
                    h = window_hashes(words, k)
                    more = np.setdiff1d(windows_near(h, np.sort(at[hot]), reach), at)
                    also = h[more].view(np.int64) >> np.int64(16)
                    of = np.where(h[more] % np.uint64(rate) != 0, CLOSE, np.where(_listed(also, frequent), FREQUENT, SAMPLED))
                    seed, at, kind = np.concatenate((seed, also)), np.concatenate((at, more.astype(np.int32))), np.concatenate((kind, of))
                ids.append(np.full(len(at), doc, np.int64))
                poss.append(at)
                vals.append(seed)
                kinds.append(kind.astype(np.int32))
            if ids:
                yield pa.RecordBatch.from_pydict({"seed": np.concatenate(vals), "kind": np.concatenate(kinds), "doc_id": np.concatenate(ids), "pos": np.concatenate(poss)})

    return texts.mapInArrow(run, "seed long, kind int, doc_id long, pos int")


def linked(seed: np.ndarray, doc: np.ndarray, pos: np.ndarray, reach: int, context_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, earlier row) numbers of the links inside sorted rows.

    Rows of one seed and document form a run.  A row is linked to the last row of each of the ``reach`` runs before its
    own that belong to the same group (seed without context) and another document; rows of a group's first run to
    the first row of the next.
    """
    n = len(seed)
    index, group = np.arange(n), seed >> np.int64(context_bits)
    starts = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1]))))
    ends = np.append(starts[1:], n) - 1
    run = np.repeat(np.arange(len(starts)), ends - starts + 1)
    rows, others = [], []
    for s in range(1, reach + 1):
        there = run >= s
        i, o = index[there], ends[run[there] - s]
        ok = (group[i] == group[o]) & (doc[i] != doc[o])
        rows.append(i[ok])
        others.append(o[ok])
    of_run = group[starts]
    again = of_run[1:] == of_run[:-1]
    lead = np.concatenate(([True], ~again)) & np.append(again, False)
    own = lead[run] & (index != ends[run])
    i, o = index[own], starts[run[own] + 1]
    ok = doc[i] != doc[o]
    rows.append(o[ok])
    others.append(i[ok])
    return np.concatenate(rows), np.concatenate(others)


def neighbour_links(rows: DataFrame, reach: int = 1, context_bits: int = 0) -> DataFrame:
    """(doc_a, pos_a, doc_b, pos_b): links of ``linked`` between all ``rows`` (seed, doc_id, pos), wherever partitions end."""
    order = ["seed", "doc_id", "pos"]
    table = materialize(rows.select(*order), "seeds")
    dealt = table.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.Table | None = None

        def blocks() -> Iterator[tuple[pa.Table, bool]]:
            """Batches cut where the group changes, so that a group is whole unless it is hot."""
            nonlocal held
            for b in batches:
                t = pa.Table.from_batches([b])
                held = t if held is None else pa.concat_tables([held, t])
                g = held.column("seed").to_numpy() >> np.int64(context_bits)
                hot = g[0] == g[-1]
                cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if not hot else len(g) if len(g) > 500_000 else 0
                if cut:
                    whole, held = held.slice(0, cut), held.slice(cut) if cut < len(g) else None
                    yield whole, hot
            if held is not None and held.num_rows:
                yield held, True

        carry, first = None, True
        for block, hot in blocks():
            new = [block.column(c).to_numpy() for c in order]
            kept = 0 if carry is None else len(carry[0])
            seed, doc, pos = new if carry is None else [np.concatenate(x) for x in zip(carry, new, strict=True)]
            i, o = linked(seed, doc, pos, reach, context_bits)
            fresh = np.maximum(i, o) >= kept
            i, o = i[fresh], o[fresh]
            yield _link_batch(0, part, seed[i], doc[o], pos[o], doc[i], pos[i])
            starts = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1]))))
            if first:  # the group may go on from the partition before
                end = starts[reach] if len(starts) > reach else len(seed)
                yield _edge_batch(part, seed[:end], doc[:end], pos[:end])
                first = False
            # last rows of the runs that later rows may be linked to, and the last run whole
            last = np.append(starts[1:], len(seed)) - 1
            keep = np.unique(np.concatenate((last[-reach - 1 :], np.arange(starts[-1], len(seed)))))
            carry = [x[keep] for x in (seed, doc, pos)] if hot else None
        if carry is not None:
            yield _edge_batch(part, *carry)

    found = materialize(dealt.mapInArrow(run, "kind int, part int, seed long, doc_a long, pos_a int, doc_b long, pos_b int"), "links")
    discard(table)

    def across(t: pa.Table) -> pa.Table:
        """Links between the edges of partitions that one group covers: a few rows a partition."""
        seed, doc, pos, part = (t.column(c).to_numpy() for c in ("seed", "doc_b", "pos_b", "part"))
        by = np.lexsort((part, pos, doc, seed))
        by = by[np.concatenate(([True], np.any([x[by][1:] != x[by][:-1] for x in (seed, doc, pos, part)], axis=0)))]
        seed, doc, pos, part = seed[by], doc[by], pos[by], part[by]
        i, o = linked(seed, doc, pos, reach, context_bits)
        other = part[i] != part[o]
        i, o = i[other], o[other]
        return pa.table({"doc_a": doc[o], "pos_a": pos[o], "doc_b": doc[i], "pos_b": pos[i]})

    links = ["doc_a", "pos_a", "doc_b", "pos_b"]
    edges = found.where("kind = 1").withColumn("group", F.shiftright("seed", context_bits))
    spread = edges.groupBy("group").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("group")
    joined = edges.join(spread, "group").groupBy("group").applyInArrow(across, "doc_a long, pos_a int, doc_b long, pos_b int")
    return found.where("kind = 0").select(*links).union(joined.select(*links))


def shared_seeds(rows: DataFrame, context_bits: int = 16) -> DataFrame:
    """(seed, doc_id, pos, n): ``rows`` (seed, doc_id, pos) of groups (seeds without context) of two documents or more, n rows being in the group."""
    table = materialize(rows.select(F.shiftright("seed", context_bits).alias("seed"), "doc_id", "pos"), "seeds")
    several = table.groupBy("seed").agg((F.min("doc_id") < F.max("doc_id")).alias("several"), F.count(F.lit(1)).alias("n")).where("several").drop("several")
    kept = materialize(table.join(several, "seed"), "shared-seeds")
    discard(table)
    return kept


def _met(rows: DataFrame, block: int, columns: list[str]) -> DataFrame:
    """Pairs of two documents of one seed: (doc_a, pos_a, doc_b, pos_b), doc_a being smaller, and ``columns`` of either with a_ and b_.

    A frequent group's rows are dealt to blocks of about ``block``; a join task meets one block with the group, not its square."""
    named = lambda t: [F.col("doc_id").alias(f"doc_{t}"), F.col("pos").alias(f"pos_{t}"), *[F.col(c).alias(f"{t}_{c}") for c in columns]]
    dealt = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    a = dealt.select("seed", *named("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    b = dealt.select("seed", *named("b"), F.pmod(F.xxhash64("doc_id", "pos"), F.col("blocks")).cast("int").alias("block"))
    return a.join(b, ["seed", "block"]).where("doc_a < doc_b")


def all_links(rows: DataFrame, context_bits: int = 16, block: int = 512) -> DataFrame:
    """(doc_a, pos_a, doc_b, pos_b): every pair of ``rows`` (seed, doc_id, pos) of one group (seed without context) and two documents."""
    return _met(shared_seeds(rows, context_bits), block, []).select("doc_a", "pos_a", "doc_b", "pos_b")


def linked_pairs(rows: DataFrame, spread: int, drift: int, often: int = 1024, context_bits: int = 16, block: int = 512) -> DataFrame:
    """(lo, hi): the ``collinear_pairs`` of ``all_links``, with fewer links of frequent seeds.

    Two links of a pair make it one, so a seed of more than ``often`` rows links documents only where there is another link that may go with it: a link of a
    rarer seed brings those of the frequent ones that both documents hold about its diagonal, and two frequent ones meet as one key (with
    their distance, in classes of 2 ``drift`` words), which gives the pair itself.  Documents that share one frequent seed and nothing else never meet."""
    kept = shared_seeds(rows, context_bits)
    wide = 2 * drift
    frequent, rare = kept.where(F.col("n") > often), kept.where(F.col("n") <= often)
    lists = materialize(frequent.groupBy("doc_id").agg(F.collect_list(F.struct("seed", "pos")).alias("often")), "frequent-seeds")
    met = _met(rare.join(lists, "doc_id", "left"), block, ["often"])
    diagonal = F.col("pos_b") - F.col("pos_a")
    about = lambda x: F.transform(F.filter("b_often", lambda y: (y["seed"] == x["seed"]) & (F.abs(y["pos"] - x["pos"] - diagonal) < wide)), lambda y: F.struct(x["pos"].alias("pos_a"), y["pos"].alias("pos_b")))
    own = F.array(F.struct("pos_a", "pos_b"))
    both = F.col("a_often").isNotNull() & F.col("b_often").isNotNull()
    more = F.when(both, F.concat(own, F.flatten(F.transform("a_often", about)))).otherwise(own)
    one = met.select("doc_a", "doc_b", F.explode(more).alias("l")).select("doc_a", "l.pos_a", "doc_b", "l.pos_b")
    # two frequent seeds of a document, the second behind the first by ``spread`` or more in the one, by 2 ``drift`` less in the other
    two = lists.select("doc_id", F.explode("often").alias("s"), "often").select("doc_id", "s", F.explode("often").alias("t")).withColumn("apart", F.col("t.pos") - F.col("s.pos"))
    two = two.where(F.col("apart") > spread - wide).select(F.xxhash64("s.seed", "t.seed").alias("seed"), "doc_id", F.col("s.pos").alias("pos"), F.col("t.pos").alias("next"), "apart", F.floor(F.col("apart") / wide).alias("class"))
    two = materialize(two, "frequent-pairs")
    near = two.select("seed", "doc_id", "pos", "next", "apart", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"))
    held = two.groupBy("seed", "class").agg(F.count(F.lit(1)).alias("n"))
    dealt = F.ceil(F.col("n") / block).cast("int")
    a = two.where(F.col("apart") >= spread).join(held, ["seed", "class"]).withColumn("blocks", dealt)
    a = a.select("seed", "class", F.col("doc_id").alias("doc_a"), F.col("pos").alias("a1"), F.col("next").alias("a2"), F.col("apart").alias("a_apart"), F.pmod(F.xxhash64("doc_id", "pos", "next"), F.col("blocks")).cast("int").alias("block"))
    b = near.join(held, ["seed", "class"]).withColumn("blocks", dealt)
    b = b.select("seed", "class", F.col("doc_id").alias("doc_b"), F.col("pos").alias("b1"), F.col("next").alias("b2"), F.col("apart").alias("b_apart"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, many pairs: a number of tasks that is not merged
    keys = ["seed", "class", "block"]
    found = a.repartition(parts, *keys).join(b.repartition(parts, *keys).hint("shuffle_hash"), keys).where((F.col("doc_a") < F.col("doc_b")) & (F.abs(F.col("a_apart") - F.col("b_apart")) < wide))
    band = lambda i: F.floor((F.col(f"b{i}") - F.col(f"a{i}")) / drift)
    found = found.where(F.abs(band(1) - band(2)) <= 1).select(F.col("doc_a").alias("lo"), F.col("doc_b").alias("hi"))
    return collinear_pairs(one, spread, drift).union(found).distinct()


def passage_pairs(texts: DataFrame, k: int, rate: int, least: int, similarity: float, max_gap: int, drift: int, often: int = 256, block: int = 512) -> DataFrame:
    """(lo, hi): pairs of ``texts`` (doc_id, raw) that may share a passage: two links more than ``k`` words apart on nearby diagonals, as from ``all_links`` and
    ``collinear_pairs``, without the pairs that share nothing but a frequent line.

    A passage begins and ends with a shared window and matches in ``need`` words at least.  Beside any of its shared windows, on one side, another begins ``off``
    words away or more in both texts: else fewer than ``off`` words matched on either side, too few.  The first one so far away is within ``off + max_gap + k``
    words in one text.  So near a frequent seed all windows are taken, not only sampled ones, and a frequent seed makes a pair only with a window beside it
    that both texts hold ``off`` to ``reach`` words away: a rarer one is a link, and two frequent ones meet as one key."""
    need = math.ceil(similarity * least - 1e-9)
    off = max(1, (need - k - 1) // 2 + 1)
    reach = off + 3 * max_gap + k  # the two texts' distances may differ by two gaps
    frequent = frequent_seeds(texts, k, rate, often)
    group = Window.partitionBy("seed")
    counted = seeds_about(texts, k, rate, frequent, reach).select("*", (F.min("doc_id").over(group) < F.max("doc_id").over(group)).alias("several"), F.count(F.lit(1)).over(group).alias("n"))
    kept = materialize(counted.where("several").drop("several"), "shared-seeds")
    one = collinear_pairs(_met(kept.where(F.col("kind") == SAMPLED), block, []).select("doc_a", "pos_a", "doc_b", "pos_b"), k + 1, drift)
    if not len(frequent):
        return one

    # a rarer window and a frequent seed, on the same side of it in both texts
    hot = (F.col("kind") == FREQUENT) | ((F.col("kind") == CLOSE) & (F.col("n") > often))
    held = materialize(kept.where(hot).groupBy("doc_id").agg(F.collect_list(F.struct("seed", "pos", (F.col("kind") == FREQUENT).alias("listed"))).alias("often")), "frequent-seeds")
    gap = lambda x: x["pos"] - F.col("pos")
    beside = F.transform(F.filter("often", lambda x: x["listed"] & F.abs(gap(x)).between(off, reach)), lambda x: 2 * x["seed"] + (gap(x) > 0).cast("int"))
    rare = kept.where(~hot).join(held, "doc_id").select("seed", "doc_id", "pos", "n", beside.alias("beside")).where(F.size("beside") > 0)
    met = _met(rare, block, ["beside"]).where(F.arrays_overlap("a_beside", "b_beside"))

    # a frequent seed and another frequent window
    two = held.select("doc_id", "often", F.explode("often").alias("s")).where("s.listed")
    two = two.select("doc_id", "s", F.explode(F.filter("often", lambda t: F.abs(t["pos"] - F.col("s.pos")).between(off, reach))).alias("t"))
    two = two.select(F.xxhash64("s.seed", "t.seed", F.col("t.pos") > F.col("s.pos")).alias("seed"), "doc_id", F.lit(0).alias("pos")).distinct()
    two = materialize(two.withColumn("n", F.count(F.lit(1)).over(group)).where("n > 1"), "frequent-pairs")
    pairs = met.select("doc_a", "doc_b").union(_met(two, block, []).select("doc_a", "doc_b"))
    return one.union(pairs).distinct()


def _link_batch(kind: int, part: int, seed, doc_a, pos_a, doc_b, pos_b) -> pa.RecordBatch:
    n = len(seed)
    return pa.RecordBatch.from_pydict({
        "kind": np.full(n, kind, np.int32), "part": np.full(n, part, np.int32), "seed": seed.astype(np.int64),
        "doc_a": doc_a.astype(np.int64), "pos_a": pos_a.astype(np.int32), "doc_b": doc_b.astype(np.int64), "pos_b": pos_b.astype(np.int32),
    })


def _edge_batch(part: int, seed, doc, pos) -> pa.RecordBatch:
    zero = np.zeros(len(seed), np.int64)
    return _link_batch(1, part, seed, zero, zero, doc, pos)


def ordered(links: DataFrame) -> DataFrame:
    """(lo, hi, x, y): links with the smaller id first."""
    swap = F.col("doc_a") > F.col("doc_b")
    pick = lambda yes, no: F.when(swap, F.col(yes)).otherwise(F.col(no))
    return links.select(pick("doc_b", "doc_a").alias("lo"), pick("doc_a", "doc_b").alias("hi"), pick("pos_b", "pos_a").alias("x"), pick("pos_a", "pos_b").alias("y"))


def collinear_pairs(links: DataFrame, spread: int, drift: int) -> DataFrame:
    """(lo, hi) of documents with two links ``spread`` words or more apart whose diagonals differ by less than ``drift`` or so.

    Links are reduced to the first and last position of each band of ``drift`` diagonals; neighbouring bands are seen
    together.
    """
    band = F.floor((F.col("y") - F.col("x")) / drift).alias("band")
    bands = ordered(links).repartition("lo", "hi").groupBy("lo", "hi", band).agg(F.min("x").alias("first"), F.max("x").alias("last"))
    pairs = bands.groupBy("lo", "hi").agg(F.collect_list(F.struct("band", "first", "last")).alias("bands"))
    pairs = pairs.select("lo", "hi", F.array_sort("bands").alias("bands"))
    after = lambda b, i: F.get("bands", i + 1)
    both = lambda b, n: (n["band"] == b["band"] + 1) & (F.greatest(n["last"], b["last"]) - F.least(n["first"], b["first"]) >= spread)
    wide = F.exists(F.transform("bands", lambda b, i: (b["last"] - b["first"] >= spread) | F.coalesce(both(b, after(b, i)), F.lit(False))), lambda x: x)
    return pairs.where(wide).select("lo", "hi")


def document_pairs(links: DataFrame) -> DataFrame:
    """(lo, hi, seeds): pairs of documents with their linked positions."""
    return ordered(links).groupBy("lo", "hi").agg(F.collect_list(F.struct("x", "y")).alias("seeds"))


def packed_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, packed): compressed texts of (doc_id, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tool.compress(x) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "packed"])

    return texts.mapInArrow(run, "doc_id long, packed binary")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs with both compressed texts, text_lo and text_hi (``unpack`` opens them); only texts of linked documents move twice."""
    pairs = materialize(pairs, "doc-pairs")
    ids = pairs.select(F.col("lo").alias("doc_id")).union(pairs.select(F.col("hi").alias("doc_id"))).distinct()
    packed = materialize(packed_texts(texts).join(ids, "doc_id", "left_semi"), "linked-texts")
    a = packed.select(F.col("doc_id").alias("lo"), F.col("packed").alias("text_lo"))
    b = packed.select(F.col("doc_id").alias("hi"), F.col("packed").alias("text_hi"))
    return pairs.join(a, "lo").join(b, "hi").select(*pairs.columns, "text_lo", "text_hi")


#: Rows of ``pairs_beside_texts``.
BESIDE = "part long, lo long, hi long, packed binary"


def pairs_beside_texts(pairs: DataFrame, texts: DataFrame, size: int = 2048) -> DataFrame:
    """Rows of ``BESIDE``: parts of about ``size`` pairs (lo, hi), in each first the compressed texts of its documents (lo, packed), then its pairs by hi and lo.

    Pairs whose hi has the same smallest partner are in one part where they are few, so a text moves and is opened once for all the copies it resembles;
    more are dealt to parts by both ends.  Rows of a part are one after another in one partition."""
    pairs = materialize(pairs, "doc-pairs")
    label = pairs.groupBy("hi").agg(F.min("lo").alias("label"))
    sizes = pairs.join(label, "hi").withColumn("m", F.ceil(F.sqrt(F.count(F.lit(1)).over(Window.partitionBy("label")) / size)).cast("int"))
    dealt = [F.pmod(F.xxhash64(c), F.col("m")) for c in ("lo", "hi")]
    keyed = materialize(sizes.select(F.xxhash64("label", *dealt).alias("part"), "lo", "hi"), "dealt-pairs")
    ends = keyed.select("part", F.explode(F.array("lo", "hi")).alias("doc_id")).distinct()
    packed = packed_texts(texts.join(ends.select("doc_id").distinct(), "doc_id", "left_semi"))
    held = ends.join(materialize(packed, "linked-texts"), "doc_id").select("part", F.col("doc_id").alias("lo"), F.lit(None).cast("long").alias("hi"), "packed")
    rows = keyed.select("part", "lo", "hi", F.lit(None).cast("binary").alias("packed")).union(held)
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # much work for few bytes: a number of tasks that is not merged
    return rows.repartition(tasks, "part").sortWithinPartitions("part", F.asc_nulls_first("hi"), "lo")


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)
