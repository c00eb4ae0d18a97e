"""Spelling variants: words within one edit of each other, found through pivotal grams, and led to their frequent form.

Words are counted inside their partition first; a task holds a bounded table of words and passes it on when full.

Two words within one edit share a bigram that the edit left alone.  Bigrams are ordered by how many words hold them, rare
ones first.  A word's prefix is its first three bigrams in that order; of these a dynamic programme picks two that do not
overlap and are rarest together, its pivots.  One edit damages one pivot at most.  So the word whose prefix ends earlier has a
pivot that is in the other's prefix: pivots are looked up in an index of prefixes.  Where the third bigram occurs again in
the word, its first five occurrences are indexed: a pivot is among the first three, and one edit puts two before it at most.
The edit is to the right or to the left of the undamaged pivot, so the words agree up to its end, or from its start on.
That sets the limits of its position (the same place from the start, or from the end), and a hash of either side is the
key under which bigrams are indexed and looked up.  Pairs that meet, and whose letters agree but for two kinds, are verified
by edit distance.

Index lists longer than ``list_limit`` (bigrams near an end have little on that side) are refined, which loses no pair: words
within one edit share their first half or the rest after it, cut at half of the shorter length, so the keys hold those too.

Forms: a word's form is its most frequent near word, where that is ten times as frequent.  Counts grow tenfold along forms, so
chains are short; roots are found by pointer jumping.

Defined results: null and empty texts have no words; a null id counts as the empty string; repeated rows count again; very
long texts are read whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.functions.scratch import discard, materialize

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The letters of a word, A-Z, a-z and U+00C0 to U+00FF, in lower-cased UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: The alphabet has 90 letters after lower-casing, so there are at most this many bigrams.
MOST_GRAMS = 90 * 90


def thinned(run: bytes, key: bytes, every: int) -> str:
    """The run, or in one of ``every`` cases the run without one letter that the checksum of ``key`` chooses."""
    h, word = zlib.crc32(key), run.decode()
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch], every: int, shortest: int, hold: int) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            raw = (text.as_py() or b"").translate(_LOWER)
            runs = Counter(_RUN.findall(raw)) if len(raw) < 1 << 22 else Counter(m[0] for m in _RUN.finditer(raw))
            head = b"" if not doc_id.is_valid else str(doc_id.as_py()).encode()
            for run, n in runs.items():
                if len(run) >= shortest:
                    word = thinned(run, head + b":" + run, every)
                    if len(word) >= shortest:
                        total[word] += n
            if len(total) >= hold:
                yield flush()
    if total:
        yield flush()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 31, shortest: int = 7, least: int = 2, hold: int = 200_000) -> DataFrame:
    """(word, n): words of ``shortest`` letters or more that occur ``least`` times or more; ``hold`` bounds a task's table."""
    cols = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    parts = cols.mapInArrow(partial(_counted, every=every, shortest=shortest, hold=hold), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for word in batch.column(0):
            text = word.as_py()
            total.update(map("".join, zip(text, text[1:])))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "words"])


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, words): in how many places of distinct words each bigram is."""
    return words.select("word").mapInArrow(_grams, "gram string, words long").groupBy("gram").agg(F.sum("words").alias("words"))


def prefix_and_pivots(word: str, rank: dict[str, int], weight: dict[str, int]) -> tuple[list[tuple[str, int]], list[tuple[str, int]], int]:
    """The entries to index and the pivots, as (gram, position), and the rank of the prefix's last gram."""
    grams = sorted((rank[word[i : i + 2]], i) for i in range(len(word) - 1))
    last = grams[2][0]
    indexed = [i for r, i in grams[:2] if r < last] + [i for r, i in grams[:7] if r == last][:5]
    prefix = sorted(i for _, i in grams[:3])
    # lightest[k] holds the least weight of k grams that do not overlap among those up to a position, and the grams
    lightest: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ()), None, None]]
    for at, i in enumerate(prefix):
        free = at if at == 0 or prefix[at - 1] < i - 1 else at - 1  # entries before the first gram that overlaps
        now = list(lightest[at])
        for k in (1, 2):
            before = lightest[free][k - 1]
            if before is not None:
                cost = before[0] + weight[word[i : i + 2]]
                if now[k] is None or cost < now[k][0]:
                    now[k] = (cost, (*before[1], i))
        lightest.append(now)
    return [(word[i : i + 2], i) for i in indexed], [(word[i : i + 2], i) for i in lightest[-1][2][1]], last


def letter_sign(word: str) -> int:
    """A bit per kind of letter (code modulo 64): whether it occurs an odd number of times.  One edit changes two bits at most."""
    sign = 0
    for letter in word:
        sign ^= 1 << (ord(letter) & 63)
    return sign - (1 << 64) if sign >> 63 else sign


def _signed(batches: Iterator[pa.RecordBatch], rank: dict[str, int], weight: dict[str, int]) -> Iterator[pa.RecordBatch]:
    names = ["word", "sign", "pivot", "pos", "last"]
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for word in batch.column(0).to_pylist():
            prefix, pivots, last = prefix_and_pivots(word, rank, weight)
            sign = letter_sign(word)
            for pivot, grams in ((False, prefix), (True, pivots)):
                for _, pos in grams:
                    for col, value in zip(rows, (word, sign, pivot, pos, last)):
                        col.append(value)
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)


def signatures(words: DataFrame) -> DataFrame:
    """(word, sign, pivot, pos, last): entries to index (pivot false, seven at most) and two pivots of every word."""
    grams = gram_counts(words).orderBy("words", "gram").limit(MOST_GRAMS + 1).collect()
    if len(grams) > MOST_GRAMS:
        raise ValueError(f"more than {MOST_GRAMS} bigrams: words may hold a-z and U+00C0 to U+00FF only")
    rank, weight = {r.gram: i for i, r in enumerate(grams)}, {r.gram: r.words for r in grams}
    return words.select("word").mapInArrow(partial(_signed, rank=rank, weight=weight), "word string, sign long, pivot boolean, pos int, last int")


def _halves(shorter: Column) -> Column:
    """First half and rest of ``word``, marked, when its partner may be shorter; ``shorter`` is the shorter length."""
    cut = F.floor(shorter / 2).cast("int")
    size = F.char_length("word")
    return F.array(F.concat(F.lit("<"), F.substr("word", F.lit(1), cut)), F.concat(F.lit(">"), F.substr("word", size - (shorter - cut) + 1)))


#: Longer words than this are verified from their ends instead of by the built-in distance, which is slow on them.
LONG = 200


def one_edit(a: str, b: str) -> bool:
    """Whether two different words are one edit apart: what follows their common start is equal but for that edit."""
    same, most = 0, min(len(a), len(b))
    while same < most and a[same] == b[same]:
        same += 1
    longer_a, longer_b = len(a) >= len(b), len(b) >= len(a)
    return abs(len(a) - len(b)) <= 1 and a[same + longer_a :] == b[same + longer_b :]


def _near_if_long(a: Column, b: Column) -> Column:
    @F.pandas_udf("boolean")
    def check(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([len(x) <= LONG or one_edit(x, y) for x, y in zip(left, right)], dtype="bool")

    return check(a, b)


def _halves(shorter: Column) -> Column:
    """First half and rest of ``word``, marked, beside a word with which the shorter length is ``shorter``."""
    cut = F.floor(shorter / 2).cast("int")
    return F.array(F.concat(F.lit("<"), F.substr("word", F.lit(1), cut)), F.concat(F.lit(">"), F.substr("word", F.char_length("word") - (shorter - cut) + 1)))


def near_pairs(words: DataFrame, list_limit: int = 40) -> DataFrame:
    """(a, b): all pairs of words of one edit, each once, ``a`` before ``b``."""
    signed = materialize(signatures(words), "spelling-grams")
    start, end = F.substr("word", F.lit(1), F.col("pos") + 2), F.substr("word", F.col("pos") + 1)
    keys = F.array(F.xxhash64(F.lit("<"), start), F.xxhash64(F.lit(">"), end))
    rows = signed.select("word", "sign", "last", "pivot", F.explode(keys).alias("key"))
    probe, index = rows.where("pivot").drop("pivot"), rows.where("not pivot").drop("pivot")
    long = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > list_limit).select("key"), "spelling-long")
    found = _verified(probe.join(long, "key", "left_anti"), index.join(long, "key", "left_anti"))
    if not long.isEmpty():
        wide = [_refined(t.join(long, "key", "left_semi")) for t in (probe, index)]
        found = found.union(_verified(*wide))
    return found.distinct().where(_near_if_long(F.col("a"), F.col("b")))


def _refined(rows: DataFrame) -> DataFrame:
    """Keys that hold a half of the word as well, for each length a partner may have."""
    size = F.char_length("word")
    rows = rows.withColumn("shorter", F.explode(F.array(size - 1, size)))
    return rows.select("word", "sign", "last", F.explode(F.transform(_halves(F.col("shorter")), lambda half: F.xxhash64("key", "shorter", half))).alias("key"))


def _verified(probe: DataFrame, index: DataFrame) -> DataFrame:
    left, right = (t.select("key", F.col("word").alias(n), F.col("sign").alias(f"{n}_sign"), F.col("last").alias(f"{n}_last")) for t, n in ((probe, "a"), (index, "b")))
    alike = F.bit_count(F.col("a_sign").bitwiseXOR(F.col("b_sign"))) <= 2  # cheap, and true of all words one edit apart
    met = left.join(right, "key").where(alike & (F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")) & ((F.char_length("a") > LONG) | (F.levenshtein("a", "b", 1) == 1)))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of forms, by pointer jumping."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while not now.join(forms.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        was, now = now, materialize(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        discard(was)
    return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = 10, list_limit: int = 40) -> DataFrame:
    """Per word: word, form, root, n (occurrences), n_near (words within one edit), form_n."""
    words = materialize(word_counts(docs, id_col, text_col), "spelling-words")
    pairs = materialize(near_pairs(words, list_limit), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near"))).alias("best"))
    linked = words.join(best, "word", "left")
    form = F.when(-F.col("best.rank") >= factor * F.col("n"), F.col("best.near"))
    linked = materialize(linked.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form.isNotNull(), -F.col("best.rank")).alias("form_n")), "spelling-forms")
    ends = roots(linked.where("form is not null"))
    return linked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
