"""Exact dedup: a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition becomes a run: its rows grouped by digest, each group reduced to its best row and a count.
Runs then merge in rounds of a binomial tree.  In round ``r`` the runs whose number has a non-zero digit ``r`` (base
``fan_in``) go to the run that has zero there; that run merges up to ``fan_in`` sorted runs at once.  Within a
round the rows are dealt by (run, digest), so even the last round, where one run is left, is spread over all tasks.

A digest is the SHA-256 of the normalised text.  A merge also demands the same length and the same XXH64 of that
text, and every level keeps only the smallest verified row, so a level never passes on more than one row a text.

Texts themselves never shuffle: the runs carry about 60 bytes a row, and only texts that occur twice or more are
joined back.

Defined results: null text counts as empty; empty texts equal each other; null ids rank after all others; rows
equal in length and id are told apart by an arbitrary but fixed row number, so exactly one stays; an empty table gives
an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.functions.scratch import materialize
from spotloom.functions.text import text_of, without_white


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per input row: id, run number, digest, verification values, length of the original text."""
    text = text_of(text_col)
    bare = without_white(text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).alias("n_points"), bare.alias("bare"))
    return rows.select(
        "doc_id",
        "n_points",
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row_no"),
        F.unhex(F.sha2("bare", 256)).alias("digest"),
        F.octet_length("bare").alias("n_bytes"),
        F.xxhash64("bare").alias("check"),
    )


_KEY = ["digest", "n_bytes", "check"]


def merge_runs(rows: DataFrame, fan_in: int = 8) -> DataFrame:
    """Tree-merge the runs of ``digest_rows``; returns the best row and the group size of every text."""
    last = rows.agg(F.max("run")).first()[0] or 0
    best = F.struct((-F.col("n_points")).alias("rank"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_no"))
    runs = rows.groupBy("run", *_KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    step = fan_in
    while step // fan_in <= last:
        runs = runs.withColumn("run", F.col("run") - F.col("run") % step)
        keys = ["run", *_KEY] if step <= last else _KEY
        runs = runs.groupBy(*keys).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        step *= fan_in
    return runs.select(*_KEY, "best", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, n_points (length of the original text)."""
    rows = materialize(digest_rows(docs, id_col, text_col), "exact-digests")
    groups = materialize(
        merge_runs(rows, fan_in).where("group_size > 1").select(
            *_KEY, F.col("best.doc_id").alias("best_id"), F.col("best.row_no").alias("best_row"), "group_size"
        ),
        "exact-groups",
    )
    alone = F.col("group_size").isNull()
    return rows.join(groups, _KEY, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_no") == F.col("best_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_points",
    )
