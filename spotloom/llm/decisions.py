"""Put row decisions into effect on whole documents without shuffling the texts of unaffected rows twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.functions.scratch import materialize


def keep_rows(docs: DataFrame, decided: DataFrame, mark: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, mark, kept: one row per row of ``docs``) keeps.

    Ids that are kept throughout pass an anti-join only.  Where an id has kept and dropped rows, ``mark`` (an expression
    over ``docs``; the column ``mark`` of ``decided``) tells them apart, and of rows equal in both one stays.
    """
    ids = decided.groupBy("doc_id").agg(F.min("kept").alias("all_kept"), F.max("kept").alias("any_kept")).where(~F.col("all_kept"))
    ids = materialize(ids.select(F.col("doc_id").alias("__id"), "any_kept"), "dropped-ids")
    out = docs.join(ids, docs[id_col].eqNullSafe(ids["__id"]), "left_anti")
    mixed = ids.where("any_kept").select("__id")
    if mixed.isEmpty():
        return out
    kept = decided.where("kept").join(mixed, decided["doc_id"].eqNullSafe(mixed["__id"]), "left_semi").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    some = docs.join(mixed, docs[id_col].eqNullSafe(mixed["__id"]), "left_semi").withColumn("__row_mark", mark)
    some = some.join(kept, some[id_col].eqNullSafe(kept["__id"]) & some["__row_mark"].eqNullSafe(kept["__mark"]), "left_semi")
    return out.union(some.dropDuplicates([id_col, "__row_mark"]).select(*docs.columns))
