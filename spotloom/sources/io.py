"""Reading and writing samples: partitioned tables, count matrices in CSV, and plain coordinate and pair files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sample(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as Parquet under ``path``, partitioned by those of replicate and level that it has."""
    for name, df in tables.items():
        parts = [c for c in ("replicate", "level") if c in df.columns]
        df.write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/{name}")


def read_sample(spark: SparkSession, path: str, name: str, replicates: list[str] | None = None, level: int | None = None) -> DataFrame:
    """A table of ``write_sample``; the filters prune partitions, so other replicates and levels are not read."""
    df = spark.read.parquet(f"{path}/{name}")
    if replicates is not None:
        df = df.where(F.col("replicate").cast("string").isin(replicates))
    return df.where(F.col("level") == level) if level is not None else df


def merge_samples(samples: list[DataFrame]) -> DataFrame:
    """The union of replicates; columns that one lacks are null."""
    out = samples[0]
    for df in samples[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_wide_counts(spark: SparkSession, path: str, gene_col: str, replicate: str, type_row: str | None = None) -> DataFrame:
    """(replicate, spot, gene, value): a genes-by-spots CSV turned into its non-zero cells.

    ``type_row`` names the value of ``gene_col`` that marks a second header row, which is left out."""
    wide = spark.read.csv(path, header=True)
    if type_row is not None:
        wide = wide.where(F.col(gene_col) != type_row)
    long = wide.unpivot(gene_col, [c for c in wide.columns if c != gene_col], "spot", "value")
    return long.select(F.lit(replicate).alias("replicate"), "spot", F.col(gene_col).alias("gene"), F.col("value").cast("double").alias("value")).where("value <> 0")


def read_metadata(spark: SparkSession, path: str, spot_col: str, label_cols: list[str], type_row: str | None = None) -> DataFrame:
    """(spot, label columns): one CSV row per spot."""
    rows = spark.read.csv(path, header=True)
    if type_row is not None:
        rows = rows.where(F.col(spot_col) != type_row)
    return rows.select(F.col(spot_col).alias("spot"), *label_cols)


def read_pairs(spark: SparkSession, path: str, replicate: str) -> DataFrame:
    """(replicate, src, dst): a headerless tab-separated list of neighbour pairs, both directions, without loops."""
    rows = spark.read.csv(path, sep="\t", schema="src long, dst long").where("src <> dst")
    return rows.union(rows.select("dst", "src")).distinct().select(F.lit(replicate).alias("replicate"), "src", "dst")


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, gene): a CSV whose columns are sets and whose cells are gene names."""
    wide = spark.read.csv(path, header=True)
    return wide.unpivot([], wide.columns, "set_name", "gene").where(F.trim("gene") != "").distinct()


def read_gene_modules(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(block, set_name, gene): a CSV with two header rows, blocks of columns side by side.

    After ``skip`` lines, the first header row names a block over its first column; the column under it holds genes and the
    next one the module of each.  Further columns of a block, and rows without a gene or module, are left out.  The file is
    one split (a list of genes), so rows keep their places."""
    rows = spark.read.csv(path, header=False, multiLine=True).withColumn("__at", F.monotonically_increasing_id())
    head = rows.where(F.col("__at") == skip).first()
    named = [(c, i) for i, c in enumerate(rows.columns[:-1]) if head is not None and head[c] and head[c].strip()]
    blocks = [F.struct(F.lit(head[c].strip()).alias("block"), F.trim(F.col(rows.columns[i + 1])).alias("set_name"), F.trim(F.col(c)).alias("gene")) for c, i in named if i + 2 < len(rows.columns)]
    if not blocks:
        raise ValueError(f"no block of columns in row {skip} of {path}")
    long = rows.where(F.col("__at") > skip + 1).select(F.explode(F.array(*blocks)).alias("e")).select("e.*")
    return long.where("gene <> '' AND set_name <> ''").distinct()
