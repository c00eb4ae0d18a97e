"""Tables that cut lineage, kept in the folder the cluster shares.

``spark.checkpoint.dir`` names that folder.  A local session without the setting (tests, notebooks) gets a
temporary one; a cluster without it is an error, because a machine-local folder would be lost with its executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a trailing slash."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spotloom-")
    return f"file://{_local[app]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    Later readers neither recompute ``df`` nor depend on the executors that made it, and expressions that differ
    between attempts (partition numbers, row numbers) are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing will read again."""
    spark, jvm = table.sparkSession, table.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
