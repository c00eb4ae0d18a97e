"""Corpus preparation in five stages: score, drop copies, drop near copies, mix, encode.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; between stages the rows are
written as Parquet and read again, so a lost executor costs one stage at most.  The first four return the columns of
``documents``; the last returns the encoding's digests.

Defined results: a null or empty text counts as empty, is scored like any other, is one of the equal texts and links with
other empty texts, and encodes to no tokens.  Null ids are kept apart from any number and lose ties against numbers; rows
that repeat in id and text are copies, so one of them stays; ids that repeat with other texts are decided text by text
(when mixing, by their token counts).  Very long texts are read whole.  Extra columns, also those named like an
operator's results, pass through the first four stages unchanged.  Without labels every document scores 0.5 and stays;
with fewer than ten, or of one class only, every score is the labels' mean.  An empty table goes through all stages and
gives an empty result.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.functions.scratch import materialize
from spotloom.functions.ship import ship_package
from spotloom.functions.text import text_of, without_white
from spotloom.llm import bpe, exact_dedup, mixing, quality_classifier, simhash_dedup
from spotloom.llm.decisions import keep_rows
from spotloom.llm.queries import MIX_PLAN, source_domain, vocabulary
from spotloom.sources.tables import table


#: Fixed value: rows a worker gets at a time.  Documents are long, and Spark's 10,000 of them fill tens of MB on both sides.
BATCH_ROWS = 1000


def _python_ready(spark: SparkSession) -> None:
    """The package is on its way to the workers, and batches of whole texts are small; a smaller setting of the session stays."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    _python_ready(spark)
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return docs.where(model.score(F.col("text")) >= 0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (white space aside): the longest, then the smallest id."""
    found = exact_dedup.exact_dedup(docs)
    text = text_of("text")
    mark = F.concat_ws(":", F.sha2(without_white(text), 256), F.char_length(text).cast("string"))
    return keep_rows(docs, found.select("doc_id", F.concat_ws(":", "text_sha256", F.col("n_points").cast("string")).alias("mark"), "kept"), mark)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: its smallest id."""
    _python_ready(spark)
    found = simhash_dedup.simhash_components(docs)
    return keep_rows(docs, found.select("doc_id", F.col("fp").alias("mark"), "kept"), simhash_dedup.fingerprint_of(F.col("text")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen for the target weights, at most once each."""
    found = mixing.mix(docs, source_domain(), replace(MIX_PLAN, budget=(3, 4), max_epochs=1))
    return keep_rows(docs, found.select("doc_id", F.col("n_tokens").alias("mark"), (F.col("copies") > 0).alias("kept")), mixing.token_count("text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    _python_ready(spark)
    return bpe.encode_decode(docs, vocabulary())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixed", mixed), ("encoded", encoded)]

#: The classifier, the fingerprints and the encoder have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the ``documents`` of ``sf_dir``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
