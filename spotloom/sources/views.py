"""Views of the generic tables in the shape of spatial samples.

``spots``: one row per measured location of a replicate; ``embedding_long``: non-negative factor loadings of a spot;
``expression``: sparse counts per spot and gene (zeros are absent); ``covariates``: one value per day and its mean.
The ``*_SQL`` strings say the same in ANSI SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.sources.tables import table

FACTORS = 8


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("r"), (F.col("vec_id") % 2).cast("string")).alias("replicate"),
        F.col("vec_id").alias("spot_id"), at(1).alias("x"), at(2).alias("y"), "label",
    )


SPOTS_SQL = "SELECT 'r' || (vec_id % 2) AS replicate, vec_id AS spot_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings"


def embedding_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor k of a spot: the summed sizes of every ``FACTORS``-th entry of its vector, from the k-th on."""
    sizes = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    fold = lambda k: F.aggregate(F.filter(sizes, lambda v, i: i % FACTORS == k), F.lit(0.0), lambda a, v: a + v)
    folded = [fold(k) for k in range(FACTORS)]
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("r"), (F.col("vec_id") % 2).cast("string")).alias("replicate"), F.col("vec_id").alias("spot_id"), F.posexplode(F.array(*folded)).alias("k", "v")
    ).withColumn("k", F.col("k") + 1)


EMBEDDING_SQL = f"""SELECT 'r' || (vec_id % 2) AS replicate, vec_id AS spot_id, k::INT AS k, list_sum([abs(embedding[i]::DOUBLE) for i in range(k, len(embedding) + 1, {FACTORS})]) AS v
  FROM embeddings, range(1, {FACTORS + 1}) t(k)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(replicate, spot_id, label, z): spots with their whole vectors."""
    z = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("r"), (F.col("vec_id") % 2).cast("string")).alias("replicate"), F.col("vec_id").alias("spot_id"), "label", z.alias("z"))


POINTS_SQL = "SELECT 'r' || (vec_id % 2) AS replicate, vec_id AS spot_id, label, embedding::DOUBLE[] AS z FROM embeddings"


def spot_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``expression`` of the spots that ``spots`` holds too, in their replicates, with the region apart."""
    rows = expression(spark, sf_dir).withColumnRenamed("replicate", "region")
    return rows.withColumn("replicate", F.concat(F.lit("r"), (F.col("spot_id") % 2).cast("string")))


SPOT_EXPRESSION_SQL = "SELECT replicate AS region, 'r' || (spot_id % 2) AS replicate, spot_id, gene, value FROM expr"


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by customer (spot) and brand with type (gene); the replicate is the customer's region."""
    t = lambda n: table(spark, sf_dir, n)
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    genes = t("part").select("p_partkey", F.concat_ws(":", "p_brand", "p_type").alias("gene"))
    orders = t("orders").select("o_orderkey", "o_custkey")
    where = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("replicate"))
    rows = items.join(genes, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    cells = rows.groupBy(F.col("o_custkey").alias("spot_id"), "gene").agg(F.sum("l_quantity").alias("value"))
    return cells.join(where, F.col("spot_id") == F.col("c_custkey")).select("replicate", "spot_id", "gene", "value")


EXPRESSION_SQL = """SELECT n_regionkey AS replicate, o_custkey AS spot_id, p_brand || ':' || p_type AS gene, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"""


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group, t, value): mean event value per event type and day, t being the day's number."""
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("feature"), day.cast("double").alias("t")).agg(F.avg("value").alias("value"))


COVARIATES_SQL = "SELECT event_type AS feature, date_diff('day', DATE '2020-01-01', ts::DATE)::DOUBLE AS t, avg(value) AS value FROM events GROUP BY ALL"

#: Symmetrised six nearest neighbours inside a replicate, ties by id.
EDGES_SQL = """SELECT DISTINCT replicate, src, dst, distance FROM (
    SELECT replicate, src, dst, distance FROM knn UNION ALL SELECT replicate, dst, src, distance FROM knn)"""
KNN_SQL = """SELECT replicate, src, dst, sqrt(d2) AS distance, rank FROM (
    SELECT a.replicate, a.spot_id AS src, b.spot_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
           row_number() OVER (PARTITION BY a.spot_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.spot_id) AS rank
    FROM spots a JOIN spots b ON a.replicate = b.replicate AND a.spot_id <> b.spot_id) WHERE rank <= 6"""

VIEWS = {"spots": SPOTS_SQL, "emb": EMBEDDING_SQL, "knn": KNN_SQL, "edges": EDGES_SQL, "expr": EXPRESSION_SQL, "cov": COVARIATES_SQL, "pts": POINTS_SQL, "exs": SPOT_EXPRESSION_SQL}
_NEEDS = {"knn": ["spots"], "edges": ["spots", "knn"], "exs": ["expr"]}


def with_views(names: str, body: str) -> str:
    """``body`` (further common table expressions and a SELECT) after the views it reads."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in [*_NEEDS.get(n, []), n] if x not in wanted]
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    return f"WITH {ctes}{', ' if not body.lstrip().upper().startswith('SELECT') else ' '}{body}"
