"""Operators on sparse expression (replicate, spot_id, gene, value); cells without a row are zero.

Every mean and variance divides by the number of spots, not of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.small import exact_percentile, small


def scale_to_factors(expr: DataFrame, factors: int) -> DataFrame:
    """Values scaled so that the mean row sum of a replicate is ``factors``."""
    total = expr.groupBy("replicate").agg(F.sum("value").alias("t"), F.count_distinct("spot_id").alias("n"))
    return expr.join(small(total), "replicate").select("replicate", "spot_id", "gene", (F.col("value") * (factors / (F.col("t") / F.col("n")))).alias("value"))


def log_normalize(expr: DataFrame) -> DataFrame:
    """log1p of values scaled to the replicate's median row sum."""
    rows = expr.groupBy("replicate", "spot_id").agg(F.sum("value").alias("t"))
    mid = exact_percentile(rows, ["replicate"], "t", 0.5, "m")
    scale = rows.join(small(mid), "replicate").select("replicate", "spot_id", (F.col("m") / F.col("t")).alias("f"))
    return expr.join(scale, ["replicate", "spot_id"]).select("replicate", "spot_id", "gene", F.log1p(F.col("value") * F.col("f")).alias("value"))


def spot_counts(expr: DataFrame) -> DataFrame:
    return expr.groupBy("replicate").agg(F.count_distinct("spot_id").alias("n"))


def gene_moments(expr: DataFrame) -> DataFrame:
    """(replicate, gene, mean, var): over all spots, zeros included (sample variance)."""
    sums = expr.groupBy("replicate", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    return sums.join(small(spot_counts(expr)), "replicate").select("replicate", "gene", (s / n).alias("mean"), ((q - s * s / n) / (n - 1)).alias("var"), "n")


def variable_genes(expr: DataFrame, top: int, bins: int = 20) -> DataFrame:
    """(gene, dispersion, normalized, rank): genes by variance over mean, normalised inside bins of the mean; ties by name.

    Bins cut the range of log1p(mean) into ``bins`` equal parts; a dispersion (log of variance over mean) is taken against
    its bin's mean in units of its standard deviation, and a gene alone in its bin gets 1."""
    moments = gene_moments(expr.withColumn("replicate", F.lit("all"))).where("mean > 0")
    d = moments.select("gene", F.log(F.greatest(F.col("var") / F.col("mean"), F.lit(1e-12))).alias("dispersion"), F.log1p("mean").alias("m"))
    ends = d.agg(F.min("m").alias("lo"), F.max("m").alias("hi")).first()
    lo, hi = ends.lo or 0.0, ends.hi or 0.0
    place = F.least(F.lit(bins - 1), F.floor((F.col("m") - lo) / F.lit(((hi - lo) / bins) or 1.0)).cast("int"))
    binned = d.withColumn("bin", place)
    each = small(binned.groupBy("bin").agg(F.avg("dispersion").alias("a"), F.stddev_samp("dispersion").alias("s")))
    scored = binned.join(each, "bin").withColumn("normalized", F.when(F.col("s") > 0, (F.col("dispersion") - F.col("a")) / F.col("s")).otherwise(1.0))
    by = Window.partitionBy(F.col("gene").isNull()).orderBy(F.desc(F.round("normalized", 9)), "gene")  # one row per gene
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("gene", "dispersion", "normalized", "rank")


def gene_number(expr: DataFrame) -> int:
    return expr.agg(F.count_distinct("gene")).first()[0]


def sparsity(expr: DataFrame) -> DataFrame:
    """(replicate, sparsity): share of zero cells."""
    n = expr.groupBy("replicate").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("spot_id").alias("n"))
    return n.select("replicate", (1 - F.col("c") / (F.col("n") * gene_number(expr))).alias("sparsity"))


def gene_sparsity_histogram(expr: DataFrame, bins: int = 20) -> DataFrame:
    """(replicate, bin, n): genes by their share of zero cells in a replicate, in equal bins of [0, 1]; 1 is in the last."""
    g = gene_number(expr)
    n = small(spot_counts(expr))
    zero = expr.groupBy("replicate", "gene").agg(F.count(F.lit(1)).alias("c")).join(n, "replicate").select("replicate", (1 - F.col("c") / F.col("n")).alias("z"))
    seen = zero.groupBy("replicate", F.least(F.lit(bins - 1), F.floor(F.round(F.col("z") * bins, 9)).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    absent = zero.groupBy("replicate").agg((g - F.count(F.lit(1))).alias("n")).select("replicate", F.lit(bins - 1).alias("bin"), "n")
    return seen.union(absent).groupBy("replicate", "bin").agg(F.sum("n").alias("n")).where("n > 0")


def marker_score(expr: DataFrame, markers: DataFrame) -> DataFrame:
    """(replicate, spot_id, score): sum of z-scores (population deviation) over the marker genes, zeros included."""
    own = expr.join(markers.select("gene").distinct(), "gene", "left_semi")
    sums = own.groupBy("replicate", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mom = sums.join(small(spot_counts(expr)), "replicate").select("replicate", "gene", (F.col("s") / F.col("n")).alias("m"), F.sqrt(F.col("q") / F.col("n") - F.col("s") / F.col("n") * (F.col("s") / F.col("n"))).alias("d")).where("d > 0")
    zero = mom.groupBy("replicate").agg(F.sum(-F.col("m") / F.col("d")).alias("zero"))  # score of a spot without any marker
    lift = own.join(mom, ["replicate", "gene"]).groupBy("replicate", "spot_id").agg(F.sum(F.col("value") / F.col("d")).alias("lift"))
    spots = expr.select("replicate", "spot_id").distinct().join(zero, "replicate")
    return spots.join(lift, ["replicate", "spot_id"], "left").select("replicate", "spot_id", (F.col("zero") + F.coalesce("lift", F.lit(0.0))).alias("score"))


def _every_replicate(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, replicate, n): every gene with every replicate and its number of spots; replicates are a short list."""
    counts = spot_counts(expr).collect()
    table = F.array(*[F.struct(F.lit(r.replicate).alias("replicate"), F.lit(r.n).alias("n")) for r in counts]) if counts else None
    if table is None:
        return genes.join(spot_counts(expr), F.lit(False))
    return genes.select("gene", F.explode(table).alias("e")).select("gene", "e.replicate", "e.n")


def region_markers(expr: DataFrame, top: int) -> DataFrame:
    """(replicate, gene, z, rank): genes whose mean in a replicate stands out most from the others' (z over replicates)."""
    mean = gene_moments(expr).select("replicate", "gene", "mean")
    full = _every_replicate(expr, mean.select("gene").distinct()).drop("n").join(mean, ["replicate", "gene"], "left").na.fill(0.0, ["mean"])
    w = Window.partitionBy("gene")
    dev = F.stddev_pop("mean").over(w)
    z = full.withColumn("z", F.when(dev > 0, (F.col("mean") - F.avg("mean").over(w)) / dev).otherwise(0.0))
    by = Window.partitionBy("replicate").orderBy(F.desc(F.round("z", 9)), "gene")
    return z.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("replicate", "gene", "z", "rank")


def welch_t(expr: DataFrame) -> DataFrame:
    """(replicate, gene, t, df, log_fold): one replicate against all others per gene, zeros included."""
    sums = expr.groupBy("replicate", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    grid = _every_replicate(expr, sums.select("gene").distinct()).join(sums, ["replicate", "gene"], "left").na.fill(0.0, ["s", "q"])
    w = Window.partitionBy("gene")
    rest = grid.select("*", (F.sum("n").over(w) - F.col("n")).alias("n2"), (F.sum("s").over(w) - F.col("s")).alias("s2"), (F.sum("q").over(w) - F.col("q")).alias("q2"))
    mean = lambda s, n: F.col(s) / F.col(n)
    var = lambda s, q, n: (F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1)
    a, b = var("s", "q", "n") / F.col("n"), var("s2", "q2", "n2") / F.col("n2")
    out = rest.where("n > 1 AND n2 > 1").select("replicate", "gene", a.alias("a"), b.alias("b"), mean("s", "n").alias("m1"), mean("s2", "n2").alias("m2"), "n", "n2").where("a + b > 0")
    df = (F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) / (F.col("a") * F.col("a") / (F.col("n") - 1) + F.col("b") * F.col("b") / (F.col("n2") - 1))
    return out.select("replicate", "gene", ((F.col("m1") - F.col("m2")) / F.sqrt(F.col("a") + F.col("b"))).alias("t"), df.alias("df"), F.log2((F.col("m1") + 1e-9) / (F.col("m2") + 1e-9)).alias("log_fold"))


def benjamini_hochberg(rows: DataFrame, p: str, by: list[str]) -> DataFrame:
    """``rows`` with ``adjusted``: step-up adjusted p-values inside each group of tests."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(p))).withColumn("__q", F.col(p) * n / F.col("__r"))
    down = Window.partitionBy(*by).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("adjusted", F.least(F.lit(1.0), F.min("__q").over(down))).drop("__r", "__q")


def gene_correlation(expr: DataFrame) -> DataFrame:
    """(replicate, a, b, value): Pearson correlation of gene pairs a < b that share a spot, over spots, zeros included.

    A pair that shares no spot has the value -sqrt(m_a m_b), m being mean^2 / variance of a gene, and gives no row.
    A spot's genes meet in one sorted row, so the pairs are formed once and added up before they move."""
    mom = expr.groupBy("replicate", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(small(spot_counts(expr)), "replicate")
    one = expr.groupBy("replicate", "spot_id").agg(F.array_sort(F.collect_list(F.struct("gene", "value"))).alias("x"))
    left = one.select("replicate", F.posexplode("x").alias("p", "a"), "x")
    pair = left.select("replicate", "a", F.explode(F.slice("x", F.col("p") + 2, F.size("x"))).alias("b"))
    cross = pair.groupBy("replicate", F.col("a.gene").alias("a"), F.col("b.gene").alias("b")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("ab"))
    left = mom.select("replicate", F.col("gene").alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa"), "n")
    right = mom.select("replicate", F.col("gene").alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb"))
    n = F.col("n")
    top = F.col("ab") - F.col("sa") * F.col("sb") / n
    low = F.sqrt((F.col("qa") - F.col("sa") * F.col("sa") / n) * (F.col("qb") - F.col("sb") * F.col("sb") / n))
    return cross.join(left, ["replicate", "a"]).join(right, ["replicate", "b"]).where(low > 0).select("replicate", "a", "b", (top / low).alias("value"))


def align_genes(expr: DataFrame) -> DataFrame:
    """Rows of genes that every replicate has (the inner concatenation of replicates)."""
    all_ = expr.select("replicate").distinct().count()
    held = expr.groupBy("gene").agg(F.count_distinct("replicate").alias("r")).where(F.col("r") == all_)
    return expr.join(held.select("gene"), "gene", "left_semi")


def set_membership(members: DataFrame, sets: list[str]) -> DataFrame:
    """(combination columns, n): how many genes are in each combination of the named sets (set_name, gene)."""
    flags = members.groupBy("gene").agg(*[F.max((F.col("set_name") == s)).alias(s) for s in sets])
    return flags.groupBy(*sets).agg(F.count(F.lit(1)).alias("n"))


def set_overlap(members: DataFrame) -> DataFrame:
    """(a, b, shared): sizes of the intersections of gene sets a < b."""
    one = members.select(F.col("set_name").alias("a"), "gene").distinct()
    return one.join(members.select(F.col("set_name").alias("b"), "gene").distinct(), "gene").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
