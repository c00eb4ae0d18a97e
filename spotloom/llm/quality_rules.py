"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame operations only.

Five transformed statistics describe a document (logs of length, word length, and rates of symbols, repeated lines and
repeated words).  For every language and source, and as wider nets for every language and for all rows, a centre and a
covariance are estimated from the ``share`` of rows whose covariance has the least determinant: from three fixed starts
(median deviations; plain covariance; covariance of the directions from the median), each concentration step
measures all rows by Mahalanobis distance and re-estimates from the closest ones, which never raises the determinant, and of
the starts the one that ends with the least is kept.  A row is judged by its narrowest group of ``min_rows`` or more rows, since
fewer do not determine a covariance, and rejected beyond a chi-square quantile.

A concentration step is one pass over the small statistics table: rows are counted and summed by group and distance
bucket, and the buckets up to the ``share`` give the new estimate.  Statistics are whole thousandths, so all sums are
exact, and results do not depend on the order of rows or tasks.  No group is ever collected: what meets in one place is
at most one row per group and bucket.

Texts are read once; word windows are compared inside each row.  Two equal 64-bit window hashes count as equal windows.

Defined results: null text has no words; rows that fail the base rules are neither fitted nor judged; null language or
source is a group like any other; where no group has ``min_rows`` rows the group of all rows is used; equal rows get
equal verdicts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.scratch import materialize
from spotloom.functions.small import small
from spotloom.functions.text import bind, count_chars, text_of, without_white, words_of

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Statistics and the least standard deviation each is given, so that rates that are zero almost everywhere do not
#: make every other value an outlier.
STATISTICS = {"x_words": 0.3, "x_length": 0.08, "x_symbols": 0.6, "x_lines": 0.6, "x_repeats": 0.6}
_SCALE = 1000
_BUCKETS_PER_E = 32


def repeated_words(words: Column, width: int = 5) -> Column:
    """Number of words inside windows of ``width`` words that occur twice or more."""

    def from_hashes(hashes: Column) -> Column:
        def from_sorted(rows: Column) -> Column:
            n = F.size(rows)
            twin = lambda x, i: ((i > 0) & (F.get(rows, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(rows, i + 1)["h"] == x["h"]))
            places = F.array_sort(F.transform(F.filter(rows, twin), lambda x: x["p"]))
            covered = lambda at: F.aggregate(
                at,
                F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
                lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n")),
                lambda a: a["n"],
            )
            return covered(places)

        rows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(rows, from_sorted))

    def from_words(w: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)])
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), window)
        return F.when(F.size(w) < width + 1, F.lit(0)).otherwise(bind(hashes, from_hashes))

    return bind(words, from_words).cast("long")


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), name("lang").alias("lang"), name("source").alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(without_white(x)) > 0)
    dup_lines = bind(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.char_length(without_white(F.col("text"))).cast("long").alias("word_chars"),
        count_chars(F.col("text"), SYMBOLS).alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        bind(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
    )
    rows = rows.select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _vector(rows: DataFrame) -> DataFrame:
    """Adds the transformed statistics in thousandths."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = {
        "x_words": F.log(n),
        "x_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x_symbols": F.log1p(100 * F.col("n_symbols") / n),
        "x_lines": F.log1p(1000 * F.col("n_dup_lines") / n),
        "x_repeats": F.log1p(100 * F.col("n_repeat_words") / n),
    }
    return rows.withColumns({k: F.round(v * _SCALE).cast("long") for k, v in values.items()})


def _chi2_below(x: float, k: int) -> float:
    """Chi-square distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 2000):
        term *= z / (a + i)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_below(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


_X = list(STATISTICS)
_OWN = ["level", "g_lang", "g_source"]
_GROUP = [*_OWN, "start"]
_STARTS = 3


def _levels(rows: DataFrame) -> DataFrame:
    """Every row once per group it belongs to: language and source, language, all."""
    empty = F.lit("")
    at = F.array(
        F.struct(F.lit(2).alias("level"), F.col("lang").alias("g_lang"), F.col("source").alias("g_source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("g_lang"), empty.alias("g_source")),
        F.struct(F.lit(0).alias("level"), empty.alias("g_lang"), empty.alias("g_source")),
    )
    return rows.withColumn("g", F.explode(at)).select("*", "g.*").drop("g")


def _distance(estimate: DataFrame) -> tuple[DataFrame, Column]:
    """The estimate with its Cholesky factor, and the squared Mahalanobis distance as an expression over both."""
    p = len(_X)
    out = estimate
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"v{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    keep = [*_GROUP, *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)]]
    steps = []
    for i in range(p):
        rest = F.col(_X[i]) / _SCALE - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        steps.append((f"z{i}", rest / F.col(f"l{i}{i}")))
    return out.select(*keep), steps


def _measured(rows: DataFrame, estimate: DataFrame, on: list[str] = _GROUP) -> DataFrame:
    """Rows (with group columns) and their squared distance ``d2`` from the group's estimate."""
    table, steps = _distance(estimate)
    out = rows.join(table, on)
    for name, value in steps:
        out = out.withColumn(name, value)
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(_X))), F.lit(0.0))
    return out.withColumn("d2", d2).select(*rows.columns, "d2")


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(_X)) for j in range(i + 1)]


def _first_estimate(rows: DataFrame) -> DataFrame:
    """The starts of every group of ``rows`` (with _OWN): centres and covariances, one row per group and start.

    Values are thousandths in a narrow range, so the counts that medians keep stay small.
    """
    mids = rows.groupBy(*_OWN).agg(F.count(F.lit(1)).alias("n"), *[F.median(x).alias(f"c_{x}") for x in _X])
    near = rows.join(small(mids), _OWN)
    off = {x: (F.col(x) - F.col(f"c_{x}")) / _SCALE / STATISTICS[x] for x in _X}
    length = F.sqrt(sum((v * v for v in off.values()), F.lit(1e-9)))
    plain = [F.sum(F.col(x)).alias(f"s_{x}") for x in _X] + [F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i, j in _pairs()]
    # whole millionths, so that sums do not depend on their order
    signs = [F.sum(F.round(off[_X[i]] * off[_X[j]] / (length * length) * 1e6).cast("long")).alias(f"d{i}{j}") for i, j in _pairs()]
    kept = [F.first(f"c_{x}").alias(f"c_{x}") for x in _X] + [F.median(F.abs(F.col(x) - F.col(f"c_{x}"))).alias(f"a_{x}") for x in _X]
    every = near.groupBy(*_OWN).agg(F.first("n").alias("n"), *kept, *plain, *signs)
    n = F.col("n").cast("double")
    starts = []
    for k in range(_STARTS):
        cols = [((F.col(f"s_{x}") / n if k == 1 else F.col(f"c_{x}")) / _SCALE).alias(f"m{i}") for i, x in enumerate(_X)]
        for i, j in _pairs():
            least = STATISTICS[_X[i]] ** 2
            if k == 0:
                spread = F.greatest(1.4826 * F.col(f"a_{_X[i]}") / _SCALE, F.lit(STATISTICS[_X[i]]))
                v = spread * spread if i == j else F.lit(0.0)
            elif k == 1:
                v = (F.col(f"q{i}{j}") / n - F.col(f"s_{_X[i]}") / n * (F.col(f"s_{_X[j]}") / n)) / (_SCALE * _SCALE) + (least if i == j else 0.0)
            else:
                v = F.col(f"d{i}{j}") / n / 1e6 * (STATISTICS[_X[i]] * STATISTICS[_X[j]]) + (0.05 * least if i == j else 0.0)
            cols.append(v.alias(f"v{i}{j}"))
        starts.append(every.select(*_OWN, F.lit(k).alias("start"), "n", *cols))
    return starts[0].union(starts[1]).union(starts[2])


def _least_determinant(estimate: DataFrame) -> DataFrame:
    """The start of every group whose covariance has the least determinant (to nine digits; ties: the first)."""
    table, _ = _distance(estimate)
    log_det = F.round(sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(len(_X))), F.lit(0.0)), 9)
    best = table.groupBy(*_OWN).agg(F.min(F.struct(log_det.alias("log_det"), F.col("start"))).alias("b")).select(*_OWN, F.col("b.start").alias("start"))
    return estimate.join(best, _GROUP)


def _concentrate(rows: DataFrame, estimate: DataFrame, share: float, factor: float) -> DataFrame:
    """One concentration step: the next estimate from the ``share`` of rows closest to this one."""
    near = _measured(rows, estimate)
    bucket = F.floor(F.log(F.col("d2") + 1e-3) * _BUCKETS_PER_E)
    pairs = _pairs()
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)] + [F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i, j in pairs]
    by_bucket = near.groupBy(*_GROUP, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("k"), *sums)
    whole = Window.partitionBy(*_GROUP)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = by_bucket.withColumn("n", F.sum("k").over(whole)).withColumn("before", F.sum("k").over(upto) - F.col("k")).where(F.col("before") < F.ceil(F.col("n") * share))
    total = taken.groupBy(*_GROUP).agg(F.first("n").alias("n"), F.sum("k").alias("h"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(_X))], *[F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in pairs])
    h = F.col("h").cast("double")
    cols = [(F.col(f"s{i}") / h / _SCALE).alias(f"m{i}") for i in range(len(_X))]
    for i, j in pairs:
        cov = (F.col(f"q{i}{j}") / h - F.col(f"s{i}") / h * (F.col(f"s{j}") / h)) / (_SCALE * _SCALE) * factor
        least = STATISTICS[_X[i]] ** 2
        cols.append((cov + least if i == j else cov).alias(f"v{i}{j}"))
    return total.select(*_GROUP, "n", *cols)


def outliers(docs: DataFrame, share: float = 0.75, steps: int = 5, min_rows: int = 60, quantile: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, level."""
    stats = materialize(_vector(base_statistics(docs, id_col, text_col)), "rule-statistics")
    fit = _levels(stats.where(~F.col("base_failed")).select("lang", "source", *_X))
    p = len(_X)
    inner = chi2_quantile(share, p)
    factor = share / _chi2_below(inner, p + 2)
    estimate = materialize(_first_estimate(fit), "rule-start")
    every = fit.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(_STARTS)])))
    for _ in range(steps):
        estimate = materialize(_concentrate(every, estimate, share, factor), "rule-step")
    estimate = materialize(_least_determinant(estimate), "rule-estimate")
    # the narrowest group that is large enough judges a row
    sizes = estimate.select("level", "g_lang", "g_source", (F.col("n") >= min_rows).alias("enough"))
    two = sizes.where("level = 2 AND enough").select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), F.lit(True).alias("has2"))
    one = sizes.where("level = 1 AND enough").select(F.col("g_lang").alias("lang"), F.lit(True).alias("has1"))
    judged = stats.join(two, ["lang", "source"], "left").join(one, ["lang"], "left")
    level = F.when(F.col("has2"), 2).when(F.col("has1"), 1).otherwise(0)
    judged = judged.withColumn("level", level).withColumn("g_lang", F.when(F.col("level") >= 1, F.col("lang")).otherwise("")).withColumn("g_source", F.when(F.col("level") == 2, F.col("source")).otherwise("")).drop("has1", "has2")
    good = _measured(judged.where(~F.col("base_failed")), estimate, _OWN).withColumn("kept", F.col("d2") <= chi2_quantile(quantile, p))
    bad = judged.where("base_failed").withColumn("d2", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.sqrt("d2").alias("distance"), "level"]
    return good.select(*cols).union(bad.select(*cols))
