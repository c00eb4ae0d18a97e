import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.llm import quality_rules as qr


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def rows_of(seed, n=500):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(20, 200)):
            text += word() + rng.choice([" ", " ", " ", " ", "\n", "  "])
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None])))
    for i in range(20):
        rows.append((1000 + i, " ".join(word() + "***" + "$$" for _ in range(100)), "en", "s1"))
    line = "this line comes again and is long enough\n"
    rows += [(2000, None, "en", "s1"), (2001, "", None, None), (2002, "nine words only a b c d e f", "en", "s1"), (2003, line * 9, "en", "s1"), (2004, "go " * 30_000, "en", "s2")]
    rows += [(5, *rows[5][1:]), (None, *rows[6][1:]), (2005, "a b c d e f a b c d e x y z " * 2, "xx", "rare"), (2006, line + "x\x0by z\n" + line + rows[7][1], "en", "s1")]
    return rows


def test_base_columns_and_outliers(spark):
    rows = rows_of(1)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, level int, d2 string")
    got = qr.outliers(docs.repartition(5)).collect()
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr)
    assert found == sorted(((i, *base(t)) for i, t, _, _ in rows), key=repr)
    kept = {r.doc_id: r.kept for r in got if r.doc_id is not None}
    assert not any(kept[1000 + i] for i in range(20))
    assert sum(kept[i] for i in range(500)) >= 495
    assert not any(r.kept for r in got if r.base_failed)
    again = qr.outliers(docs.repartition(11)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert qr.outliers(docs.limit(0)).collect() == []


def test_small_tables_use_the_group_of_all_rows(spark):
    docs = spark.createDataFrame(rows_of(2, 12)[:12], "doc_id long, text string, lang string, source string")
    assert {r.level for r in qr.outliers(docs).collect()} == {0}


def test_chi_square_quantiles():
    for p in (0.5, 0.75, 0.975):
        import math

        assert qr.chi2_quantile(p, 2) == pytest.approx(-2 * math.log(1 - p))  # two degrees: an exponential


def concentrated(x, mean, cov, share, steps, factor):
    """Concentration steps on all rows at once, by sorting distances."""
    least = np.array(list(qr.STATISTICS.values())) ** 2
    for _ in range(steps):
        d = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)
        near = x[np.argsort(d, kind="stable")[: math.ceil(share * len(x))]]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * factor + np.diag(least)
    return mean, cov


def test_verdicts_against_brute_force(spark):
    """The least determinant of the starts, and the verdicts, of steps that sort all rows of a group."""
    rng = np.random.default_rng(4)
    good = rng.multivariate_normal([5, 1.6, 0.4, 0.2, 0.3], np.diag([0.5, 0.04, 0.2, 0.1, 0.1]) + 0.02, 700)
    bad = rng.multivariate_normal([2.5, 2.6, 3.5, 3.0, 3.0], np.eye(5) * 0.05, 200)
    x = np.round(np.concatenate((good, bad)) * 1000) / 1000
    rows = spark.createDataFrame([(0, "", "", *(int(round(v * 1000)) for v in r)) for r in x], "level int, g_lang string, g_source string, " + ", ".join(f"{c} long" for c in qr.STATISTICS))
    share, p = 0.75, 5
    factor = share / qr._chi2_below(qr.chi2_quantile(share, p), p + 2)
    first = qr._first_estimate(rows)
    every = rows.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    estimate = first
    for _ in range(5):
        estimate = qr.materialize(qr._concentrate(every, estimate, share, factor), "t")
    best = qr._least_determinant(estimate).first()

    def matrix(r):
        cov = np.zeros((5, 5))
        for i, j in qr._pairs():
            cov[i, j] = cov[j, i] = r[f"v{i}{j}"]
        return np.array([r[f"m{i}"] for i in range(5)]), cov

    found = [matrix(r) for r in first.orderBy("start").collect()]
    middle = np.median(x, axis=0)
    assert np.allclose(found[0][0], middle) and np.allclose(found[1][0], x.mean(axis=0))
    ends = [concentrated(x, m, c, share, 5, factor) for m, c in found]
    dets = [np.linalg.slogdet(c)[1] for _, c in ends]
    assert np.linalg.slogdet(matrix(best)[1])[1] == pytest.approx(min(dets), abs=0.1)
    limit = qr.chi2_quantile(0.9999, p)
    mean, cov = ends[int(np.argmin(dets))]
    want = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1) <= limit
    mean, cov = matrix(best)
    got = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1) <= limit
    assert (got == want).mean() > 0.995 and not got[700:].any() and got[:700].mean() > 0.98
    log_dets = [np.linalg.slogdet(matrix(r)[1])[1] for r in estimate.collect()]
    assert np.linalg.slogdet(matrix(best)[1])[1] == pytest.approx(min(log_dets))
