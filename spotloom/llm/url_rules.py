"""URL filter: listed rules first, then association rules mined from labelled URLs; DataFrame operations only.

A URL's tokens are its scheme, host labels, path parts, file ending and query keys (numbers count as one token).
Spark's FP-growth mines token combinations from labelled URLs, whose label is one more item of the basket; rules that
conclude the block label are pruned by support and confidence; support has an absolute floor too (``min_count`` labelled
URLs), so that on few labels a combination seen once is no rule.  The inverted index files each rule under its rarest
token; a URL looks up only its own tokens and then must hold all of a rule's.

Mining lists no combination that decides nothing (``reduced``): tokens of exactly the same labelled URLs are one item, held by a
URL with any of them; tokens too rare beside the block label are left out; a token that only blocked URLs hold is a rule
of confidence 1 by itself, and combinations with it are not listed.  The verdicts are those of all combinations, also
where labelled URLs share dozens of tokens.

Hosts and paths follow the contract of ``split_url``.  A listed rule fits its host and all subdomains if the path
starts with the rule's; of several the longest wins, and of equal lengths the first in text order.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no listed rule, and is judged by
its tokens alone; without labelled URLs, or without rules that pass the pruning, everything else is allowed; repeated
rows repeat; several labels of one id block if any does; an empty table gives an empty result; very long URLs are judged whole, by all
their tokens; columns besides the id and the URL are ignored, also those named like a result's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.functions.scratch import materialize
from spotloom.functions.small import small

BLOCK_ITEM = "=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ListedRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) between the first ``://`` and the next of ``/?#``; path from there up to ``?`` or ``#``."""
    has = F.instr(url, "://") > 0
    rest = F.when(has, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    stop = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(stop, r"^([^/]*)", 1), _UPPER, _LOWER)
    path = F.coalesce(F.regexp_extract(stop, r"^[^/]*(/[\s\S]*)$", 1), F.lit(""))
    return F.coalesce(host, F.lit("")), path


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a URL."""
    number = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    named = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind + ":"), number(x)))
    scheme = F.array(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)))
    keys = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    ending = F.array(F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1))
    parts = F.concat(named("s", scheme), named("h", F.split(host, r"\.")), named("p", F.split(path, "/")), named("q", keys), named("x", ending))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: F.length(x) > 2)))


def with_listed(pages: DataFrame, rules: Sequence[ListedRule], url_col: str = "url") -> DataFrame:
    """Adds __url, host, path, rule and listed (verdict of the longest listed rule that fits, else null)."""
    host, path = split_url(F.col("__url"))
    rows = pages.withColumn("__url", F.coalesce(F.col(url_col).cast("string"), F.lit(""))).withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):  # later, longer rules take precedence
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("listed", verdict)


def mine_rules(baskets: DataFrame, min_support: float = 0.002, min_confidence: float = 0.7, partitions: int = 16, min_count: int = 3) -> DataFrame:
    """(rule_id, tokens, confidence, support, lift) of block rules from baskets (items: array<string>).

    A rule's tokens and the block label meet in ``min_support`` of the baskets and in ``min_count`` of them at least.
    """
    empty = baskets.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double, lift double")
    n = baskets.count()
    if n < min_count:
        return empty
    min_support = max(min_support, (min_count - 0.5) / n)  # between two counts, so that rounding decides nothing
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=partitions).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BLOCK_ITEM))
    return rules.where((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)).select(
        F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("tokens"), "confidence", "support", "lift"
    )


def reduced(baskets: DataFrame, min_support: float = 0.002, min_count: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((token, item), pure rules, baskets of items) from labelled ``baskets`` (id: one a row, tokens, bad).

    An item stands for the tokens that the same baskets hold: counts of a combination depend on the items only, so a URL
    meets some combination of the tokens of several items if it holds one token of each.  Every token of a rule meets the block label
    as often as the rule does, so items below the support are dropped.  An item that only blocked baskets hold gives a
    rule of confidence 1, which no longer combination exceeds.
    """
    each = baskets.select("id", "bad", F.explode("tokens").alias("token"))
    mark = lambda seed: F.bit_xor(F.xxhash64("id", F.lit(seed)))
    count = F.count(F.lit(1)).alias("n")
    tokens = each.groupBy("token").agg(mark(1).alias("m1"), mark(2).alias("m2"), count, F.sum(F.col("bad").cast("long")).alias("n_bad"))
    whole = baskets.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad")).first()
    least = max(min_count, min_support * whole.n - 1e-6)
    same = tokens.where(F.col("n_bad") >= least).groupBy("m1", "m2", "n", "n_bad").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    groups = materialize(same.select("item", "n", "n_bad", F.explode("tokens").alias("token")), "url-items")
    share = F.col("n_bad") / F.lit(float(max(whole.n, 1)))
    pure = groups.where("n = n_bad AND token = item").select(
        F.xxhash64(F.array("item")).alias("rule_id"), F.array("item").alias("tokens"), F.lit(1.0).alias("confidence"), share.alias("support"), F.lit(whole.n / max(whole.n_bad or 0, 1)).alias("lift")
    )
    mixed = groups.where("n > n_bad AND token = item").select("item", "token")
    held = each.join(small(mixed), "token").groupBy("id").agg(F.collect_list("item").alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    left = baskets.select("id", "bad").join(held, "id", "left").select(F.when(F.col("bad"), F.concat(items, F.array(F.lit(BLOCK_ITEM)))).otherwise(items).alias("items"))
    return groups.select("token", "item"), pure, left


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence, tokens): the most confident rule of every URL (url, tokens) that any rule matches."""
    found = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    counts = found.groupBy("token").count()
    words = rules.select("rule_id", "confidence", F.col("tokens").alias("needs"), F.explode("tokens").alias("token"))
    rarest = words.join(counts, "token").groupBy("rule_id").agg(F.min(F.struct("count", "token")).alias("r"), F.first("confidence").alias("confidence"), F.first("needs").alias("needs"))
    index = rarest.select(F.col("r.token").alias("token"), "confidence", "needs")
    held = found.join(index, "token").where(F.size(F.array_intersect("tokens", "needs")) == F.size("needs"))
    best = held.groupBy("url").agg(F.max(F.struct("confidence", "needs")).alias("best"))
    return best.select("url", F.col("best.confidence").alias("confidence"), F.col("best.needs").alias("matched"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[ListedRule], bad: Column, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", min_support: float = 0.002, min_confidence: float = 0.7, min_count: int = 3) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, confidence, matched (the URL's tokens in the mined rule that decided)."""
    rows = with_listed(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")), rules)
    rows = rows.withColumn("tokens", url_tokens(F.col("__url"), F.col("host"), F.col("path")))
    rows = materialize(rows.select("page_id", F.col("__url").alias("url"), "host", "path", "rule", "listed", "tokens"), "urls")
    marks = labels.select(F.col(label_id).cast("long").alias("page_id"), F.coalesce(bad, F.lit(False)).alias("bad")).where("page_id IS NOT NULL")
    marks = marks.groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = rows.select("page_id", "tokens").join(marks, "page_id").where(F.size("tokens") > 0)
    baskets = materialize(labelled.select(F.monotonically_increasing_id().alias("id"), "tokens", "bad"), "url-baskets")
    groups, pure, left = reduced(baskets, min_support, min_count)
    mined = materialize(pure.unionByName(mine_rules(materialize(left, "url-lattice"), min_support, min_confidence, min_count=min_count)), "url-rules")
    open_urls = rows.where("listed IS NULL").select("url", "tokens").distinct()
    known = open_urls.select("url", F.explode("tokens").alias("token")).join(small(groups), "token")
    known = materialize(known.groupBy("url").agg(F.collect_list(F.struct("item", "token")).alias("held")), "url-known")
    found = matches(known.select("url", F.array_distinct(F.col("held.item")).alias("tokens")), mined).withColumnRenamed("matched", "needs")
    own = F.array_sort(F.transform(F.filter("held", lambda h: F.array_contains("needs", h["item"])), lambda h: h["token"]))
    hits = materialize(found.join(known, "url").select("url", "confidence", own.alias("matched")), "url-hits")
    out = rows.join(hits, "url", "left")
    mined_says = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("listed", mined_says).alias("verdict"),
        F.when(F.col("listed").isNull(), F.col("confidence")).alias("confidence"), F.when(F.col("listed").isNull(), F.col("matched")).alias("matched"),
    )
