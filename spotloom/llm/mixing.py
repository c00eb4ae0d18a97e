"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The corpus is a tree: domain, then language, then source.  A node's capacity is its tokens times ``max_epochs``.  The
token budget flows down: at every node it is dealt to the children by weight, and a child that cannot fill its part
gets its capacity while its siblings share the rest by their weights.  As a node never receives more than its subtree
holds, a shortage is met by siblings first and reaches other branches only when all siblings are full.

A leaf takes whole epochs while its budget lasts, then the prefix of one more epoch, in that epoch's seeded order (MD5
of seed, epoch and id), as long as the running token count stays within the budget.  The running count is exact without one
task sorting a leaf: hash buckets of the order are summed first, and rows are ranked only inside their bucket.

Defined results: null or unlisted language, source or domain are names like any other (null as the empty string);
unlisted names have weight ``default_weight``; a text without words has no tokens and is taken with its leaf's prefix;
repeated rows count as separate rows, ordered by id and then tokens; an empty table gives an empty result; extra
columns are ignored.  Rounding down leaves less than one token per child unspent.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.scratch import materialize
from spotloom.functions.text import text_of, words_of


@dataclass(frozen=True)
class Plan:
    """Whole-number weights per level, and the budget as a fraction (numerator, denominator) of all tokens."""

    domain_weights: Mapping[str, int] = field(default_factory=dict)
    lang_weights: Mapping[str, int] = field(default_factory=dict)
    source_weights: Mapping[str, int] = field(default_factory=dict)
    default_weight: int = 1
    budget: tuple[int, int] = (1, 2)
    max_epochs: int = 2
    seed: int = 42


def _weight(name: str, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    if weights:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        out = F.coalesce(F.element_at(table, F.col(name)), out)
    return out.cast("decimal(38,0)")


def deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``alloc`` to children (``parent`` columns, ``name``, w > 0, cap; budget of the parent on each row).

    Children in order of capacity per weight are full as long as their fair part of what is left covers them; the rest
    share by weight.  All sums are exact whole numbers.
    """
    up = Window.partitionBy(*parent).orderBy((F.col("cap").cast("double") / F.col("w").cast("double")), F.col(name))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    dec = "decimal(38,0)"
    rows = nodes.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(dec)).withColumn("w_left", (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).cast(dec))
    rows = rows.withColumn("full", (F.col("cap") * F.col("w_left")) <= (F.col("w") * (F.col("budget") - F.col("cap_before"))))
    rows = rows.withColumn("cap_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)).cast(dec)).withColumn("w_open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(whole), F.lit(1)).cast(dec))
    part = F.expr("cast(w * (budget - cap_full) as decimal(38,0)) div w_open").cast(dec)
    return rows.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(part).cast(dec)).drop("cap_before", "w_left", "full", "cap_full", "w_open")


def leaf_budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """(domain, lang, source, tokens) to the same rows with ``budget``; one small row per leaf, none per document."""
    dec = "decimal(38,0)"
    caps = leaves.withColumn("cap", (F.col("tokens") * plan.max_epochs).cast(dec))
    num, den = plan.budget
    domains = caps.groupBy("domain").agg(F.sum("cap").cast(dec).alias("cap"), F.sum("tokens").alias("t")).withColumn("w", _weight("domain", plan.domain_weights, plan.default_weight))
    top = Window.partitionBy("root")
    whole = F.expr(f"cast(t_all * {num} as decimal(38,0)) div {den}")
    one = domains.withColumn("root", F.lit(0)).withColumn("t_all", F.sum("t").over(top)).withColumn("budget", F.least(whole.cast(dec), F.sum("cap").over(top)).cast(dec))
    one = deal(one, ["root"], "domain").select("domain", F.col("alloc").alias("budget"))
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").cast(dec).alias("cap")).withColumn("w", _weight("lang", plan.lang_weights, plan.default_weight))
    two = deal(langs.join(one, "domain"), ["domain"], "lang").select("domain", "lang", F.col("alloc").alias("budget"))
    three = caps.withColumn("w", _weight("source", plan.source_weights, plan.default_weight)).join(two, ["domain", "lang"])
    return deal(three, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", F.col("alloc").cast("long").alias("leaf_budget"))


def token_count(text_col: str) -> Column:
    """Number of words of a text, the unit of all budgets."""
    return F.size(words_of(text_of(text_col))).cast("long")


def mix(docs: DataFrame, domain: Column, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, domain, lang, source, n_tokens, leaf_budget, copies (how often the row is taken, 0 for not)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(domain.cast("string"), F.lit("")).alias("domain"),
        name("lang").alias("lang"),
        name("source").alias("source"),
        token_count(text_col).alias("n_tokens"),
    )
    rows = materialize(rows, "mix-tokens")
    leaf = ["domain", "lang", "source"]
    budgets = materialize(leaf_budgets(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), plan), "mix-budgets")
    budgets = budgets.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("leaf_budget div tokens")).otherwise(F.lit(0))).withColumn("rest", F.col("leaf_budget") - F.col("epochs") * F.col("tokens"))
    order = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), (F.col("epochs") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = rows.join(budgets.drop("tokens"), leaf).withColumn("place", order).withColumn("bucket", F.substring("place", 1, 3))
    placed = materialize(placed, "mix-placed")
    sums = placed.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("n"))
    up = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(sums.select(*leaf, "bucket", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("before")), "mix-buckets")
    inside = Window.partitionBy(*leaf, "bucket").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    taken = placed.join(before, [*leaf, "bucket"]).withColumn("until", F.col("before") + F.sum("n_tokens").over(inside))
    copies = F.col("epochs") + F.when((F.col("until") <= F.col("rest")) & (F.col("epochs") < plan.max_epochs), 1).otherwise(0)
    return taken.select("doc_id", *leaf, "n_tokens", "leaf_budget", copies.cast("long").alias("copies"))
