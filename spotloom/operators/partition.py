"""Partition of a neighbour graph into bins of equal size by matching, contraction and balanced moves at the boundary.

Matched nodes are contracted level by level until no edge is left, which gives a tree; on the way down every pair is laid out
with the end that holds more edges to its sibling beside that sibling.  The order of the leaves is cut into runs of equal size,
and then spots at a boundary move to the bin that holds more of their neighbours, as far as the sizes allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.scratch import discard, materialize
from spotloom.functions.small import small


def _matched(nodes: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """(n, parent): nodes whose heaviest edge (weight over the product of the ends' sizes) is their neighbour's heaviest too.

    Edges are in one order for both ends, so the heaviest of all is always matched."""
    size = lambda c: nodes.select(F.col("n").alias(c), F.col("size").alias(f"{c}_size"))
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    rated = edges.join(size("src"), "src").join(size("dst"), "dst")
    rank = F.struct((F.col("w") / (F.col("src_size") * F.col("dst_size"))).alias("rate"), F.xxhash64(low, high, F.lit(level)).alias("tie"), low.alias("low"), high.alias("high"))
    best = rated.groupBy(F.col("src").alias("n")).agg(F.max(rank).alias("best")).select("n", "best.low", "best.high")
    pairs = best.groupBy("low", "high").agg(F.count(F.lit(1)).alias("ends")).where("ends = 2")
    return pairs.select(F.explode(F.array("low", "high")).alias("n"), F.col("low").alias("parent"))


def _contractions(nodes: DataFrame, edges: DataFrame, levels: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """([(nodes with their parent, edges) of every level], nodes of the top, which have no edges)."""
    steps: list[tuple[DataFrame, DataFrame]] = []
    for level in range(levels):
        if edges.isEmpty():
            return steps, nodes
        up = materialize(nodes.join(_matched(nodes, edges, level), "n", "left").withColumn("parent", F.coalesce("parent", "n")), "cut-nodes")
        steps.append((up, edges))
        end = lambda c, up=up: up.select(F.col("n").alias(c), F.col("parent").alias(f"{c}_up"))
        above = edges.join(end("src"), "src").join(end("dst"), "dst").where("src_up <> dst_up")
        edges = materialize(above.groupBy(F.col("src_up").alias("src"), F.col("dst_up").alias("dst")).agg(F.sum("w").alias("w")), "cut-edges")
        nodes = up.groupBy("replicate", F.col("parent").alias("n")).agg(F.sum("size").alias("size"))
    raise RuntimeError(f"edges are left after {levels} contractions")


def _roots(nodes: DataFrame, buckets: int = 1024) -> DataFrame:
    """(replicate, n, size, start): running sums of sizes over a replicate's top nodes, by bucket and then inside it."""
    dealt = nodes.withColumn("bucket", F.pmod(F.xxhash64("n"), F.lit(buckets)))
    before = Window.partitionBy("replicate").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("replicate", "bucket").agg(F.sum("size").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    inside = Window.partitionBy("replicate", "bucket").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(sums, ["replicate", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).select("replicate", "n", "size", "start")


def graph_order(nodes: DataFrame, edges: DataFrame, levels: int = 200) -> DataFrame:
    """(replicate, n, start): places from 0 of the nodes (replicate, n, size) of a replicate, neighbours near each other.

    ``edges`` (src, dst, w) hold both directions and no loops."""
    steps, top = _contractions(nodes, edges, levels)
    now = materialize(_roots(top).select("replicate", "n", "start", F.lit(None).cast("long").alias("sibling"), F.lit(True).alias("first")), "cut-places")
    for up, below in reversed(steps):
        placed = up.join(now.select(F.col("n").alias("parent"), "start", "sibling", "first"), "parent")
        target = up.select(F.col("n").alias("dst"), F.col("parent").alias("sibling"))
        link = below.join(placed.select(F.col("n").alias("src"), "sibling"), "src").join(target, ["dst", "sibling"]).groupBy(F.col("src").alias("n")).agg(F.sum("w").alias("link"))
        rows = placed.join(link, "n", "left").withColumn("link", F.coalesce("link", F.lit(0.0)))
        pair = Window.partitionBy("parent")
        # a pair before its sibling ends with the node that is tied to the sibling more, one behind it starts with it
        place = F.struct(F.when(F.col("first"), F.col("link")).otherwise(-F.col("link")), "n")
        rows = rows.withColumn("early", F.row_number().over(pair.orderBy(place)) == 1).withColumn("both", F.count(F.lit(1)).over(pair) == 2)
        rows = rows.withColumn("other", F.sum("n").over(pair) - F.col("n")).withColumn("rest", F.sum("size").over(pair) - F.col("size"))
        start = F.when(F.col("early"), F.col("start")).otherwise(F.col("start") + F.col("rest"))
        after = rows.select("replicate", "n", start.alias("start"), F.when(F.col("both"), F.col("other")).otherwise(F.col("sibling")).alias("sibling"), F.when(F.col("both"), F.col("early")).otherwise(F.col("first")).alias("first"))
        table = materialize(after, "cut-places")
        discard(now)
        now = table
    return now.select("replicate", "n", "start")


def _steps(parts: DataFrame, edges: DataFrame, turn: int) -> DataFrame:
    """(n, target): moves that lower the cut and keep all sizes within (least, most); no two of them are neighbours."""
    size = parts.groupBy("replicate", "part").agg(F.count(F.lit(1)).alias("size"))
    near = edges.join(parts.select(F.col("n").alias("dst"), F.col("part").alias("target")), "dst").groupBy(F.col("src").alias("n"), "target").agg(F.sum("w").alias("k"))
    rows = near.join(parts, "n").join(size, ["replicate", "part"])
    rows = rows.join(size.select("replicate", F.col("part").alias("target"), F.col("size").alias("there")), ["replicate", "target"])
    held = F.coalesce(F.max(F.when(F.col("target") == F.col("part"), F.col("k"))), F.lit(0.0))
    open_to = (F.col("target") != F.col("part")) & (F.col("there") < F.col("most")) & (F.col("size") > F.col("least"))
    best = F.max(F.when(open_to, F.struct("k", F.xxhash64("target", F.lit(turn)).alias("tie"), "target", "there")))
    wish = rows.groupBy("replicate", "n", "part", "size", "least", "most").agg(held.alias("held"), best.alias("best"))
    wish = wish.withColumn("gain", F.col("best.k") - F.col("held")).where("gain > 0").withColumn("rank", F.struct("gain", F.xxhash64("n", F.lit(turn)).alias("tie"), "n"))
    end = lambda c: wish.select(F.col("n").alias(c), F.col("rank").alias(f"{c}_rank"))
    beaten = edges.join(end("src"), "src").join(end("dst"), "dst").where("src_rank < dst_rank").select(F.col("src").alias("n")).distinct()
    free = wish.join(beaten, "n", "left_anti").select("replicate", "n", "part", "size", "least", "most", "rank", "best.target", "best.there")
    into = F.row_number().over(Window.partitionBy("replicate", "target").orderBy(F.desc("rank")))
    out = F.row_number().over(Window.partitionBy("replicate", "part").orderBy(F.desc("rank")))
    fits = free.withColumn("into", into).withColumn("out", out).where("into <= most - there AND out <= size - least")
    return fits.select("n", "target")


def _improved(parts: DataFrame, edges: DataFrame, turns: int) -> DataFrame:
    """``parts`` (replicate, n, part, least, most) after at most ``turns`` rounds of moves; fewer where none is left."""
    now = parts
    for turn in range(turns):
        moves = materialize(_steps(now, edges, turn), "cut-moves")
        if moves.isEmpty():
            break
        after = materialize(now.join(moves, "n", "left").withColumn("part", F.coalesce("target", "part")).drop("target"), "cut-parts")
        discard(moves)
        if now is not parts:
            discard(now)
        now = after
    return now


def partition_graph(spots: DataFrame, edges: DataFrame, share: float = 0.2, slack: float = 0.1, turns: int = 30) -> DataFrame:
    """(replicate, spot_id, bin_id): round(``share`` x spots) bins (one at least) of every replicate, of about equal size, that
    cut few of ``edges`` (replicate, src, dst; both directions).

    A bin holds between floor((1 - slack) x mean) and ceil((1 + slack) x mean) spots, whatever the graph.  A round of moves
    lowers the number of cut edges by the sum of its moves' gains; rounds end when no move is left, or after ``turns``.
    Repeated edges count as often; loops, and edges of spots that are not in ``spots``, are not counted; spots without edges
    fill up bins."""
    named = materialize(spots.select("replicate", "spot_id").distinct().withColumn("n", F.monotonically_increasing_id()), "cut-spots")
    end = lambda c: named.select("replicate", F.col("spot_id").alias(c), F.col("n").alias(f"{c}_n"))
    pairs = edges.select("replicate", "src", "dst").join(end("src"), ["replicate", "src"]).join(end("dst"), ["replicate", "dst"]).where("src_n <> dst_n")
    pairs = materialize(pairs.groupBy(F.col("src_n").alias("src"), F.col("dst_n").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w")), "cut-edges")
    order = graph_order(named.select("replicate", "n", F.lit(1).cast("long").alias("size")), pairs)
    total = named.groupBy("replicate").agg(F.count(F.lit(1)).alias("total")).withColumn("bins", F.greatest(F.lit(1), F.round(F.col("total") * share)).cast("long"))
    mean = F.col("total") / F.col("bins")
    total = total.withColumn("least", F.floor(mean * (1 - slack) + 1e-9)).withColumn("most", F.ceil(mean * (1 + slack) - 1e-9))
    parts = order.join(small(total), "replicate").select("replicate", "n", F.floor(F.col("start") * F.col("bins") / F.col("total")).alias("part"), "least", "most")
    found = _improved(materialize(parts, "cut-parts"), pairs, turns)
    return named.join(found.select("n", F.col("part").alias("bin_id")), "n").select("replicate", "spot_id", "bin_id")


def cut_edges(bins: DataFrame, edges: DataFrame) -> DataFrame:
    """(replicate, edges, cut): edges of every replicate and those between two bins, a direction each."""
    end = lambda c: bins.select("replicate", F.col("spot_id").alias(c), F.col("bin_id").alias(f"{c}_bin"))
    both = edges.join(end("src"), ["replicate", "src"]).join(end("dst"), ["replicate", "dst"])
    return both.groupBy("replicate").agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("src_bin") != F.col("dst_bin"), True)).alias("cut"))
