"""Merkle manifest of a table: one leaf per row, a tree per group, a tree over the groups' roots, a proof per row.

Leaves are numbered inside their group without one task holding a group: a range shuffle sorts all rows, and row numbers
inside a partition are shifted by the counts of the partitions before.  Runs of ``fan_out`` leaves then meet once, and
levels above shrink by that factor.

Proofs come from pointer jumping.  A node above the leaves holds a pointer to an ancestor and the segment of siblings on the
way there: first its parent and its own siblings.  In each round the table is joined with itself on the pointer; the
segments are put together and the distance doubles, so a tree of depth d takes about log2(d) rounds.  A run's leaves share
their run's segment, and only the last join brings it to them.  In a round of distance d a target is met by at most
``fan_out ** d`` nodes; where this is much, targets are few, and they are broadcast after their rows were counted.

Defined results: a null field hashes as ``-``; null groups come first, null ids first inside a group; rows of equal id are
ordered by their leaf digests, so repeated rows (equal digests) are interchangeable; empty and very long texts are hashed
whole; rows with a null id are never taken for tampered; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.scratch import discard, materialize

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A round's targets are broadcast up to this many rows (each holds at most one digest list a level).
BROADCAST_ROWS = 2048


def lower_ascii(text: Column) -> Column:
    """``text`` with A to Z lower-cased and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each as its byte count, a colon and its value, or ``-`` for null."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    """Digest of a list of digests."""
    return F.unhex(F.sha2(F.array_join(F.transform(digests, _hex), ""), 256))


def _others(digests: Column, at: Column) -> Column:
    """The list without its entry ``at`` (from 0), as one binary value."""
    return F.unhex(F.array_join(F.transform(F.filter(digests, lambda _, i: i != at), _hex), ""))


def _step(digests: Column, at: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), _others(digests, at).alias("others"))


_PATH = "array<struct<at:int,others:binary>>"


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, in hex."""
    return F.array_join(F.transform(path, lambda s: _hex(s["others"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (binary) and the siblings of its path lead to."""

    def up(below: Column, step: Column) -> Column:
        others, cut = _hex(step["others"]), step["at"] * 64
        return F.sha2(F.concat(F.substr(others, F.lit(1), cut), below, F.substr(others, cut + 1)), 256)

    return F.aggregate(path, _hex(leaf), up)


def ordered_blocks(rows: DataFrame, group: str, order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """All rows sorted into blocks, and one row per block and group: (__part, __group, __shift, size of the group).

    A row's number inside its group is ``__no + __shift`` (see ``numbered``).  Nulls come first.
    """
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = materialize(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__no", F.monotonically_increasing_id()), name)
    blocks = placed.groupBy("__part", group).agg(F.min("__no").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")
    return placed, blocks.select("__part", F.col(group).alias("__group"), shift.alias("__shift"), F.sum("__n").over(Window.partitionBy(group)).alias("size"))


def numbered(placed: DataFrame, blocks: DataFrame, group: str) -> DataFrame:
    """``placed`` with ``at``, the row's number inside its group, and the further columns of ``blocks``."""
    out = placed.withColumnRenamed(group, "__own").join(blocks.withColumnRenamed("__part", "__at"), (F.col("__part") == F.col("__at")) & F.col("__own").eqNullSafe(F.col("__group")))
    return out.withColumn("at", F.col("__no") + F.col("__shift")).drop("__part", "__at", "__no", "__shift", "__own").withColumnRenamed("__group", group)


def _climb(nodes: DataFrame, widest: int, fan_out: int, name: str) -> list[DataFrame]:
    """The levels above ``nodes`` (g, level, idx, m, digest; m nodes on the level in all of g), as families with their children."""
    levels = []
    while widest > 1:
        children = F.sort_array(F.collect_list(F.struct("idx", "digest")))
        up = nodes.where("m > 1").groupBy("g", (F.col("level") + 1).alias("level"), F.expr(f"idx div {fan_out}").alias("parent"), F.expr(f"(m + {fan_out - 1}) div {fan_out}").alias("m"))
        up = up.agg(children.alias("kids")).withColumn("kids", F.transform("kids", lambda k: k["digest"]))
        levels.append(materialize(up.select("g", "level", F.col("parent").alias("idx"), "m", "kids", _joined(F.col("kids")).alias("digest")), name))
        nodes, widest = levels[-1], -(-widest // fan_out)
    return levels


def _links(families: DataFrame, fan_out: int, top: bool, lone_group: bool) -> DataFrame:
    """One row per child: its key, the key of its parent (null where that is the root), its one-step path, its subroot if known.

    A subroot has the key (g, -1, 0); nodes of the tree over subroots have g = -1.
    """
    rows = families.select("g", "level", F.col("idx").alias("parent"), "m", "kids", "digest", F.posexplode("kids").alias("pos", "own"))
    idx, last = F.col("parent") * fan_out + F.col("pos"), F.col("m") == 1
    if top:
        first = F.col("level") == 1
        key = [F.when(first, idx).otherwise(F.lit(-1)), F.when(first, F.lit(-1)).otherwise(F.col("level") - 1), F.when(first, F.lit(0)).otherwise(idx)]
        to = [F.when(~last, F.lit(-1)), F.when(~last, F.col("level")), F.when(~last, F.col("parent"))]
    else:
        key = [F.col("g"), F.col("level") - 1, idx]
        ends = F.lit(lone_group) & last
        to = [F.when(~ends, F.col("g")), F.when(~ends, F.when(last, F.lit(-1)).otherwise(F.col("level"))), F.when(~ends, F.when(last, F.lit(0)).otherwise(F.col("parent")))]
    sub = F.when(F.lit(not top) & last, F.col("digest"))
    cast = zip([*key, *to], ["long", "int", "long"] * 2, ["g", "level", "idx", "to_g", "to_level", "to_idx"], strict=True)
    return rows.select(*[c.cast(t).alias(n) for c, t, n in cast], F.array(_step(F.col("kids"), F.col("pos"))).cast(_PATH).alias("path"), sub.alias("subroot"))


def jump(links: DataFrame, depth: int) -> DataFrame:
    """Paths to the root for all nodes of ``links``: joins with itself on the pointer until it is spent."""
    now, distance = materialize(links, "merkle-links"), 1
    while distance < depth:
        open_ = F.col("to_idx").isNotNull()
        far = now.where((F.col("level") > distance) | (F.col("level") < 0) | (F.col("g") < 0))
        far = far.select(*[F.col(c).alias(f"b_{c}") for c in now.columns])
        if far.count() <= BROADCAST_ROWS:
            far = F.broadcast(far)
        met = (F.col("to_g") == F.col("b_g")) & (F.col("to_level") == F.col("b_level")) & (F.col("to_idx") == F.col("b_idx"))
        path, subroot = F.concat("path", "b_path").alias("path"), F.coalesce("subroot", "b_subroot").alias("subroot")
        joined = now.where(open_).join(far, met).select("g", "level", "idx", *[F.col(f"b_{c}").alias(c) for c in ("to_g", "to_level", "to_idx")], path, subroot)
        was, now = now, materialize(now.where(~open_).union(joined), "merkle-links")
        discard(was)
        distance *= 2
    return now


@dataclass
class Manifest:
    """``rows``: one per input row with its leaf, subroot, path (sibling digests up to the root) and carried columns."""

    rows: DataFrame
    root: bytes | None


def manifest(leaves: DataFrame, fan_out: int = 8) -> Manifest:
    """Trees over ``leaves`` (doc_id, grp, leaf binary, row_no telling equal rows apart, any further columns)."""
    more = [c for c in leaves.columns if c not in ("grp", "row_no")]
    placed, blocks = ordered_blocks(leaves, "grp", ["doc_id", "leaf", "row_no"], "merkle-leaves")
    blocks = materialize(blocks, "merkle-blocks")
    groups = numbered(*ordered_blocks(blocks.select(F.col("__group").alias("__of"), F.lit(0).alias("all")).distinct(), "all", ["__of"], "merkle-groups"), "all")
    ranks = materialize(groups.select("__of", F.col("at").alias("g")), "merkle-ranks")
    n_groups, widest = ranks.count(), blocks.agg(F.max("size")).first()[0] or 0
    blocks = materialize(blocks.join(ranks, F.col("__group").eqNullSafe(F.col("__of"))).drop("__of"), "merkle-blocks")
    number = numbered(placed, blocks, "grp")
    run = number.groupBy("g", F.expr(f"at div {fan_out}").alias("idx")).agg(F.first("size").alias("n"), F.sort_array(F.collect_list(F.struct("at", *more))).alias("kids"))
    digest = F.when(F.col("n") == 1, F.col("kids")[0]["leaf"]).otherwise(_joined(F.transform("kids", lambda k: k["leaf"])))
    runs = materialize(run.select("g", F.lit(1).alias("level"), "idx", "n", F.expr(f"(n + {fan_out - 1}) div {fan_out}").alias("m"), "kids", digest.alias("digest")), "merkle-runs")

    base = runs.select("g", "level", "idx", "m", "digest")
    levels = _climb(base, -(-widest // fan_out), fan_out, "merkle-levels")
    subroots = base.where("m = 1")
    for level in levels:
        subroots = subroots.union(level.where("m = 1").select("g", "level", "idx", "m", "digest"))
    tops = _climb(subroots.select(F.lit(-1).cast("long").alias("g"), F.lit(0).alias("level"), F.col("g").alias("idx"), F.lit(n_groups).cast("long").alias("m"), "digest"), n_groups, fan_out, "merkle-tops")
    root = (tops[-1] if tops else subroots).select("digest").first()

    links = [_links(t, fan_out, False, n_groups == 1) for t in levels] + [_links(t, fan_out, True, False) for t in tops]
    own = F.struct(F.col("g").alias("g"), F.when(F.col("m") == 1, F.lit(-1)).otherwise(F.col("level")).alias("level"), F.when(F.col("m") == 1, F.lit(0)).otherwise(F.col("idx")).alias("idx"))
    at_run = runs.select(own.alias("own"), "n", "kids", F.when(F.col("m") == 1, F.col("digest")).alias("own_subroot"))
    if links:
        table = links[0]
        for part in links[1:]:
            table = table.union(part)
        paths = jump(table, len(levels) + len(tops))
        met = (F.col("own.g") == F.col("p.g")) & (F.col("own.level") == F.col("p.level")) & (F.col("own.idx") == F.col("p.idx"))
        at_run = at_run.join(paths.alias("p"), met, "left")
    else:
        at_run = at_run.withColumn("path", F.array().cast(_PATH)).withColumn("subroot", F.lit(None).cast("binary"))
    each = at_run.select("n", "kids", F.coalesce("own_subroot", "subroot").alias("subroot"), F.coalesce("path", F.array().cast(_PATH)).alias("upper"), F.posexplode("kids").alias("pos", "kid"))
    below = F.when(F.col("n") > 1, F.array(_step(F.transform("kids", lambda k: k["leaf"]), F.col("pos"))).cast(_PATH)).otherwise(F.array().cast(_PATH))
    return Manifest(each.select(*[F.col(f"kid.{c}").alias(c) for c in more], "subroot", F.concat(below, "upper").alias("path")), bytes(root[0]) if root else None)


def tampered_proofs(docs: DataFrame, fan_out: int = 8) -> DataFrame:
    """Proofs of all rows, and their check after the texts of a third of the ids were changed.

    Returns doc_id, leaf, subroot, root, proof_sha256 (hex, of the untampered table), folded_root (from the row's present
    leaf and its proof) and verified (whether that is the root).
    """
    tamper = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("grp"),
        leaf_digest([*head, F.col("text")]).alias("leaf"),
        F.when(tamper, leaf_digest([*head, lower_ascii(F.col("text").cast("string"))])).alias("present"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    found = manifest(materialize(leaves, "merkle-digests"), fan_out)
    root = F.lit(found.root.hex() if found.root else None).cast("string")
    folded = found.rows.select("doc_id", "leaf", "subroot", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("present", "leaf"), F.col("path")).alias("folded_root"))
    return folded.select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
