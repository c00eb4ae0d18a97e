"""Coarser levels of a sample: meta-spots on a chunked grid, and the hierarchy of levels made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.functions.scratch import materialize
from spotloom.functions.small import small
from spotloom.operators.graph import bin_coordinates, bin_values, knn_graph, symmetric_edges

KEY = ["replicate", "spot_id"]


def _boxes(spots: DataFrame) -> DataFrame:
    """(replicate, x0, y0, wide, n): corner, width and size of every replicate."""
    return spots.groupBy("replicate").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("wide"), F.count(F.lit(1)).alias("n"))


def _chunk(c: str, corner: str, step):
    """Number of the chunk of a coordinate: chunks are open below, but the first holds its lower border."""
    return F.greatest(F.lit(0), F.ceil(F.try_divide(F.col(c) - F.col(corner), step)) - 1).cast("long")


def tuned_chunks(spots: DataFrame, rate: float, chunks: int) -> dict[str, int]:
    """Chunks per replicate, near ``chunks``, for which a square grid in every chunk comes close to the wanted rate.

    All candidates, less than half of ``chunks`` away, are counted in one pass; the search walks from ``chunks`` in the
    direction of the first misfit until that changes.  The driver holds one number per replicate and candidate.
    """
    reach = max(chunks // 2, 1)
    tried = F.explode(F.array(*[F.lit(c) for c in range(max(1, chunks - reach + 1), chunks + reach)]))
    placed = spots.select("replicate", "x", "y").join(small(_boxes(spots)), "replicate").withColumn("chunks", tried)
    step = F.col("wide") / F.col("chunks")
    used = placed.select("replicate", "chunks", "n", _chunk("x", "x0", step).alias("cx"), _chunk("y", "y0", step).alias("cy")).distinct()
    share = {(r.replicate, r.chunks): r.n * rate / r.used for r in used.groupBy("replicate", "chunks", "n").agg(F.count(F.lit(1)).alias("used")).collect()}
    out = {}
    for replicate in {r for r, _ in share}:
        way, now = 0, chunks
        for nudge in range(reach):
            per_chunk = share.get((replicate, chunks + way * nudge))
            if per_chunk is None:
                break
            turn = -1 if round(per_chunk**0.5) ** 2 > per_chunk else 1
            if way and turn != way:
                now = chunks + way * nudge
                break
            way, now = turn, chunks + turn * nudge
        out[replicate] = now
    return out


def chunked_grid(spots: DataFrame, rate: float, chunks: int = 2, tune: bool = True) -> DataFrame:
    """(replicate, spot_id, bin_id, gx, gy): every spot at its nearest grid point, ties by smaller column, then row.

    The width of a replicate is cut into ``chunks``; chunks without spots get no points, all others a square of
    round(sqrt(spots * rate / used chunks)) points a side, and the last column is closed at the right border.  Points of
    all chunks lie on one lattice, so a spot looks at the 16 lattice points around it, and the used chunks (a short list)
    tell which exist; no spot meets the grid as a whole.  Points that no spot is nearest to do not occur.  A replicate with
    less than two points a chunk is an error, as is one without width.
    """
    counts = tuned_chunks(spots, rate, chunks) if tune else {r.replicate: chunks for r in spots.select("replicate").distinct().collect()}
    if not counts:
        return spots.select(*KEY, F.lit(0).cast("long").alias("bin_id"), F.lit(0).cast("long").alias("gx"), F.lit(0).cast("long").alias("gy"))
    table = spots.sparkSession.createDataFrame(list(counts.items()), f"replicate {spots.schema['replicate'].dataType.simpleString()}, chunks int")
    box = _boxes(spots).join(F.broadcast(table), "replicate").withColumn("step", F.col("wide") / F.col("chunks"))
    placed = spots.select(*KEY, "x", "y").join(small(box), "replicate").withColumn("cx", _chunk("x", "x0", F.col("step"))).withColumn("cy", _chunk("y", "y0", F.col("step")))
    placed = placed.withColumn("cx", F.least("cx", (F.col("chunks") - 1).cast("long")))
    used = small(placed.select("replicate", "cx", "cy").distinct())
    size = small(used.join(box, "replicate").groupBy("replicate").agg((F.first("n") * rate / F.count(F.lit(1))).alias("share")))
    poor = [r.replicate for r in size.join(box.where("wide = 0"), "replicate", "left_semi").collect()] + [r.replicate for r in size.where("share < 2").collect()]
    if poor:
        raise ValueError(f"fewer than two grid points a chunk in {sorted(set(map(str, poor)))[:5]}")
    side = F.round(F.sqrt("share")).cast("long")
    at = placed.join(size.select("replicate", side.alias("side")), "replicate").withColumn("h", F.col("step") / F.col("side"))
    near = lambda c, corner: F.floor((F.col(c) - F.col(corner)) / F.col("h")).cast("long")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-1, 3) for j in range(-1, 3)])
    seen = at.withColumn("s", F.explode(steps)).withColumn("gx", near("x", "x0") + F.col("s.i")).withColumn("gy", near("y", "y0") + F.col("s.j")).where("gx >= 0 AND gy >= 0")
    last = (F.col("chunks") * F.col("side")).cast("long")
    seen = seen.select(*KEY, "x", "y", "x0", "y0", "h", "gx", "gy", F.when(F.col("gx") == last, F.col("chunks") - 1).otherwise(F.floor(F.col("gx") / F.col("side"))).cast("long").alias("cx"), F.floor(F.col("gy") / F.col("side")).cast("long").alias("cy"))
    dx, dy = F.col("x") - (F.col("x0") + F.col("gx") * F.col("h")), F.col("y") - (F.col("y0") + F.col("gy") * F.col("h"))
    best = seen.join(used, ["replicate", "cx", "cy"], "left_semi").groupBy(*KEY).agg(F.min(F.struct(F.round(dx * dx + dy * dy, 12).alias("d2"), "gx", "gy")).alias("b"))
    return best.select(*KEY, F.shiftleft(F.col("b.gx"), 31).bitwiseOR(F.col("b.gy")).alias("bin_id"), F.col("b.gx").alias("gx"), F.col("b.gy").alias("gy"))


def hierarchy(spots: DataFrame, expr: DataFrame, levels: int, rate: float, chunks: int = 2, k: int = 6, tune: bool = True) -> dict[str, DataFrame]:
    """Tables of all levels, each with ``level`` (0: the spots themselves): ``spots`` (replicate, spot_id, x, y, level),
    ``expression`` (replicate, spot_id, gene, value, level), ``edges`` (symmetric neighbours) and ``bins`` (replicate, level,
    bin_id, spot_id: which spots of the level below a spot of ``level`` stands for).

    A level's spots are the meta-spots of the one below: mean positions, summed expression, neighbours anew.  Levels are
    written once each; ``io.write_sample`` keeps them apart by partition.
    """
    at, cells = spots.select(*KEY, "x", "y"), expr.select(*KEY, "gene", "value")
    found: dict[str, list[DataFrame]] = {"spots": [], "expression": [], "edges": [], "bins": []}
    for level in range(levels):
        if level:
            grid = materialize(chunked_grid(at, rate, chunks, tune), "level-bins")
            found["bins"].append(grid.select("replicate", "bin_id", "spot_id", F.lit(level).alias("level")))
            at = materialize(bin_coordinates(at, grid).select("replicate", F.col("bin_id").alias("spot_id"), "x", "y"), "level-spots")
            cells = materialize(bin_values(cells, grid, "gene").select("replicate", F.col("bin_id").alias("spot_id"), "gene", "value"), "level-expression")
        found["spots"].append(at.withColumn("level", F.lit(level)))
        found["expression"].append(cells.withColumn("level", F.lit(level)))
        found["edges"].append(symmetric_edges(knn_graph(at, k)).withColumn("level", F.lit(level)))
    out = {}
    for name, parts in found.items():
        for i, part in enumerate(parts):
            out[name] = out[name].unionByName(part) if i else part
    return out


def rebin_expression(expr: DataFrame, bins: DataFrame) -> DataFrame:
    """(replicate, spot_id, gene, value, level): raw expression put back on all levels of a sample saved without it.

    ``expr`` (replicate, spot_id, gene, value) belongs to level 0; ``bins`` is the table of ``hierarchy``.  A spot's bin on every
    level follows from the bins below, so each level is one sum of the raw values and none waits for the one below."""
    out = expr.select(*KEY, "gene", "value", F.lit(0).alias("level"))
    top = bins.agg(F.max("level")).first()[0] or 0
    chain = None
    for level in range(1, top + 1):
        step = bins.where(F.col("level") == level).select("replicate", F.col("spot_id").alias("below"), "bin_id")
        if chain is None:
            chain = step.withColumnRenamed("below", "spot_id")
        else:
            chain = chain.withColumnRenamed("bin_id", "below").join(step, ["replicate", "below"]).drop("below")
        cells = bin_values(expr.select(*KEY, "gene", "value"), chain, "gene")
        out = out.unionByName(cells.select("replicate", F.col("bin_id").alias("spot_id"), "gene", "value", F.lit(level).alias("level")))
    return out
