"""Command line: run a registered query, fit a sample's factor model, or fit a grid of settings.

    python -m spotloom.jobs.cli query knn_graph --tables DIR --out DIR
    python -m spotloom.jobs.cli fit --sample DIR --out DIR --set factors=8 --set start=kmeans
    python -m spotloom.jobs.cli grid --sample DIR --out DIR --grid factors=linear:4:12:3 --grid penalty=log:1e-5:1e-3:3 --grid start=choice:svd:kmeans

A sample is a folder of ``sources.io.write_sample`` with ``expression`` and ``edges``.  Spark's own settings come from spark-submit.
"""

from __future__ import annotations

import argparse
import itertools
from dataclasses import fields

import numpy as np
from pyspark.sql import SparkSession

from spotloom.operators import train
from spotloom.sources import io

_KINDS = {f.name: type(f.default) for f in fields(train.Plan) if f.default is not None}  # groups are tables, no settings


def setting(name: str, value: str):
    """``value`` in the type that the plan's field ``name`` has."""
    if name not in _KINDS:
        raise ValueError(f"unknown setting {name}; known: {', '.join(_KINDS)}")
    kind = _KINDS[name]
    return kind(float(value)) if kind is int else kind(value)


def axis(spec: str) -> tuple[str, list]:
    """(name, values) of ``name=linear:low:high:steps``, ``name=log:low:high:steps`` or ``name=choice:a:b:...``."""
    name, _, rest = spec.partition("=")
    how, *parts = rest.split(":")
    if how == "choice" and parts:
        return name, [setting(name, p) for p in parts]
    if how in ("linear", "log") and len(parts) == 3:
        low, high, steps = float(parts[0]), float(parts[1]), int(parts[2])
        values = np.linspace(low, high, steps) if how == "linear" else np.geomspace(low, high, steps)
        if _KINDS.get(name) is int:
            values = np.round(values)
        return name, list(dict.fromkeys(setting(name, repr(float(v))) for v in values))
    raise ValueError(f"cannot read {spec!r}")


def expand(specs: list[str]) -> list[dict]:
    """Every combination of the axes, the last one varying fastest."""
    axes = [axis(s) for s in specs]
    return [dict(zip([n for n, _ in axes], values, strict=True)) for values in itertools.product(*(v for _, v in axes))]


def fit_grid(spark: SparkSession, sample: str, out: str, plans: list[dict], level: int | None = None) -> None:
    """Fits the plans one after the other; models go to ``out/run=<number>``, settings and last losses to ``out/runs``."""
    expr, edges = (io.read_sample(spark, sample, n, level=level) for n in ("expression", "edges"))
    done = []
    for i, plan in enumerate(plans):
        model = train.fit(expr, edges, train.Plan(**plan))
        model.save(f"{out}/run={i}")
        done.append((i, repr(sorted(plan.items())), float(model.losses[-1])))
    spark.createDataFrame(done, "run int, settings string, loss double").coalesce(1).write.parquet(f"{out}/runs")


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="spotloom", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query", help="write the rows of a registered query")
    query.add_argument("name")
    query.add_argument("--tables", required=True)
    for name in ("fit", "grid"):
        one = commands.add_parser(name)
        one.add_argument("--sample", required=True)
        one.add_argument("--level", type=int)
        one.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
        if name == "grid":
            one.add_argument("--grid", action="append", required=True, metavar="NAME=KIND:...")
    for one in commands.choices.values():
        one.add_argument("--out", required=True)
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("spotloom").getOrCreate()
    if args.command == "query":
        from spotloom.jobs.queries import QUERIES

        if args.name not in QUERIES:
            top.error(f"unknown query {args.name}")
        QUERIES[args.name](spark, args.tables).write.parquet(args.out)
        return
    fixed = {n: setting(n, v) for n, _, v in (s.partition("=") for s in args.set)}
    plans = expand(args.grid) if args.command == "grid" else [{}]
    fit_grid(spark, args.sample, args.out, [{**fixed, **p} for p in plans], args.level)


if __name__ == "__main__":
    main()
