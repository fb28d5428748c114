"""python -m graphloom COMMAND ROOT [ARGUMENT]: build, info, symbols, callers, callees, slice, retrieve, tree, summary, render."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.plans.retrieve import Options
from graphloom.session import local


def main() -> None:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("command", choices=["build", "info", "symbols", "callers", "callees", "slice", "slice-tree", "context", "retrieve", "update", "state", "coverage", "tree", "summary", "render"])
    p.add_argument("root")
    p.add_argument("argument", nargs="?", default="")
    p.add_argument("--index", help="folder of the tables; build writes them, the others read them")
    p.add_argument("--strategy", default="graph")
    p.add_argument("--mode", default="smart")
    p.add_argument("--budget", type=int, default=12_000)
    a = p.parse_args()
    spark = local()
    if a.command in ("tree", "summary", "render", "coverage"):
        engine = Engine(spark, {}, a.root)
        out = {"tree": lambda: engine.tree(a.mode), "summary": lambda: engine.summary(a.mode), "render": lambda: engine.render(a.argument or "markdown", a.mode), "coverage": engine.coverage}[a.command]()
    else:
        if a.command == "update" and a.index:
            engine = Engine.ensure_fresh(spark, a.root, a.index, progress=print)
        else:
            engine = Engine.load(spark, a.index, a.root) if a.index and a.command != "build" else Engine.build(spark, a.root, progress=print)
        if a.command == "build" and a.index:
            engine = engine.save(a.index)
        one = lambda: engine.symbols(a.argument, 1).select(F.col("id")).first()["id"]
        out = {
            "build": engine.info, "info": engine.info, "symbols": lambda: engine.symbols(a.argument), "callers": lambda: engine.callers(one()), "callees": lambda: engine.callees(one()),
            "update": engine.info, "state": engine.state, "slice": lambda: engine.slice(one()), "slice-tree": lambda: engine.slice_tree(one()).orderBy("place"), "context": lambda: engine.around(one()).select("markdown"), "retrieve": lambda: engine.retrieve(a.argument, a.strategy, Options(budget=a.budget)),
        }[a.command]()
    out.show(200, False)


if __name__ == "__main__":
    main()
