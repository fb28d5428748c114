"""Shared helpers: shipping the package to executors, durable cuts of lineage, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.durable import cut, drop_cut, shared_dir, spread

__all__ = ["ascii_lower", "components", "count_words", "cut", "drop_cut", "enter", "fresh", "join_hot", "on_leave", "read", "shared_dir", "ship", "spread", "text_bytes", "trim"]

ROOT = Path(__file__).resolve().parents[2]
#: Words are runs of anything but space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: In a Python worker: the operator it last ran for, and how to drop what operators keep between tasks.
_worker: dict[str, str] = {}
on_leave: list[Callable[[], object]] = []


def enter(operator: str) -> None:
    """In a Python worker: a worker that turns to another operator forgets what the last one kept between tasks."""
    if _worker.get("operator", operator) != operator:
        for forget in on_leave:
            forget()
        trim()
    _worker["operator"] = operator


def trim() -> None:
    """In a Python worker: give freed memory back to the system, which allocators otherwise keep."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows that a Python worker is handed at once: texts can be long.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers, where PYTHONPATH doesn't already do so, and bound what they are handed at once."""
    sc = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"  # this session's, for what runs later too: a bound on memory, not on results
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(sc, "_graphloom_shipped", False) or any(p and Path(p).resolve() == ROOT for p in known):
        return
    folder = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "graphloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "graphloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))  # Spark's file server hands it to every executor, new ones too
    sc._graphloom_shipped = True


def text_bytes(df: DataFrame, text: str) -> int:
    """About how large the text is: Catalyst's estimate from the files, which costs no job; where it knows nothing, the sum."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 44:
        return known
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def fresh(columns: list[str], base: str) -> str:
    """A column name that clashes with none of columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Keys that have more than one row in so many are hot.
HOT_SHARE = 256


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], times: str = "times") -> DataFrame:
    """rows with their facts, by keys of which a few may have most rows.

    facts has one row for each key and, in times, how many rows the key has; its other columns are
    added. Keys with more than one row in HOT_SHARE are fewer than HOT_SHARE, so their facts are
    broadcast and their rows stay where they are; the others meet in a shuffle."""
    total = facts.agg(F.sum(times)).first()[0] or 0
    hot = F.col(times) * HOT_SHARE > total
    some = F.broadcast(facts.where(hot).drop(times))
    rest = rows.join(F.broadcast(facts.where(hot).select(keys)), keys, "left_anti")
    return rows.join(some, keys).unionByName(rest.join(facts.where(~hot).drop(times), keys))


def components(edges: DataFrame, name: str = "links", max_rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b), both long: rows (node, component), component the least node.

    Alternating large-star and small-star steps; each round is two aggregations with partial
    sums and two equi-joins, cut to the shared folder. Only nodes with a link are returned.
    The rounds are logarithmic in the longest path; a round that changes nothing ends the loop.
    """
    edges = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    last = None
    for _ in range(max_rounds):
        sign = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sign[0] == 0 or sign == last:
            break
        last = sign
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, cut(small, name)
        drop_cut(before)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    found = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node")).distinct().join(found.select(F.col("a").alias("node")), "node", "left_anti")
    return found.select(F.col("a").alias("node"), "component").unionAll(roots.select("node", F.col("node").alias("component")))
