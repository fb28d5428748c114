"""Cuts of lineage in the folder that all executors share, so that losing one loses no work."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, types as T

_cuts: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and all tasks run on this machine."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    return f"file:///tmp/checkpoints/graphloom-{sc.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _cuts:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; its shared folder is then the cluster's to clear
            return


def cut(df: DataFrame, name: str = "cut", compact: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive any executor.

    compact: rows that are few or narrow against the work that made them move once more, so that
    AQE writes files of its advisory size instead of one for each task."""
    if compact:
        df = df.hint("rebalance")
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _cuts.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Layers:
    """Rows that a loop adds layer by layer, in one shared folder: reading all of them is one scan, however many there are."""

    def __init__(self, first: DataFrame, by: str, name: str = "layers"):
        self.spark, self.by, self.schema = first.sparkSession, by, first.schema
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        _cuts.append((self.spark, self.path))
        self.n = 0
        self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """Write the next layer; returns it as written."""
        at = f"{self.path}/{self.by}={self.n}"
        rows.write.parquet(at)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(at)

    def all(self) -> DataFrame:
        """Every layer's rows, with the layer's number in column `by`."""
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(self.by, T.IntegerType())])).parquet(self.path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of fewer parts than there are cores to all of them, before work that costs much per row.

    Inputs of many parts, and frames that already were dealt out, stay as they are: at size this
    is no shuffle at all."""
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if plan.toRdd().getNumPartitions() >= cores else df.repartition(cores)


def release(spark: SparkSession) -> None:
    """Delete all cuts made so far: for a driver that lives on, once the output of what it ran is written and nothing will read these frames again."""
    while _cuts:
        _delete(*_cuts.pop())


def drop_cut(df: DataFrame) -> None:
    """Remove the files behind a frame that cut() returned and that nothing will read again."""
    parents = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for item in [x for x in _cuts if x[1].rsplit("/", 1)[1] in parents]:
        _delete(*item)
        _cuts.remove(item)


def published(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """Whole versions under root in order: number and folder. Folders without a marker are left from attempts that failed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName().partition("=") for s in fs.listStatus(at)]
    return sorted((int(n), folder) for n, _, folder in names if folder)


def publish(spark: SparkSession, root: str, n: int, folder: str) -> None:
    """Make a written folder version n; an earlier marker of that number goes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    earlier = [f for v, f in published(spark, root) if v == n]
    marker = path(f"{root}/versions/{n}={folder}")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.create(marker, True).close()
    for f in earlier:
        fs.delete(path(f"{root}/versions/{n}={f}"), False)


ROOT = Path(__file__).resolve().parents[1]


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers, where PYTHONPATH doesn't already do so: Spark's file server hands it to every executor, new ones too."""
    sc = spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(sc, "_graphloom_shipped", False) or any(p and Path(p).resolve() == ROOT for p in known):
        return
    folder = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "graphloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "graphloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._graphloom_shipped = True
