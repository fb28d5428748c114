"""New and changed files as a stream: each micro-batch goes through the incremental merge."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.durable import cut, publish, published
from graphloom.operators.graph import call_edges, contains_edges, nested_edges
from graphloom.operators.maintain import merge
from graphloom.sources.corpus import stream_files
from graphloom.sources.parse import parse_files, tables

TABLES = ("files", "symbols", "occurrences", "edges")


def file_table(scanned: DataFrame) -> DataFrame:
    return scanned.select(F.xxhash64("rel_path").alias("id"), "rel_path", "mtime_ms", F.col("bytes").alias("size_bytes"), "content_hash", F.lit("Success").alias("parse_status"))


def load(spark: SparkSession, root: str, below: int | None = None) -> dict[str, DataFrame]:
    """The latest version's tables (below: of those before that version); {} if there is none."""
    found = [folder for v, folder in published(spark, root) if below is None or v < below]
    return {t: spark.read.parquet(f"{root}/{found[-1]}/{t}") for t in TABLES} if found else {}


def apply_batch(spark: SparkSession, scanned: DataFrame, root: str, version: int) -> None:
    """Write version `version` of the tables from the latest one below it, into a folder of its own; a marker makes it visible whole.

    A batch that runs again starts from the same version and gives the same tables; its marker
    takes the place of the earlier one, whose folder is not touched."""
    files = file_table(scanned)
    parsed_rows = cut(parse_files(scanned), "parsed")
    symbols, occurrences = tables(parsed_rows, files)
    failed = parsed_rows.where("row = 'failed'").select(F.xxhash64("rel_path").alias("file_id")).distinct()
    old = load(spark, root, below=version)
    if not old:
        contains = contains_edges(symbols)
        symbols = symbols.join(contains.select(F.col("child_id").alias("id"), F.col("parent_id").alias("parent_symbol_id")), "id", "left")
        bad = files.join(failed.select(F.col("file_id").alias("id"), F.lit(True).alias("bad")), "id", "left")
        files = bad.withColumn("parse_status", F.when(F.col("bad"), "Failed").otherwise(F.col("parse_status"))).drop("bad")
        out = {"files": files, "symbols": symbols, "occurrences": occurrences, "edges": call_edges(occurrences, symbols).unionByName(nested_edges(contains))}
    else:
        out = merge(old, {"files": files, "symbols": symbols, "occurrences": occurrences}, files.select(F.col("id").alias("file_id")), failed)
    folder = f"v{version}-{uuid.uuid4().hex[:12]}"
    for t in TABLES:
        out[t].write.parquet(f"{root}/{folder}/{t}")
    publish(spark, root, version, folder)


def follow(spark: SparkSession, source: str, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the tables under root up with the files under source."""

    def batch(df: DataFrame, epoch: int) -> None:
        if not df.isEmpty():
            apply_batch(df.sparkSession, df, root, epoch)

    writer = stream_files(spark, source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def usage_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Usage counts per tool and window of event time, streaming or not: an extension of the usage statistics."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "tool").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("failed").cast("long")).alias("errors"))
