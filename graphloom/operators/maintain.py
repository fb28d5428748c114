"""Index maintenance: diff, state, affected rows, incremental merge, cascades, invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.text import callee_name
from graphloom.operators.graph import call_edges, contains_edges, nested_edges
from graphloom.sources.schemas import SCHEMA_VERSION

SET_NULL = "to_symbol_id"
#: Metadata keys in the order in which they are compared, and the reason each gives.
COMPATIBILITY = [
    ("schema_version", "SchemaVersionChanged"), ("chunk_builder_version", "ChunkBuilderVersionChanged"), ("indexer_version", "IndexerVersionChanged"), ("parser_config_hash", "ParserConfigChanged"),
    ("resolver_id", "ResolverChanged"), ("resolver_version", "ResolverVersionChanged"), ("resolver_config_hash", "ResolverConfigChanged"),
    ("change_detection_strategy", "ChangeDetectionChanged"), ("base_index_ready", "BaseIndexNotReady"), ("backends_metadata", "BackendSetChanged"),
]


def diff(disk: DataFrame, index: DataFrame, by_hash: bool = False) -> DataFrame:
    """(path, status): added, modified, deleted or unchanged. disk and index: (path, mtime_ms, size_bytes, content_hash), index also parse_status."""
    d, i = disk.alias("d"), index.alias("i")
    changed = ~F.col("d.content_hash").eqNullSafe(F.col("i.content_hash")) if by_hash else (F.col("d.mtime_ms") != F.col("i.mtime_ms")) | (F.col("d.size_bytes") != F.col("i.size_bytes"))
    status = F.when(F.col("i.path").isNull(), "added").when(F.col("d.path").isNull(), "deleted").when(changed | (F.col("i.parse_status") == "Failed"), "modified").otherwise("unchanged")
    return d.join(i, F.col("d.path") == F.col("i.path"), "full_outer").select(F.coalesce("d.path", "i.path").alias("path"), status.alias("status"))


def rebuild_reason(stored: DataFrame, current: dict[str, str]) -> DataFrame:
    """One row (reason): the first metadata key (key, value) that doesn't fit, null if all do. Few rows by its keys."""
    values = stored.where(F.col("key").isin([k for k, _ in COMPATIBILITY])).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    reason = F.lit(None).cast("string")
    for key, name in reversed(COMPATIBILITY):
        if key in current:
            reason = F.when(~F.element_at("m", key).eqNullSafe(F.lit(current[key])), name).otherwise(reason)
    return values.select(F.when(F.size("m") == 0, "MissingMetadata").otherwise(reason).alias("reason"))


def index_state(changes: DataFrame, reason: DataFrame) -> DataFrame:
    """One row (state, reason, added, modified, deleted)."""
    counts = changes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "deleted")])
    state = F.when(F.col("reason").isNotNull(), "NeedsFullRebuild").when(F.col("added") + F.col("modified") + F.col("deleted") > 0, "NeedsIncrementalUpdate").otherwise("Ready")
    return counts.join(F.broadcast(reason)).select(state.alias("state"), "reason", "added", "modified", "deleted")  # one row each


def affected(occurrences: DataFrame, edges: DataFrame, symbols: DataFrame, changed_files: DataFrame) -> DataFrame:
    """(occurrence_id): calls elsewhere whose target stands in a changed file (file_id), and all calls within those files."""
    moved = symbols.join(changed_files, "file_id", "left_semi").select(F.col("id").alias("to_symbol_id"))
    pointing = edges.join(moved, "to_symbol_id", "left_semi").where("occurrence_id is not null").select("occurrence_id")
    own = occurrences.join(changed_files, "file_id", "left_semi").select(F.col("id").alias("occurrence_id"))
    return pointing.unionByName(own).distinct()


def cascade(tables: dict[str, DataFrame], gone_files: DataFrame) -> dict[str, DataFrame]:
    """The tables without the files (file_id): their symbols, occurrences, chunks and outgoing edges go, edges into them lose their target."""
    keep = lambda t, key="file_id": tables[t].join(gone_files.select(F.col("file_id").alias(key)), key, "left_anti")
    out = {"files": keep("files", "id")}
    for t in ("symbols", "occurrences", "chunks"):
        if t in tables:
            out[t] = keep(t)
    dead = tables["symbols"].join(gone_files, "file_id", "left_semi").select(F.col("id").alias("dead"))
    edges = tables["edges"].join(dead, F.col("from_symbol_id") == F.col("dead"), "left_anti")
    edges = edges.join(dead.withColumnRenamed("dead", "dead_to"), F.col("to_symbol_id") == F.col("dead_to"), "left")
    lost = F.col("dead_to").isNotNull()
    out["edges"] = edges.withColumn("to_symbol_id", F.when(~lost, F.col("to_symbol_id"))).withColumn("confidence", F.when(lost, "Unresolved").otherwise(F.col("confidence"))).drop("dead_to")
    return out


def name_affected(occurrences: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Calls whose name one of the symbols before or after a change has: only their resolution can differ."""
    names = before.select("name").unionAll(after.select("name")).distinct()
    return occurrences.where("kind = 'Call'").join(names, callee_name(F.col("raw_text")) == names["name"], "left_semi")


def merge(tables: dict[str, DataFrame], parsed: dict[str, DataFrame], changed: DataFrame, failed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Replace changed files (file_id) with their new rows; failed ones (file_id) among them keep their old graph and are marked, so that the next diff tries them again.

    Resolved anew are the calls within changed files and those anywhere that call a name which
    a changed file had or has: a second symbol of a name makes old calls ambiguous, and the
    loss of one may make them clear. All other edges stay, so the result is a full build's.
    Contains edges are made for changed files only. A changed file without new rows is gone."""
    old = tables
    if failed is not None:
        changed = changed.join(failed.select("file_id"), "file_id", "left_anti")
    kept = cascade(old, changed)
    new = {t: parsed[t] if failed is None else parsed[t].join(failed.select(F.col("file_id").alias("id" if t == "files" else "file_id")), "id" if t == "files" else "file_id", "left_anti") for t in ("files", "symbols", "occurrences")}
    if failed is not None and "parse_status" in kept["files"].columns:
        marked = kept["files"].join(failed.select(F.col("file_id").alias("id"), F.lit(True).alias("_failed")), "id", "left")
        kept["files"] = marked.withColumn("parse_status", F.when(F.col("_failed"), "Failed").otherwise(F.col("parse_status"))).drop("_failed").select(old["files"].columns)
    contains = contains_edges(new["symbols"])
    if "parent_symbol_id" in old["symbols"].columns and "parent_symbol_id" not in new["symbols"].columns:
        new["symbols"] = new["symbols"].join(contains.select(F.col("child_id").alias("id"), F.col("parent_id").alias("parent_symbol_id")), "id", "left")
    out = {t: kept[t].unionByName(new[t], allowMissingColumns=True) for t in ("files", "symbols", "occurrences")}
    again = name_affected(out["occurrences"], old["symbols"].join(changed, "file_id", "left_semi"), new["symbols"])
    own = new["occurrences"].where("kind = 'Call'").join(again.select("id"), "id", "left_anti")
    calls = call_edges(again.unionByName(own, allowMissingColumns=True), out["symbols"])
    stale = again.select(F.col("id").alias("occurrence_id"))
    edges = kept["edges"].join(stale, "occurrence_id", "left_anti")
    out["edges"] = edges.unionByName(calls, allowMissingColumns=True).unionByName(nested_edges(contains), allowMissingColumns=True) if "Contains" in _kinds(old) else edges.unionByName(calls.select([c for c in calls.columns if c in edges.columns]), allowMissingColumns=True)
    return out


def _kinds(tables: dict[str, DataFrame]) -> set[str]:
    """Kinds of edges that the index keeps: one that was built without Contains edges stays so."""
    return {"Contains"} if not tables["edges"].where("kind = 'Contains'").isEmpty() or tables["edges"].isEmpty() else set()


def invariants(files: DataFrame, symbols: DataFrame, occurrences: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, violations): rows that point nowhere."""
    fid, sid, oid = files.select(F.col("id").alias("_k")), symbols.select(F.col("id").alias("_k")), occurrences.select(F.col("id").alias("_k"))
    checks = [
        ("symbols_without_file", symbols, "file_id", fid), ("occurrences_without_file", occurrences, "file_id", fid),
        ("edges_from_missing_symbol", edges, "from_symbol_id", sid), ("edges_to_missing_symbol", edges, "to_symbol_id", sid), ("edges_of_missing_occurrence", edges, "occurrence_id", oid),
    ]
    out = None
    for name, table, column, keys in checks:
        if column not in table.columns:
            continue
        one = table.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_k"), "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("name"), "violations")
        out = one if out is None else out.unionAll(one)
    return out


def clear(tables: dict[str, DataFrame], language: str, backend: str | None = None) -> dict[str, DataFrame]:
    """The tables without the files of a language, and of a backend if one is named; what points into them loses its target."""
    files = tables["files"]
    gone = F.col("language") == language
    if backend is not None:
        gone &= F.col("backend") == backend if "backend" in files.columns else F.lit(False)
    return tables | cascade(tables, files.where(gone).select(F.col("id").alias("file_id")))


#: Versions of what is stored; one that differs makes the index be built anew.
VERSIONS = {"schema_version": str(SCHEMA_VERSION), "chunk_builder_version": "1", "indexer_version": "1", "parser_config_hash": "default", "resolver_id": "names", "resolver_version": "1", "change_detection_strategy": "ContentHash", "base_index_ready": "true"}


def write_metadata(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """Keys and values beside an index; those already there stay unless named anew. Few rows."""
    known = dict(read_metadata(spark, path)) | values
    rows = spark.createDataFrame(sorted(known.items()), "key string, value string").coalesce(1)
    rows.write.mode("overwrite").parquet(f"{path}/metadata")


def read_metadata(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """[] where there are none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return []
    return [(r["key"], r["value"]) for r in spark.read.schema("key string, value string").parquet(f"{path}/metadata").collect()]  # few rows


def needs_search_build(symbols: int, chunks: int, lexical: int, embedded: int | None, fingerprint: str | None, stored: str | None) -> list[str]:
    """Which parts of the search index are to be built, by counts of rows and the models' fingerprints; embedded is None without a model."""
    parts = [] if chunks or not symbols else ["chunks"]
    if lexical != chunks or parts:
        parts.append("lexical")
    if embedded is not None and (embedded == 0 and chunks or fingerprint != stored or parts):
        parts.append("dense")
    return parts
