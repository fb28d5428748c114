"""Reading a tree of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_BYTES = 524_288
#: What marks the root of a workspace.
ROOT_MARKS = (".git", "Cargo.toml", "pyproject.toml", "requirements.txt", "setup.py")


def workspace_root(path: str) -> str | None:
    """The nearest folder at or above a local path that has a mark of a root."""
    from pathlib import Path

    here = Path(path).resolve()
    return next((str(p) for p in (here, *here.parents) if any((p / m).exists() for m in ROOT_MARKS)), None)


def scan_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, glob: str | None = None) -> DataFrame:
    """(rel_path, bytes, mtime_ms, content, content_hash, problem): content is null and problem says why if a file is too large or not UTF-8.

    The size is the source's own column, so files that are too large are never read as text."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(root)
    return _decoded(raw, root, max_bytes)


def stream_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The same columns as a stream of new files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _decoded(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root), root, max_bytes)


def relative(path: Column, root: str) -> Column:
    """A file's path below root, without its scheme."""
    plain = F.regexp_replace(path, r"^[a-z]+:/{1,3}", "/")
    base = root.split(":", 1)[-1].rstrip("/") if "://" in root or root.startswith("file:") else root.rstrip("/")
    base = "/" + base.lstrip("/")
    return F.substring(plain, F.lit(len(base) + 2), F.char_length(plain))


def _decoded(raw: DataFrame, root: str, max_bytes: int) -> DataFrame:
    small = F.col("length") <= max_bytes
    valid = F.expr("is_valid_utf8(content)")
    text = F.when(small & valid, F.decode("content", "UTF-8"))
    problem = F.when(~small, "TooLarge").when(~valid, "NonUtf8")
    return raw.select(relative(F.col("path"), root).alias("rel_path"), F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("mtime_ms"), text.alias("content"), F.sha2("content", 256).alias("content_hash"), problem.alias("problem"))
