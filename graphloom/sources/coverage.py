"""Coverage reports as line tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.functions.text import attribute


def lcov(lines: DataFrame) -> DataFrame:
    """lines (report, line_no, line) to (path, line, hits): the last count of a line holds.

    A report is read in its own order: the window carries the current file within one report."""
    order = W.partitionBy("report").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    source = F.when(F.startswith("line", F.lit("SF:")), F.substring("line", 4, 1_000_000)).when(F.trim("line") == "end_of_record", F.lit(""))
    current = lines.withColumn("path", F.last(source, ignorenulls=True).over(order))
    data = current.where(F.startswith("line", F.lit("DA:")) & (F.col("path") != ""))
    parts = F.split(F.substring("line", 4, 1_000_000), ",")
    n, hits = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("long")
    found = data.select("path", n.alias("line"), hits.alias("hits"), "report", "line_no").where("line is not null and hits is not null")
    return found.groupBy("path", "line").agg(F.max(F.struct("report", "line_no", "hits"))["hits"].alias("hits"))


def cobertura(lines: DataFrame) -> DataFrame:
    """The same from Cobertura XML read line by line: filename of the class, then number and hits of its lines."""
    order = W.partitionBy("report").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    source = F.when(F.contains("line", F.lit("<class ")), attribute(F.col("line"), "filename")).when(F.contains("line", F.lit("</class>")), F.lit(""))
    current = lines.withColumn("path", F.last(source, ignorenulls=True).over(order)).where(F.contains("line", F.lit("<line ")) & (F.col("path") != ""))
    found = current.select("path", attribute(F.col("line"), "number").try_cast("int").alias("line"), attribute(F.col("line"), "hits").try_cast("long").alias("hits"), "report", "line_no").where("line is not null and hits is not null")
    return found.groupBy("path", "line").agg(F.max(F.struct("report", "line_no", "hits"))["hits"].alias("hits"))


def per_file(line_hits: DataFrame) -> DataFrame:
    """(path, covered, coverable)."""
    return line_hits.groupBy("path").agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count(F.lit(1)).alias("coverable"))


def report_kind(path: str) -> str | None:
    """Which reader a file needs, by its name."""
    name = path.rsplit("/", 1)[-1]
    if name == "lcov.info" or name.endswith(".lcov"):
        return "lcov"
    return "cobertura" if name in ("coverage.xml", "cobertura.xml") else None


#: Directories that discovery doesn't enter.
UNSEARCHED = [".git", "node_modules", ".venv", "venv", "__pycache__", ".pytest_cache"]


def discover(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """files that are coverage reports by name; below a directory `target` only its own lcov.info and what its `cov` holds count."""
    parts = F.split(path, "/")
    name, dirs = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    inside = F.array_position(dirs, "target")
    after = F.slice(parts, (inside + 1).cast("int"), F.size(parts))
    of_target = (inside == 0) | (F.element_at(after, 1) == "cov") | ((F.size(after) == 1) & (name == "lcov.info"))
    again = F.array_contains(F.slice(dirs, (inside + 2).cast("int"), F.size(parts)), "target") & (inside > 0)
    return files.where(name.isin("lcov.info", "coverage.xml", "cobertura.xml") & ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in UNSEARCHED])) & of_target & ~again)


def of_reports(reports: DataFrame) -> DataFrame:
    """(path, covered, coverable) of report files (rel_path, content): each by the reader that its name asks for."""
    lines = reports.select("rel_path", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).select(F.col("rel_path").alias("report"), "line_no", "line")
    xml = F.endswith("report", F.lit(".xml"))
    return per_file(lcov(lines.where(~xml)).unionByName(cobertura(lines.where(xml))))
