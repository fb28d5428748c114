"""Statistics of a file corpus: summary, tree rollup, coverage, usage, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.functions.text import ancestors, count_lines, estimate_tokens, python_tests, rust_tests

COUNTERS = ["bytes", "lines", "tokens", "tests", "covered", "coverable"]


def file_stats(files: DataFrame, max_bytes: int = 524_288) -> DataFrame:
    """files (path, content) with bytes, lines, tokens and tests; text that is too large counts bytes only."""
    size = F.octet_length("content").cast("long")
    small = size <= max_bytes
    count = lambda c: F.when(small & F.col("content").isNotNull(), c).otherwise(0).cast("long")
    tests = F.when(F.endswith("path", F.lit(".rs")), rust_tests(F.col("content"))).when(F.col("path").rlike(r"(^|/)(test_[^/]*|[^/]*_test)\.py$"), python_tests(F.col("content"))).otherwise(0)
    return files.select(
        *[c for c in files.columns if c != "content"], F.coalesce(size, F.lit(0).cast("long")).alias("bytes"), count(count_lines(F.col("content"))).alias("lines"), count(estimate_tokens(F.col("content"))).alias("tokens"), count(tests).alias("tests")
    )


def with_coverage(stats: DataFrame, coverage: DataFrame) -> DataFrame:
    """Left join on the path; files without coverage have zeros."""
    known = coverage.select(F.col("path"), "covered", "coverable")
    return stats.join(known, "path", "left").fillna(0, ["covered", "coverable"])


def project_summary(scanned: DataFrame) -> DataFrame:
    """One row of counters over a scan with stats: hidden entries are counted, visible ones summed."""
    seen, hid, is_dir = F.col("reason").isNull(), F.col("reason").isNotNull(), F.col("is_dir")
    return scanned.agg(
        F.count_if(seen & ~is_dir).alias("files"), F.count_if(seen & is_dir).alias("dirs"), F.count_if(hid & ~is_dir).alias("hidden_files"), F.count_if(hid & is_dir).alias("hidden_dirs"),
        *[F.coalesce(F.sum(F.when(seen & ~is_dir, F.col(c))), F.lit(0)).cast("long").alias(c) for c in COUNTERS if c in scanned.columns],
    )


def tree_rollup(stats: DataFrame, counters: list[str]) -> DataFrame:
    """Per directory, the sums over everything below it; dirs counts the directory itself.

    Each file goes to its ancestors and is summed map-side first: a shuffle of one row per
    directory and map task, however many files a directory holds."""
    below = stats.select(F.explode(ancestors(F.col("path"))).alias("dir"), *counters)
    sums = below.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).cast("long").alias(c) for c in counters])
    dirs = sums.select("dir").select(F.explode(F.concat(ancestors(F.col("dir")), F.array("dir"))).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("dirs"))
    return sums.join(dirs, "dir").select("dir", "files", "dirs", *counters)


def module_metrics(symbols: DataFrame, files: DataFrame, calls: DataFrame) -> DataFrame:
    """Per directory with symbols: size, averages and calls per line. calls: (file_id, n) of call occurrences."""
    placed = symbols.join(files.select(F.col("id").alias("file_id"), "rel_path"), "file_id")
    by_file = placed.groupBy("file_id", "rel_path").agg(
        F.sum("lines_of_code").alias("loc"), F.count(F.lit(1)).alias("n"), F.sum("complexity_proxy").alias("complexity"), F.sum("nesting_depth").alias("nesting")
    )
    spread = by_file.select(F.explode(ancestors(F.col("rel_path"))).alias("module_path"), "loc", "n", "complexity", "nesting")
    modules = spread.groupBy("module_path").agg(F.sum("loc").alias("total_loc"), F.sum("n").alias("symbol_count"), F.sum("complexity").alias("c"), F.sum("nesting").alias("d"))
    called = calls.join(files.select(F.col("id").alias("file_id"), "rel_path"), "file_id").select(F.explode(ancestors(F.col("rel_path"))).alias("module_path"), "n").groupBy("module_path").agg(F.sum("n").alias("calls"))
    calls_in = F.coalesce("calls", F.lit(0))
    return modules.join(called, "module_path", "left").select(
        "module_path",
        F.col("total_loc").cast("long").alias("total_loc"),
        F.col("symbol_count").cast("long").alias("symbol_count"),
        F.round(F.col("c") / F.col("symbol_count"), 6).alias("avg_complexity"),
        F.round(F.col("d") / F.col("symbol_count"), 6).alias("avg_nesting_depth"),
        F.round(F.when(F.col("total_loc") > 0, calls_in / F.col("total_loc")).otherwise(0.0), 6).alias("call_density"),
    )


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    """(column, n): a histogram, the largest first where it is shown."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def confidence_histogram(edges: DataFrame) -> DataFrame:
    """(confidence, n, unresolved): edges by confidence, and those without a target."""
    return edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("to_symbol_id").isNull()).alias("unresolved"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def selection_totals(entries: DataFrame, columns: tuple[str, ...] = ("bytes", "lines", "tokens")) -> DataFrame:
    """One row: how many of the entries are selected (selected), and the sums over them."""
    own = F.col("selected")
    return entries.agg(F.count_if(own).alias("selected"), *[F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).cast("long").alias(c) for c in columns])


def usage_stats(events: DataFrame) -> DataFrame:
    """Per tool (tool, duration_ms, failed): calls, sums, whole mean and error rate in percent."""
    return events.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.col("failed").cast("long")).alias("errors"), F.sum("duration_ms").cast("long").alias("total_ms"),
        F.floor(F.sum("duration_ms") / F.count(F.lit(1))).cast("long").alias("mean_ms"), F.round(F.sum(F.col("failed").cast("long")) * 100.0 / F.count(F.lit(1)), 6).alias("error_rate"),
    )


#: Health states by how bad they are.
SEVERITY = ["ok", "warn", "fail"]


def health(checks: DataFrame) -> DataFrame:
    """Counts of check results (status) and the worst of them."""
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    worst = F.element_at(F.array(*[F.lit(x) for x in SEVERITY]), (F.coalesce(F.max(rank), F.lit(0)) + 1).cast("int"))
    return checks.agg(*[F.count_if(F.col("status") == x).alias(x) for x in SEVERITY], worst.alias("overall"))
