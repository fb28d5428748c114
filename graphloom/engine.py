"""The library's front: build tables from a tree of files, keep them, and ask."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.durable import cut, publish, published
from graphloom.functions.text import count_lines, file_name, lines_of
from graphloom.operators import chunks as ch, export, filters, graph, lexical, maintain, models, stats
from graphloom.plans import retrieve
from graphloom.sources import coverage, ignore, parse
from graphloom.sources.corpus import scan_files

TABLES = ("files", "symbols", "occurrences", "edges", "chunks")


#: Hears of the steps of a long build.
Progress = Callable[[str], object]


def _parsed(scanned: DataFrame, include_tests: bool) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables files, symbols and occurrences of scanned files, each parsed once, and the ids (file_id) of those that can't be."""
    language = F.when(F.endswith("rel_path", F.lit(".rs")), "rust").otherwise("python")
    files = scanned.select(F.xxhash64("rel_path").alias("id"), "rel_path", language.alias("language"), F.lit("scanner").alias("backend"), F.col("bytes").alias("size_bytes"), "mtime_ms", "content_hash", "content", F.lit("Success").alias("parse_status"))
    rows = cut(parse.parse_files(scanned), "parsed")
    symbols, occurrences = parse.tables(rows, files)
    if not include_tests:
        tests = symbols.where("kind = 'Test'").select(F.col("id").alias("enclosing_symbol_id"))
        symbols, occurrences = symbols.where("kind <> 'Test'"), occurrences.join(tests, "enclosing_symbol_id", "left_anti")
    return {"files": files, "symbols": symbols, "occurrences": occurrences}, rows.where("row = 'failed'").select(F.xxhash64("rel_path").alias("file_id")).distinct()


def _with_parents(symbols: DataFrame, contains: DataFrame) -> DataFrame:
    return symbols.join(contains.select(F.col("child_id").alias("id"), F.col("parent_id").alias("parent_symbol_id")), "id", "left")


@dataclass
class Engine:
    spark: SparkSession
    tables: dict[str, DataFrame]
    root: str | None = None
    path: str | None = None  # the version's folder, of a saved index
    include_tests: bool = False

    # -- building

    @classmethod
    def build(cls, spark: SparkSession, root: str, include_tests: bool = False, max_bytes: int = 524_288, progress: Progress | None = None) -> Engine:
        """Scan, parse, resolve, nest, measure and chunk the source files under root. progress hears of each step."""
        say = progress or (lambda _: None)
        say("scan")
        scanned = filters.indexable(scan_files(spark, root, max_bytes))
        say("parse")
        tables, failed = _parsed(scanned, include_tests)
        bad = tables["files"].join(failed.select(F.col("file_id").alias("id"), F.lit(True).alias("bad")), "id", "left")
        files = bad.withColumn("parse_status", F.when(F.col("bad"), "Failed").otherwise(F.col("parse_status"))).drop("bad")
        say("resolve")
        contains = graph.contains_edges(tables["symbols"])
        symbols = _with_parents(tables["symbols"], contains)
        edges = graph.call_edges(tables["occurrences"], symbols).unionByName(graph.nested_edges(contains))
        say("chunk")
        made = {"files": files, "symbols": symbols, "occurrences": tables["occurrences"], "edges": edges, "chunks": ch.build(symbols, contains, tables["occurrences"], files)}
        return cls(spark, made, root, include_tests=include_tests)

    def save(self, path: str, metadata: dict[str, str] | None = None) -> Engine:
        """Write every table, and the chunks' lexical index, as a new version under path; returns an engine over what is written. Earlier versions stay until `clean`."""
        known = published(self.spark, path)
        n = known[-1][0] + 1 if known else 0
        folder = f"v{n}-{uuid.uuid4().hex[:12]}"
        for t in TABLES:
            self.tables[t].write.parquet(f"{path}/{folder}/{t}")
        lexical.build(self.spark.read.parquet(f"{path}/{folder}/chunks").select("id", "text", "qualified_name"), "id", ["text", "qualified_name"], f"{path}/{folder}/lexical")
        maintain.write_metadata(self.spark, f"{path}/{folder}", maintain.VERSIONS | {"include_tests": str(self.include_tests).lower()} | (metadata or {}))
        publish(self.spark, path, n, folder)
        return Engine.load(self.spark, path, self.root)

    @classmethod
    def load(cls, spark: SparkSession, path: str, root: str | None = None) -> Engine:
        """The latest whole version under path; what is there is asked, not built."""
        known = published(spark, path)
        if not known:
            raise FileNotFoundError(f"no index under {path}")
        at = f"{path}/{known[-1][1]}"
        stored = dict(maintain.read_metadata(spark, at))
        return cls(spark, {t: spark.read.parquet(f"{at}/{t}") for t in TABLES}, root, at, stored.get("include_tests") == "true")

    @classmethod
    def ensure_fresh(cls, spark: SparkSession, root: str, path: str, include_tests: bool = False, progress: Progress | None = None) -> Engine:
        """The index under path, up with the files under root: built where there is none or its versions differ, updated where files changed, else as it is."""
        say = progress or (lambda _: None)
        if not published(spark, path):
            return cls.build(spark, root, include_tests, progress=progress).save(path)
        own = cls.load(spark, path, root)
        state = own.state(include_tests).first()
        say(state["state"])
        if state["state"] == "NeedsFullRebuild":
            return cls.build(spark, root, include_tests, progress=progress).save(path)
        return own.update().save(path) if state["state"] == "NeedsIncrementalUpdate" else own

    @classmethod
    def load_or_build(cls, spark: SparkSession, root: str, path: str, include_tests: bool = False) -> Engine:
        """The index under path as it is; built where there is none."""
        return cls.load(spark, path, root) if published(spark, path) else cls.build(spark, root, include_tests).save(path)

    def _changes(self) -> tuple[DataFrame, DataFrame]:
        scanned = filters.indexable(scan_files(self.spark, self.root))
        disk = scanned.select(F.col("rel_path").alias("path"), "mtime_ms", F.col("bytes").alias("size_bytes"), "content_hash")
        index = self.tables["files"].select(F.col("rel_path").alias("path"), "mtime_ms", "size_bytes", "content_hash", "parse_status")
        return scanned, maintain.diff(disk, index, by_hash=True)

    def state(self, include_tests: bool | None = None) -> DataFrame:
        """Whether the files under root still are those of the index, and its versions those of this library."""
        wanted = maintain.VERSIONS
        stored = maintain.read_metadata(self.spark, self.path) if self.path else sorted(wanted.items())
        reason = maintain.rebuild_reason(self.spark.createDataFrame(stored, "key string, value string"), wanted)
        if include_tests is not None and include_tests != self.include_tests:
            reason = reason.select(F.coalesce("reason", F.lit("IndexerVersionChanged")).alias("reason"))
        return maintain.index_state(self._changes()[1], reason)

    def update(self) -> Engine:
        """The index after the changes on disk: changed files are parsed, calls that the change can touch are resolved, chunks of changed files made anew. Files that can't be parsed keep their old graph and are tried again."""
        scanned, changes = self._changes()
        changes = cut(changes.where("status <> 'unchanged'"), "changes")
        some = scanned.join(changes.where("status <> 'deleted'").select(F.col("path").alias("rel_path")), "rel_path", "left_semi")
        parsed, failed = _parsed(some, self.include_tests)
        failed = cut(failed, "failed")
        changed = changes.select(F.xxhash64("path").alias("file_id"))
        new_failed = failed.join(self.tables["files"].select(F.col("id").alias("file_id")), "file_id", "left_anti")
        parsed["files"] = parsed["files"].join(new_failed.select(F.col("file_id").alias("id"), F.lit(True).alias("bad")), "id", "left").withColumn("parse_status", F.when(F.col("bad"), "Failed").otherwise(F.col("parse_status"))).drop("bad")
        old_failed = failed.join(new_failed, "file_id", "left_anti")
        merged = {t: cut(df, t) for t, df in maintain.merge(self.tables, parsed, changed, old_failed).items() if t != "chunks"}
        fresh = changed.join(old_failed, "file_id", "left_anti")
        contains = merged["edges"].where("kind = 'Contains'").select(F.col("from_symbol_id").alias("parent_id"), F.col("to_symbol_id").alias("child_id"))
        own = merged["symbols"].join(fresh, "file_id", "left_semi")
        made = ch.build(own, contains.join(own.select(F.col("id").alias("child_id")), "child_id", "left_semi"), merged["occurrences"].join(fresh, "file_id", "left_semi"), merged["files"].join(fresh.select(F.col("file_id").alias("id")), "id", "left_semi"))
        chunks = self.tables["chunks"].join(fresh, "file_id", "left_anti").unionByName(made, allowMissingColumns=True)
        return Engine(self.spark, merged | {"chunks": chunks}, self.root, None, self.include_tests)

    def build_search(self, embedder=None, fingerprint: str = "", force: bool = False) -> tuple[list[str], list[str]]:
        """Build what the saved index lacks for searching: (parts built, warnings). A part that fails is a warning, and the index stays as it was for it.

        Vectors are made where a model is given and its fingerprint isn't the stored one, or with force, which clears both first."""
        if not self.path:
            raise ValueError("save the index first")
        stored = dict(maintain.read_metadata(self.spark, self.path))
        chunks = self.tables["chunks"]
        embedded = None if embedder is None else int(stored.get("embedded", "0"))
        parts = ["lexical"] + (["dense"] if embedder else []) if force else maintain.needs_search_build(self.tables["symbols"].count(), n := chunks.count(), lexical.count(self.spark, f"{self.path}/lexical"), embedded, fingerprint, stored.get("model"))
        done, warnings = [], []
        for part in parts:
            try:
                if part == "lexical":
                    lexical.build(chunks.select("id", "text", "qualified_name"), "id", ["text", "qualified_name"], f"{self.path}/lexical")
                elif part == "dense":
                    vectors = models.embed(ch.embeddable(chunks).withColumnRenamed("id", "chunk_id"), "chunk_id", "text", embedder)
                    folder = f"vectors-{uuid.uuid4().hex[:12]}"
                    vectors.write.parquet(f"{self.path}/{folder}")
                    maintain.write_metadata(self.spark, self.path, {"model": fingerprint, "vectors": folder, "embedded": str(self.spark.read.parquet(f"{self.path}/{folder}").count())})
                done.append(part)
            except Exception as e:  # the index serves without it
                warnings.append(f"{part}: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
        return done, warnings

    def clear(self, language: str, backend: str | None = None) -> Engine:
        """The index without a language's files."""
        return Engine(self.spark, maintain.clear(self.tables, language, backend), self.root, None, self.include_tests)

    def invariants(self) -> DataFrame:
        t = self.tables
        return maintain.invariants(t["files"], t["symbols"], t["occurrences"], t["edges"])

    # -- asking

    def symbols(self, query: str, limit: int = 50, kind: str | None = None) -> DataFrame:
        """Symbols by name, best tier first; the kind is a filter on what the limit left."""
        found = graph.find_symbols(self.tables["symbols"], self.tables["files"], query).orderBy("tier", "id").limit(limit)
        return found.where(F.col("kind") == kind) if kind else found

    def resolve(self, query: str) -> DataFrame:
        return graph.resolve_symbol(graph.find_symbols(self.tables["symbols"], self.tables["files"], query))

    def callees(self, symbol_id: int) -> DataFrame:
        t = self.tables
        return graph.outbound(t["edges"].where(F.col("from_symbol_id") == symbol_id), t["symbols"], t["files"], ["Call"])

    def callers(self, symbol_id: int) -> DataFrame:
        t = self.tables
        return graph.inbound(t["edges"].where(F.col("to_symbol_id") == symbol_id), t["symbols"], t["files"], ["Call"])

    def slice(self, symbol_id: int, reverse: bool = False, max_depth: int | None = None, include_tests: bool = False) -> DataFrame:
        root = self.spark.range(1).select(F.lit(symbol_id).cast("long").alias("id"))
        return graph.slice_from(self.tables["edges"], self.tables["symbols"], root, reverse, max_depth, include_tests)

    def context(self, symbol_id: int, mode: str = "neighborhood", max_depth: int = 1) -> DataFrame:
        root = self.spark.range(1).select(F.lit(symbol_id).cast("long").alias("id"))
        return graph.context(self.tables["edges"], self.tables["symbols"], root, mode, max_depth)

    def snippets(self) -> DataFrame:
        """Symbols with the text that a pack shows."""
        text = self.tables["files"].select(F.col("id").alias("file_id"), lines_of(F.col("content")).alias("lines"))
        s = self.tables["symbols"].join(text, "file_id")
        return s.withColumn("snippet", ch.snippet(F.col("lines"), F.col("start_line"), F.col("end_line"), F.col("body_start_line"), F.col("body_end_line"), False, 2)).drop("lines")

    def retrieve(self, query: str, strategy: str = "graph", options: retrieve.Options = retrieve.Options(), embedder=models.hash_embedder) -> DataFrame:
        t = self.tables
        vectors = vector = None
        if strategy in ("dense", "hybrid"):
            vectors = self._vectors(embedder)
            vector = [float(x) for x in embedder()([query])[0]]
        words = None
        if self.path and strategy not in ("graph", "dense") and lexical.segments(self.spark, f"{self.path}/lexical"):
            words = lexical.search(self.spark, f"{self.path}/lexical", query, 50, "doc")
        return retrieve.retrieve(strategy, query, t["edges"], self.snippets(), t["files"], t["chunks"], vectors, vector, options, words)

    def _vectors(self, embedder) -> DataFrame:
        """The chunks' stored vectors, or new ones where none are stored."""
        folder = dict(maintain.read_metadata(self.spark, self.path)).get("vectors") if self.path else None
        if folder:
            return self.spark.read.parquet(f"{self.path}/{folder}")
        return models.embed(ch.embeddable(self.tables["chunks"]).withColumnRenamed("id", "chunk_id"), "chunk_id", "text", embedder)

    def around(self, symbol_id: int, mode: str = "neighborhood", max_depth: int = 2, max_nodes: int = 200, max_files: int = 50) -> DataFrame:
        """One row (markdown, json, yaml): the graph around a symbol."""
        t = self.tables
        found = graph.graph_context(t["edges"], t["symbols"], symbol_id, mode, max_depth, max_nodes)
        return export.graph_documents(found, t["symbols"], t["files"], symbol_id, mode, max_depth, max_nodes, max_files)

    def slice_tree(self, symbol_id: int, max_depth: int = 10, max_lines: int = 100) -> DataFrame:
        return graph.slice_tree(self.tables["edges"], self.tables["symbols"], symbol_id, max_depth, max_lines)

    def read_file(self, path: str, start: int = 1, end: int | None = None, most: int = 500) -> DataFrame:
        """Lines of one indexed file; paths that leave the root give no rows."""
        own = self.tables["files"].where((F.col("rel_path") == path) & filters.safe_path(F.col("rel_path")))
        return own.select("rel_path", ch.read_lines(lines_of(F.col("content")), F.lit(start), F.lit(end), most).alias("text"), count_lines(F.col("content")).alias("lines"))

    # -- the project as a whole

    def project(self, mode: str = "smart", max_depth: int | None = None, max_bytes: int = 524_288, respect_ignore: bool = True, exclude: tuple[str, ...] = (), global_ignore: str = "") -> DataFrame:
        """Every entry under root with the reason if it is hidden, and its counts.

        Files that ignore files name aren't there, nor what `exclude` names; global_ignore is the
        text of the user's own ignore file, and .git/info/exclude is read where there is one."""
        found = scan_files(self.spark, self.root, max_bytes)
        if respect_ignore:
            excluded = [r for _, text in ignore.read_hidden(self.spark, f"{self.root.rstrip('/')}/.git/info/exclude") for r in ignore.parse(text)]
            found = ignore.without_ignored(found, "rel_path", ignore.rules_of(found, self.root), list(exclude), excluded, ignore.parse(global_ignore))
        elif exclude:
            found = ignore.without_ignored(found, "rel_path", [], list(exclude))
        scanned = found.select(F.col("rel_path").alias("path"), "bytes", "content")
        counted = stats.file_stats(scanned.select("path", "content"), max_bytes).drop("bytes")
        return filters.scan(scanned.select("path", "bytes"), mode, max_depth).join(counted, "path", "left")

    def summary(self, mode: str = "smart") -> DataFrame:
        return stats.project_summary(self.project(mode))

    def tree(self, mode: str = "smart", max_depth: int | None = None) -> DataFrame:
        return export.tree_lines(self.project(mode, max_depth).where("reason is null"))

    def render(self, how: str = "markdown", mode: str = "llm") -> DataFrame:
        """(path, text) of the visible files."""
        visible = self.project(mode).where("reason is null and not is_dir").select("path")
        content = scan_files(self.spark, self.root).where("content is not null").select(F.col("rel_path").alias("path"), "content").join(visible, "path", "left_semi")
        return {"markdown": export.markdown, "xml": export.xml, "plain": export.plain}[how](content)

    def dump(self, mode: str = "llm", max_bytes: int = 524_288) -> DataFrame:
        """(section, key, text): the visible project as one document, ordered by section and key."""
        visible = self.project(mode, max_bytes=max_bytes).where("reason is null")
        files = scan_files(self.spark, self.root, max_bytes).select(F.col("rel_path").alias("path"), "bytes", "content", "problem")
        return export.context_dump(self.root.rstrip("/").rsplit("/", 1)[-1], visible.select("path", "name", "is_dir", "tokens"), files)

    def coverage(self) -> DataFrame:
        """(path, covered, coverable) from the reports under root."""
        reports = coverage.discover(scan_files(self.spark, self.root, 1 << 30)).where("content is not null")
        return coverage.of_reports(reports)

    def metrics(self) -> DataFrame:
        """Fan-in, fan-out, coupling and cohesion by symbol."""
        t = self.tables
        return graph.fan(t["symbols"], t["edges"]).join(graph.coupling(t["symbols"], t["edges"]), "id").join(graph.lcom(t["symbols"], t["occurrences"]), "id", "left").fillna(0.0, ["cohesion"])

    def modules(self) -> DataFrame:
        t = self.tables
        calls = t["occurrences"].where("kind = 'Call'").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
        return stats.module_metrics(t["symbols"], t["files"], calls)

    def info(self) -> DataFrame:
        """Counts of tables, languages and confidences in one list."""
        t = self.tables
        out = stats.table_counts({name: t[name] for name in TABLES}).select(F.lit("table").alias("what"), "name", "n")
        of = lambda df, what: stats.counts_by(df, what).select(F.lit(what).alias("what"), F.col(what).alias("name"), "n")
        return out.unionAll(of(t["files"], "language")).unionAll(of(t["edges"], "confidence"))

    def file_names(self) -> DataFrame:
        return self.tables["files"].select(file_name(F.col("rel_path")).alias("name"), "rel_path")
