"""Exports and renderings, a row per entry; documents are written as partitioned text, not gathered."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.functions.text import attribute, estimate_tokens, extension, fence, file_name, human_bytes, line_window, lines_of, xml_escape
from graphloom.operators.pack import yaml_items, yaml_scalar
from graphloom.sources.schemas import SCHEMA_VERSION

__all__ = ["attribute", "coloured_source", "coloured_tree", "context_dump", "feature_export", "features", "graph_documents", "graphml", "highlight", "markdown", "plain", "symbol_list", "tree_lines", "with_prefix", "xml"]


def features(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, json): one JSON object per symbol with its file's path."""
    placed = symbols.join(files.select(F.col("id").alias("file_id"), "rel_path"), "file_id")
    return placed.select("id", F.to_json(F.struct("id", "name", "qualified_name", "kind", "rel_path")).alias("json"))


def feature_export(symbols: DataFrame, files: DataFrame, modules: DataFrame, schema_version: int = SCHEMA_VERSION) -> DataFrame:
    """(section, key, json): the export's version, every symbol by id, every module's metrics by path. Rows in this order are the document's parts."""
    spark = symbols.sparkSession
    head = spark.range(1).select(F.lit(0).alias("section"), F.lit("").alias("key"), F.to_json(F.struct(F.lit(str(schema_version)).alias("schema_version"))).alias("json"))
    own = features(symbols, files).select(F.lit(1).alias("section"), F.lpad(F.col("id").cast("string"), 20, " ").alias("key"), "json")
    metrics = modules.select(F.lit(2).alias("section"), F.col("module_path").alias("key"), F.to_json(F.struct(*modules.columns)).alias("json"))
    return head.unionAll(own).unionAll(metrics)


def graph_documents(context: dict[str, DataFrame], symbols: DataFrame, files: DataFrame, root_id: int, mode: str, depth: int, max_nodes: int, max_files: int = 50) -> DataFrame:
    """One row (markdown, json, yaml) of what graph.graph_context gives; its size is bounded by max_nodes and their edges.

    files (id, rel_path, content). Markdown shows the text of at most max_files symbols (0: all),
    by path and line, and says how many it leaves out."""
    place = files.select(F.col("id").alias("file_id"), F.col("rel_path").alias("path"), *([lines_of(F.col("content")).alias("lines")] if "content" in files.columns else [F.array().cast("array<string>").alias("lines")]))
    placed = symbols.join(place, "file_id")
    shown = F.struct("name", "qualified_name", F.lower("kind").alias("kind"), "path", "start_line", "end_line")
    text = line_window(F.col("lines"), F.col("start_line"), F.col("end_line"))
    root = placed.where(F.col("id") == root_id).select(shown.alias("root"), text.alias("root_text"))
    nodes = context["nodes"].join(placed, "id").agg(
        F.array_sort(F.collect_list(F.struct("place", shown.alias("s")))).alias("n"), F.array_sort(F.collect_set(F.struct("path", "start_line", "end_line", text.alias("text")))).alias("spans")
    )
    name = symbols.select("id", "qualified_name")
    ends = context["edges"].join(name.select(F.col("id").alias("from_id"), F.col("qualified_name").alias("a")), "from_id", "left").join(name.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("b")), "to_id", "left")
    known = lambda c, i: F.coalesce(c, F.concat(F.lit("unknown_"), F.col(i).cast("string")))
    edges = ends.agg(F.array_sort(F.collect_list(F.struct(known(F.col("a"), "from_id").alias("from"), known(F.col("b"), "to_id").alias("to")))).alias("edges"))
    said = context["diagnostics"].agg(F.array_sort(F.collect_list(F.struct("severity", "message"))).alias("diagnostics"))
    one = root.join(F.broadcast(nodes)).join(F.broadcast(edges)).join(F.broadcast(said))  # one row each
    one = one.withColumn("nodes", F.transform("n", lambda x: x["s"]))
    one = one.withColumn("spans", F.array_sort(F.array_distinct(F.array_append("spans", F.struct(F.col("root.path"), F.col("root.start_line"), F.col("root.end_line"), F.col("root_text").alias("text"))))))
    facts = [F.lit(mode).alias("mode"), F.lit(depth).alias("depth"), F.lit(max_nodes).alias("max_nodes"), F.lit(max_files).alias("max_files")]
    symbol = lambda x: F.concat(x["kind"], F.lit(" "), x["qualified_name"], F.lit(" ("), x["path"], F.lit(":"), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"), F.lit(")"))
    some = F.col("spans") if max_files == 0 else F.slice("spans", 1, max_files)
    span = lambda x: F.concat(F.lit("### "), x["path"], F.lit(":"), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"), F.lit("\n\n```"), language(x["path"]), F.lit("\n"), x["text"], F.when((x["text"] == "") | F.endswith(x["text"], F.lit("\n")), "").otherwise("\n"), F.lit("```\n\n"))
    left_out = F.size("spans") - F.size(some)
    lines = lambda rows: F.concat(F.array_join(rows, "\n"), F.when(F.size(rows) > 0, "\n").otherwise(""))
    markdown_ = F.concat(
        F.lit("# Graph Context\n\nRoot: "), F.col("root.kind"), F.lit(" "), F.col("root.name"), F.lit("\nPath: "), F.col("root.path"), F.lit(":"), F.col("root.start_line").cast("string"), F.lit("-"), F.col("root.end_line").cast("string"),
        F.lit(f"\nMode: {mode}\nDepth: {depth}\nMax nodes: {max_nodes}\nMax files: {max_files}\n\n## Graph\n\n"), lines(F.array_sort(F.transform("edges", lambda e: F.concat(e["from"], F.lit(" -> "), e["to"])))),
        F.lit("\n## Included Symbols\n\n"), lines(F.array_sort(F.array_append(F.transform("nodes", symbol), symbol(F.col("root"))))), F.lit("\n## Files\n\n"), F.array_join(F.transform(some, span), ""),
        F.when(left_out > 0, F.concat(F.lit("_("), left_out.cast("string"), F.lit(" additional files omitted due to max_files limit)_\n"))).otherwise(""),
    )
    fields = ["name", "qualified_name", "kind", "path", "start_line", "end_line"]
    yaml = F.concat(
        F.lit("root:\n"), *[F.concat(F.lit(f"  {f}: "), yaml_scalar(F.col(f"root.{f}")), F.lit("\n")) for f in fields], F.lit("nodes:\n"), yaml_items(F.col("nodes"), fields), F.lit("edges:\n"), yaml_items(F.col("edges"), ["from", "to"]),
        F.lit(f"mode: {mode}\ndepth: {depth}\nmax_nodes: {max_nodes}\nmax_files: {max_files}\ndiagnostics:\n"), yaml_items(F.col("diagnostics"), ["severity", "message"]),
    )
    return one.select(markdown_.alias("markdown"), F.to_json(F.struct("root", "nodes", "edges", *facts, "diagnostics")).alias("json"), yaml.alias("yaml"))


def graphml(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, id, line): nodes and resolved Call edges, escaped. Section 0 opens and 3 closes the document."""
    spark = symbols.sparkSession
    frame = spark.createDataFrame(
        [(0, 0, '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<graph edgedefault="directed">'), (3, 0, "</graph>\n</graphml>")], "section int, id long, line string"
    )
    node = F.concat(F.lit('<node id="n'), F.col("id").cast("string"), F.lit('"><data key="name">'), xml_escape(F.col("qualified_name")), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="n'), F.col("from_symbol_id").cast("string"), F.lit('" target="n'), F.col("to_symbol_id").cast("string"), F.lit('"/>'))
    nodes = symbols.select(F.lit(1).alias("section"), F.col("id").cast("long").alias("id"), node.alias("line"))
    calls = edges.where("kind = 'Call' and to_symbol_id is not null").select(F.lit(2).alias("section"), F.col("id").cast("long").alias("id"), edge.alias("line"))
    return frame.unionByName(nodes).unionByName(calls)


def language(path: Column) -> Column:
    #: Names of languages by extension.
    names = {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "md": "markdown", "yml": "yaml", "sh": "bash", "txt": "text"}
    ext = F.lower(extension(file_name(path)))
    out = F.coalesce(ext, F.lit(""))
    for short, name in names.items():
        out = F.when(ext == short, name).otherwise(out)
    return out


def markdown(files: DataFrame) -> DataFrame:
    """(path, text): a heading and the content in a fence that it can't close."""
    f = fence(F.col("content"))
    return files.select("path", F.concat(F.lit("## "), F.col("path"), F.lit("\n\n"), f, language(F.col("path")), F.lit("\n"), F.col("content"), F.when(F.endswith("content", F.lit("\n")), "").otherwise("\n"), f, F.lit("\n")).alias("text"))


def xml(files: DataFrame) -> DataFrame:
    return files.select("path", F.concat(F.lit('<file path="'), xml_escape(F.col("path")), F.lit('">'), xml_escape(F.col("content")), F.lit("</file>")).alias("text"))


def plain(files: DataFrame) -> DataFrame:
    size = F.octet_length("content").cast("long")
    return files.select("path", F.concat(F.lit("=== "), F.col("path"), F.lit(" ("), human_bytes(size), F.lit(", ~"), estimate_tokens(F.col("content")).cast("string"), F.lit(" tokens) ===\n"), F.col("content")).alias("text"))


def tree_lines(entries: DataFrame) -> DataFrame:
    """entries (path, name, is_dir) with sort_key and the connector of the entry: directories first, then names; the last of its siblings turns."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    last = F.lead("name").over(W.partitionBy("parent").orderBy(F.desc("is_dir"), "name")).isNull()
    own = entries.withColumn("parent", parent).withColumn("last", last)
    depth = F.size(F.split("path", "/"))
    return own.select("path", "is_dir", depth.alias("depth"), F.concat(F.when(F.col("last"), "└── ").otherwise("├── "), "name", F.when(F.col("is_dir"), "/").otherwise("")).alias("line"))


def with_prefix(entries: DataFrame) -> DataFrame:
    """tree_lines with prefix, the bars of the directories above an entry, and key, by which lines are in the tree's order.

    A path's ancestors are few; each line meets its ancestors' lines in one equi-join."""
    drawn = tree_lines(entries)
    parts = F.split("path", "/")
    above = drawn.select("path", "is_dir", "depth", "line", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("up"))
    marks = drawn.select(F.col("path").alias("up"), F.startswith("line", F.lit("└")).alias("last"), F.col("is_dir").alias("up_dir"), F.element_at(F.split("path", "/"), -1).alias("up_name"))
    met = above.join(marks, "up").groupBy("path", "is_dir", "depth", "line").agg(F.array_sort(F.collect_list(F.struct(F.char_length("up").alias("n"), "last", "up_dir", "up_name"))).alias("ups"))
    bars = F.array_join(F.transform(F.slice("ups", 1, F.size("ups") - 1), lambda x: F.when(x["last"], "    ").otherwise("│   ")), "")
    return met.select("path", "is_dir", "depth", "line", bars.alias("prefix"), F.transform("ups", lambda x: F.struct((~x["up_dir"]).alias("file"), x["up_name"].alias("name"))).alias("key"))


def context_dump(name: str, entries: DataFrame, files: DataFrame) -> DataFrame:
    """(section, key, text): the project as one document, in this order: a head with totals, the tree with tokens, and every file's content or why it is left out.

    entries (path, name, is_dir, tokens); files (path, bytes, content, problem), of which those that
    are visible are shown."""
    totals = entries.agg(F.count_if(~F.col("is_dir")).alias("n"), F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("tokens"))), F.lit(0)).cast("long").alias("t"))
    none = F.array().cast("array<struct<file:boolean,name:string>>")
    head = totals.select(F.lit(0).alias("section"), none.alias("key"), F.format_string(f"Project Context: {name.replace('%', '%%')}\nTotal files: %d | Total tokens: %d\n\n=== DIRECTORY STRUCTURE ===\n{name.replace('%', '%%')}\n", "n", "t").alias("text"))
    drawn = with_prefix(entries)
    tokens = entries.select(F.col("path").alias("_path"), F.coalesce("tokens", F.lit(0)).cast("long").alias("_tokens"))
    own = drawn.join(tokens, F.col("path") == F.col("_path"))
    shown = F.when(F.col("_tokens") > 0, F.format_string(" (%d tokens)", "_tokens")).otherwise("")
    tree = own.select(F.lit(1), "key", F.concat("prefix", F.regexp_replace("line", "/$", ""), shown, F.lit("\n")))
    middle = head.select(F.lit(2), none, F.lit("\n=== FILE CONTENTS ===\n\n"))
    body = F.when(F.col("problem") == "TooLarge", F.format_string("[File skipped: Too large (%d KB)]\n\n", F.floor(F.col("bytes") / 1024))).when(F.col("content").isNull(), "[File skipped: Binary or read error]\n\n")
    body = body.otherwise(F.concat("content", F.when(F.endswith("content", F.lit("\n")), "").otherwise("\n"), F.lit("\n")))
    texts = own.where(~F.col("is_dir")).join(files.select(F.col("path").alias("_file"), "bytes", "content", "problem"), F.col("path") == F.col("_file"))
    contents = texts.select(F.lit(3), "key", F.concat(F.format_string("--- FILE: %s (%d tokens) ---\n", "path", "_tokens"), body))
    return head.unionAll(tree).unionAll(middle).unionAll(contents)


#: Terminal colours of a tree's entries and of marked text.
COLOURS = {"dir": "\x1b[1;34m", "source": "\x1b[32m", "text": "\x1b[33m", "other": "\x1b[37m", "match": "\x1b[7m", "keyword": "\x1b[35m", "string": "\x1b[32m", "comment": "\x1b[90m"}
PLAIN = "\x1b[0m"
SOURCES, TEXTS = ["rs", "py", "js", "ts", "go", "java", "c", "cpp", "h"], ["md", "txt", "toml", "yaml", "yml", "json"]


def coloured_tree(entries: DataFrame, width: int = 60) -> DataFrame:
    """(path, is_dir, depth, key, line): the tree with its bars, with colours by kind, and the size of files (bytes) and their tokens, if known, from column `width` on."""
    drawn = with_prefix(entries)
    sizes = entries.select(F.col("path").alias("_path"), F.col("bytes").alias("_bytes"), (F.col("tokens") if "tokens" in entries.columns else F.lit(None).cast("long")).alias("_tokens"))
    own = drawn.join(sizes, F.col("path") == F.col("_path"), "left")
    ext = F.lower(extension(file_name(F.col("path"))))
    colour = F.when(F.col("is_dir"), COLOURS["dir"]).when(ext.isin(SOURCES), COLOURS["source"]).when(ext.isin(TEXTS), COLOURS["text"]).otherwise(COLOURS["other"])
    pad = F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.char_length("line") - F.char_length("prefix"), F.lit(1)))
    tokens = F.when(F.col("_tokens").isNotNull(), F.concat(F.lit(", ~"), F.col("_tokens").cast("string"), F.lit(" tokens"))).otherwise("")
    size = F.when(~F.col("is_dir") & F.col("_bytes").isNotNull(), F.concat(pad, human_bytes(F.col("_bytes").cast("long")), tokens)).otherwise("")
    return own.select("path", "is_dir", "depth", "key", F.concat("prefix", F.substring("line", 1, 4), colour, F.substring(F.col("line"), F.lit(5), F.char_length("line")), F.lit(PLAIN), size).alias("line"))


def highlight(text: Column, term: str) -> Column:
    """text with every occurrence of term, whatever the case, marked for a terminal."""
    return F.regexp_replace(text, "(?i)(" + re.escape(term) + ")", COLOURS["match"] + "$1" + PLAIN) if term else text


#: Words that a language keeps for itself, as far as a preview colours them.
KEYWORDS = "as async await break class const continue def elif else enum except fn for from if impl import in let loop match mod mut pub raise return self static struct trait try use while with yield".split()


def coloured_source(text: Column) -> Column:
    """Source text with keywords, strings and line comments coloured for a terminal: one pass, whichever starts first."""
    parts = rf'(?<comment>//[^\n]*|#[^\n\[!][^\n]*)|(?<string>"(?:[^"\\\n]|\\.)*")|(?<keyword>\b(?:{"|".join(KEYWORDS)})\b)'
    marked = F.regexp_replace(text, parts, "\x01${comment}\x02${string}\x03${keyword}\x04")
    for kind, start, end in (("comment", "\x01", "\x02"), ("string", "\x02", "\x03"), ("keyword", "\x03", "\x04")):
        marked = F.regexp_replace(marked, f"{start}([^\x01-\x04]+)(?={end})", f"{start}{COLOURS[kind]}$1{PLAIN}")
    return F.translate(marked, "\x01\x02\x03\x04", "")


def symbol_list(symbols: DataFrame, files: DataFrame) -> DataFrame:
    placed = symbols.join(files.select(F.col("id").alias("file_id"), "rel_path"), "file_id")
    return placed.select("id", F.format_string("%s %s (%s:%d)", F.lower("kind"), "qualified_name", "rel_path", "start_line").alias("line"))


def call_lines(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Callers and callees as text."""
    a, b = symbols.select(F.col("id").alias("from_symbol_id"), F.col("qualified_name").alias("a")), symbols.select(F.col("id").alias("to_symbol_id"), F.col("qualified_name").alias("b"))
    named = edges.where("kind = 'Call'").join(a, "from_symbol_id").join(b, "to_symbol_id", "left")
    return named.select("id", F.format_string("%s -> %s [%s]", "a", F.coalesce("b", F.concat(F.lit("?"), "raw_text")), "confidence").alias("line"))


def grouped_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(rel_path, names): a file's symbols in order; a source file's symbols are few."""
    placed = symbols.join(files.select(F.col("id").alias("file_id"), "rel_path"), "file_id")
    return placed.groupBy("rel_path").agg(F.count(F.lit(1)).alias("symbols"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", "name"))), lambda x: x["name"]), ",").alias("names"))
