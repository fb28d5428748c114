"""Registered queries: each name with its Spark plan and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from graphloom.durable import shared_dir
from graphloom.functions import text as tx
from graphloom.operators import chunks, export, filters, graph, lexical, maintain, pack, rank, search, stats
from graphloom.sources import carriers as ca, coverage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEARCH = "the thing that is not idiot"
SYMBOL = "Supplier#00000000"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _with(body: str) -> str:
    return f"WITH {ca.SQL}{body}"


# ---- scalars

LINES_SQL = "CASE WHEN text = '' THEN 0 WHEN ends_with(text, chr(10)) THEN len(string_split(text, chr(10))) - 1 ELSE len(string_split(text, chr(10))) END"


@register("text_token_estimates", f"SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, floor(length(text) / 4.0)::BIGINT AS chunk_tokens, ({LINES_SQL})::BIGINT AS lines FROM documents")
def text_token_estimates(spark, sf):
    t = F.col("text")
    return ca.table(spark, sf, "documents").select("doc_id", tx.estimate_tokens(t).alias("tokens"), tx.chunk_tokens(t).alias("chunk_tokens"), tx.count_lines(t).alias("lines"))


TOKENIZE_SQL = (
    "list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(x, '([^:._/\\\\\\s-])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[:._/\\\\\\s-]+'), lambda v: v <> ''), lambda v: lower(v))"
)


@register(
    "tokenize_identifiers",
    f"WITH s AS (SELECT p_partkey AS id, p_brand || '::get' || replace(p_name, ' ', '_') || 'FromHTTPServer.' || p_type AS x FROM part), t AS (SELECT id, x, {TOKENIZE_SQL} AS t FROM s) SELECT id, array_to_string(CASE WHEN list_contains(t, lower(x)) THEN t ELSE list_append(t, lower(x)) END, '|') AS tokens FROM t",
)
def tokenize_identifiers(spark, sf):
    x = F.concat("p_brand", F.lit("::get"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("FromHTTPServer."), "p_type")
    return ca.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(tx.tokenize(x), "|").alias("tokens"))


@register("path_parts", _with(""" SELECT page_id, split_part(path, '/', -1) AS name, CASE WHEN regexp_matches(split_part(path, '/', -1), '^.+\\.[^.]*$') THEN regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1) END AS ext,
  regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, len(string_split(path, '/'))::INTEGER AS depth FROM c_pages"""))
def path_parts(spark, sf):
    p = F.col("path")
    name = tx.file_name(p)
    return ca.pages(spark, sf).select("page_id", name.alias("name"), tx.extension(name).alias("ext"), tx.parent_dir(p).alias("parent"), F.size(F.split(p, "/")).alias("depth"))


@register("callee_names", _with(""" SELECT raw_text, CASE WHEN contains(raw_text, '::') THEN split_part(raw_text, '::', -1) WHEN contains(raw_text, '.') THEN split_part(raw_text, '.', -1) ELSE raw_text END AS callee,
  contains(raw_text, '.') AND NOT contains(raw_text, '::') AS as_method, sum(times)::BIGINT AS times FROM c_occurrences GROUP BY raw_text"""))
def callee_names(spark, sf):
    r = F.col("raw_text")
    o = ca.occurrences(spark, sf).groupBy("raw_text").agg(F.sum("times").alias("times"))
    return o.select("raw_text", tx.callee_name(r).alias("callee"), tx.is_method_call(r).alias("as_method"), "times")


@register("xml_and_fences", """SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped,
  repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(html, '`+'), lambda x: length(x))), 0) + 1)) AS fence FROM pages""")
def xml_and_fences(spark, sf):
    return ca.table(spark, sf, "pages").select("page_id", tx.xml_escape(F.col("url")).alias("escaped"), tx.fence(F.col("html")).alias("fence"))


@register("human_sizes", """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f MB', n / 1048576.0) END AS size FROM (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents)""")
def human_sizes(spark, sf):
    return ca.table(spark, sf, "documents").select("doc_id", tx.human_bytes(F.octet_length("text").cast("long")).alias("size"))


# ---- scan and filters

_EXT = "CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^.+\\.([^.]*)$', 1) END"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _reason_sql(mode: str) -> str:
    own = {
        "smart": "NULL",
        "code": f"CASE WHEN NOT is_dir AND NOT (lower(name) IN {_in(filters.CODE_NAMES)} OR coalesce(lower(ext), '') IN {_in(filters.CODE_EXTENSIONS)}) THEN 'non-code file' END",
        "docs": f"CASE WHEN NOT is_dir AND NOT (lower(name) IN {_in(filters.DOCS_NAMES)} OR coalesce(lower(ext), '') IN {_in(filters.DOCS_EXTENSIONS)}) THEN 'non-document file' END",
        "llm": f"CASE WHEN NOT is_dir AND coalesce(lower(ext), '') IN {_in(filters.BINARY_EXTENSIONS)} THEN 'binary file' END",
    }[mode]
    return f"""coalesce(CASE WHEN is_dir AND name IN {_in(filters.VCS_DIRS)} THEN 'VCS internals' WHEN is_dir AND name IN {_in(filters.DEPENDENCY_DIRS)} THEN 'dependencies' WHEN is_dir AND name IN {_in(filters.BUILD_DIRS)} THEN 'build artifacts'
    WHEN is_dir AND name IN {_in(filters.CACHE_DIRS)} THEN 'cache' WHEN NOT is_dir AND name IN {_in(filters.LOCKFILES)} THEN 'lockfile' WHEN NOT is_dir AND name IN {_in(filters.TEMPORARY_FILES)} THEN 'temporary file'
    WHEN NOT is_dir AND ext IN {_in(filters.TEMPORARY_EXTENSIONS)} THEN 'temporary file' END, {own})"""


def _scan_sql(mode: str) -> str:
    return f""", e0 AS (SELECT path, false AS is_dir, bytes FROM c_documents UNION ALL SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/'), true, 0 FROM c_documents, range(1, 5) t(i)
    ), e1 AS (SELECT *, split_part(path, '/', -1) AS name FROM e0), e2 AS (SELECT *, {_EXT} AS ext FROM e1), e3 AS (SELECT path, is_dir, bytes, {_reason_sql(mode)} AS reason FROM e2
    ), hid AS (SELECT path FROM e3 WHERE is_dir AND reason IS NOT NULL
    ), scanned AS (SELECT * FROM e3 WHERE NOT EXISTS (SELECT 1 FROM range(1, len(string_split(e3.path, '/'))) t(i) JOIN hid ON hid.path = array_to_string(string_split(e3.path, '/')[1:i], '/')))"""


def _scan_query(mode: str) -> Query:
    return lambda spark, sf: filters.scan(ca.documents(spark, sf), mode).select("path", "is_dir", "bytes", "reason")


for _mode in ("smart", "code", "docs", "llm"):
    register(f"filter_{_mode}", _with(_scan_sql(_mode) + " SELECT path, is_dir, bytes, reason FROM scanned"))(_scan_query(_mode))


@register("hidden_reason_counts", _with(_scan_sql("code") + " SELECT reason, is_dir, count(*) AS n FROM scanned WHERE reason IS NOT NULL GROUP BY ALL"))
def hidden_reason_counts(spark, sf):
    return filters.scan(ca.documents(spark, sf), "code").where("reason is not null").groupBy("reason", "is_dir").agg(F.count(F.lit(1)).alias("n"))


@register("depth_cut", _with(" SELECT path, len(string_split(path, '/'))::INTEGER AS depth FROM c_pages WHERE len(string_split(path, '/')) - 1 <= 2"))
def depth_cut(spark, sf):
    return ca.pages(spark, sf).select("path", F.size(F.split("path", "/")).alias("depth")).where("depth - 1 <= 2")


@register("source_discovery", _with(f""" SELECT path FROM c_documents WHERE NOT list_has_any(string_split(path, '/'), {filters.SKIPPED_DIRS!r}) AND regexp_extract(path, '\\.([^.]*)$', 1) IN ('rs', 'py')"""))
def source_discovery(spark, sf):
    return filters.indexable(ca.documents(spark, sf), "path").select("path")


_STATS_SQL = f""", fs AS (SELECT doc_id, path, CASE WHEN content IS NULL THEN 0 ELSE bytes END AS bytes, (CASE WHEN bytes <= 524288 THEN {LINES_SQL.replace('text', 'content')} ELSE 0 END)::BIGINT AS lines,
  (CASE WHEN bytes <= 524288 THEN ceil(length(content) / 4.0) ELSE 0 END)::BIGINT AS tokens FROM c_documents)"""


def _file_stats(spark, sf):
    return stats.file_stats(ca.documents(spark, sf).select("doc_id", "path", "content"))


@register("file_stats", _with(_STATS_SQL + " SELECT path, bytes, lines, tokens FROM fs"))
def file_stats(spark, sf):
    return _file_stats(spark, sf).select("path", "bytes", "lines", "tokens")


@register("project_summary", _with(_scan_sql("smart") + _STATS_SQL + """ SELECT count(*) FILTER (reason IS NULL AND NOT is_dir) AS files, count(*) FILTER (reason IS NULL AND is_dir) AS dirs, count(*) FILTER (reason IS NOT NULL AND NOT is_dir) AS hidden_files,
  count(*) FILTER (reason IS NOT NULL AND is_dir) AS hidden_dirs, sum(fs.bytes) FILTER (reason IS NULL)::BIGINT AS bytes, sum(lines) FILTER (reason IS NULL)::BIGINT AS lines, sum(tokens) FILTER (reason IS NULL)::BIGINT AS tokens,
  coalesce(sum(quality) FILTER (reason IS NULL), 0)::BIGINT AS covered, count(l.doc_id) FILTER (reason IS NULL)::BIGINT AS coverable FROM scanned LEFT JOIN fs ON scanned.path = fs.path LEFT JOIN labels l ON fs.doc_id = l.doc_id"""))
def project_summary(spark, sf):
    known = ca.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("covered"), F.lit(1).alias("coverable"))
    own = _file_stats(spark, sf).drop("tests").join(known, "doc_id", "left").fillna(0, ["covered", "coverable"])
    scanned = filters.scan(ca.documents(spark, sf), "smart").drop("bytes", "name", "depth").join(own, "path", "left")
    return stats.project_summary(scanned)


@register("tree_rollup", _with(_STATS_SQL + """, u AS (SELECT array_to_string(string_split(path, '/')[1:i], '/') AS dir, bytes, lines, tokens FROM fs, range(1, 5) t(i)), s AS (SELECT dir, count(*) AS files, sum(bytes)::BIGINT AS bytes, sum(lines)::BIGINT AS lines, sum(tokens)::BIGINT AS tokens FROM u GROUP BY dir)
  SELECT dir, files, (SELECT count(*) FROM s b WHERE b.dir = s.dir OR starts_with(b.dir, s.dir || '/')) AS dirs, bytes, lines, tokens FROM s"""))
def tree_rollup(spark, sf):
    return stats.tree_rollup(_file_stats(spark, sf), ["bytes", "lines", "tokens"])


@register("tree_lines", _with(_scan_sql("smart") + """ SELECT path, is_dir, len(string_split(path, '/'))::INTEGER AS depth, CASE WHEN lead(split_part(path, '/', -1)) OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY is_dir DESC, split_part(path, '/', -1)) IS NULL THEN '└── ' ELSE '├── ' END
  || split_part(path, '/', -1) || CASE WHEN is_dir THEN '/' ELSE '' END AS line FROM scanned WHERE reason IS NULL"""))
def tree_lines(spark, sf):
    return export.tree_lines(filters.scan(ca.documents(spark, sf), "smart").where("reason is null"))


@register("file_search", "SELECT page_id FROM pages WHERE contains(lower(url), 'blog') OR (octet_length(encode(html)) <= 524288 AND contains(lower(html), 'thing'))")
def file_search(spark, sf):
    return filters.matching_files(ca.table(spark, sf, "pages"), F.col("url"), F.col("html"), "Blog", "thing").select("page_id")


# ---- metrics


@register("fan_in_out", _with(""" SELECT s.id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM c_symbols s LEFT JOIN (SELECT to_symbol_id AS id, count(*) AS n FROM c_edges WHERE kind = 'Call' GROUP BY 1) i ON s.id = i.id
  LEFT JOIN (SELECT from_symbol_id AS id, count(*) AS n FROM c_edges WHERE kind = 'Call' GROUP BY 1) o ON s.id = o.id"""))
def fan_in_out(spark, sf):
    return graph.fan(ca.symbols(spark, sf), ca.edges(spark, sf))


@register("coupling", _with(""" SELECT s.id, coalesce(n, 0) AS coupling FROM c_symbols s LEFT JOIN (SELECT e.from_symbol_id AS id, count(DISTINCT t.qualified_name) AS n FROM c_edges e JOIN c_symbols t ON e.to_symbol_id = t.id
  WHERE t.kind IN ('Class', 'Struct', 'Module', 'Trait', 'Impl') AND e.from_symbol_id <> e.to_symbol_id GROUP BY 1) c ON s.id = c.id"""))
def coupling(spark, sf):
    return graph.coupling(ca.symbols(spark, sf), ca.edges(spark, sf))


@register("lcom", _with(""", m AS (SELECT child_id AS method_id, parent_id AS class_id FROM c_contains JOIN c_symbols s ON s.id = child_id AND s.kind = 'Method' JOIN c_symbols p ON p.id = parent_id AND p.kind IN ('Class', 'Struct')
  ), r AS (SELECT method_id, class_id, (SELECT list(DISTINCT raw_text) FROM c_occurrences o WHERE o.enclosing_symbol_id = method_id) AS refs FROM m
  ), p AS (SELECT a.class_id, count(*) FILTER (NOT coalesce(list_has_any(a.refs, b.refs), false)) - count(*) FILTER (coalesce(list_has_any(a.refs, b.refs), false)) AS v FROM r a JOIN r b ON a.class_id = b.class_id AND a.method_id < b.method_id GROUP BY 1)
  SELECT s.id, greatest(coalesce(v, 0), 0)::DOUBLE AS cohesion FROM c_symbols s LEFT JOIN p ON s.id = p.class_id WHERE s.kind IN ('Class', 'Struct')"""))
def lcom(spark, sf):
    s = ca.symbols(spark, sf)
    return graph.lcom(ca.parents(s, graph.contains_edges(s)), ca.occurrences(spark, sf))


@register("module_metrics", _with(""", x AS (SELECT s.*, rel_path FROM c_symbols s JOIN c_files f ON s.file_id = f.id), a AS (SELECT array_to_string(string_split(rel_path, '/')[1:i], '/') AS module_path, * FROM x, range(1, 3) t(i)
  ), c AS (SELECT array_to_string(string_split(rel_path, '/')[1:i], '/') AS module_path, sum(times) AS calls FROM c_occurrences o JOIN c_files f ON o.file_id = f.id, range(1, 3) t(i) GROUP BY 1)
  SELECT a.module_path, sum(lines_of_code)::BIGINT AS total_loc, count(*) AS symbol_count, round(sum(complexity_proxy) / count(*), 6) AS avg_complexity, round(sum(nesting_depth) / count(*), 6) AS avg_nesting_depth,
  round(coalesce(any_value(calls), 0) / sum(lines_of_code), 6) AS call_density FROM a LEFT JOIN c ON a.module_path = c.module_path GROUP BY a.module_path"""))
def module_metrics(spark, sf):
    calls = ca.occurrences(spark, sf).groupBy("file_id").agg(F.sum("times").alias("n"))
    return stats.module_metrics(ca.symbols(spark, sf), ca.files(spark, sf), calls)


@register("confidence_histogram", _with(" SELECT confidence, count(*) AS n, count(*) FILTER (to_symbol_id IS NULL) AS unresolved FROM c_edges GROUP BY confidence"))
def confidence_histogram(spark, sf):
    return stats.confidence_histogram(ca.edges(spark, sf))


@register("language_counts", _with(" SELECT language, count(*) AS files FROM c_files GROUP BY language"))
def language_counts(spark, sf):
    return stats.counts_by(ca.files(spark, sf), "language").withColumnRenamed("n", "files")


@register("table_counts", _with(" SELECT 'files' AS name, count(*) AS n FROM c_files UNION ALL SELECT 'symbols', count(*) FROM c_symbols UNION ALL SELECT 'edges', count(*) FROM c_edges"))
def table_counts(spark, sf):
    return stats.table_counts({"files": ca.files(spark, sf), "symbols": ca.symbols(spark, sf), "edges": ca.edges(spark, sf)})


@register("usage_stats", "SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (value > 50) AS errors, sum(round(value)::BIGINT)::BIGINT AS total_ms, (sum(round(value)::BIGINT) // count(*))::BIGINT AS mean_ms, round(count(*) FILTER (value > 50) * 100.0 / count(*), 6)::DOUBLE AS error_rate FROM events GROUP BY 1")
def usage_stats(spark, sf):
    e = ca.table(spark, sf, "events")
    return stats.usage_stats(e.select(F.col("event_type").alias("tool"), F.round("value").cast("long").alias("duration_ms"), (F.col("value") > 50).alias("failed")))


@register("health_summary", "SELECT count(*) FILTER (q = 'ok') AS ok, count(*) FILTER (q = 'warn') AS warn, count(*) FILTER (q = 'fail') AS fail, CASE WHEN bool_or(q = 'fail') THEN 'fail' WHEN bool_or(q = 'warn') THEN 'warn' ELSE 'ok' END AS overall FROM (SELECT CASE WHEN toxic = 1 THEN 'fail' WHEN quality = 0 THEN 'warn' ELSE 'ok' END AS q FROM labels)")
def health_summary(spark, sf):
    return stats.health(ca.table(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "warn").otherwise("ok").alias("status")))


# ---- joins and traversal

_OUT = """ SELECT e.id, e.kind, e.from_symbol_id, e.to_symbol_id, t.qualified_name AS target_name, f.rel_path AS target_path, e.confidence FROM c_edges e LEFT JOIN c_symbols t ON e.to_symbol_id = t.id LEFT JOIN c_files f ON t.file_id = f.id WHERE e.kind IN """
_IN = """ SELECT e.id, e.kind, e.from_symbol_id, e.to_symbol_id, s.qualified_name AS source_name, f.rel_path AS source_path, e.confidence FROM c_edges e JOIN c_symbols s ON e.from_symbol_id = s.id JOIN c_files f ON s.file_id = f.id WHERE e.to_symbol_id IS NOT NULL AND e.kind IN """


def _edges_query(way: Callable, kinds: list[str]) -> Query:
    return lambda spark, sf: way(ca.edges(spark, sf), ca.symbols(spark, sf), ca.files(spark, sf), kinds)


register("edges_outbound", _with(_OUT + "('Call', 'Reference')"))(_edges_query(graph.outbound, ["Call", "Reference"]))
register("edges_inbound", _with(_IN + "('Call', 'Reference')"))(_edges_query(graph.inbound, ["Call", "Reference"]))
register("callees", _with(_OUT + "('Call')"))(_edges_query(graph.outbound, ["Call"]))
register("callers", _with(_IN + "('Call')"))(_edges_query(graph.inbound, ["Call"]))


@register("name_resolution", _with(""", k AS (SELECT *, CASE WHEN contains(raw_text, '::') THEN split_part(raw_text, '::', -1) WHEN contains(raw_text, '.') THEN split_part(raw_text, '.', -1) ELSE raw_text END AS callee, contains(raw_text, '.') AND NOT contains(raw_text, '::') AS m FROM c_occurrences
  ), n AS (SELECT name, true AS m, id, file_id FROM c_symbols WHERE kind = 'Method' UNION ALL SELECT name, false, id, file_id FROM c_symbols WHERE kind IN ('Function', 'Method', 'Test')
  ), u AS (SELECT name, m, min(id) AS target, min(file_id) AS target_file FROM n GROUP BY name, m HAVING count(*) = 1)
  SELECT 'Call' AS kind, enclosing_symbol_id AS from_symbol_id, target AS to_symbol_id, raw_text, CASE WHEN target IS NULL THEN 'Unresolved' WHEN target_file = file_id THEN 'Syntax' ELSE 'Heuristic' END AS confidence FROM k LEFT JOIN u ON k.callee = u.name AND k.m = u.m"""))
def name_resolution(spark, sf):
    return graph.resolve_names(ca.occurrences(spark, sf), ca.symbols(spark, sf)).drop("occurrence_id")


@register("contains_edges", _with(" SELECT parent_id, child_id FROM c_contains"))
def contains_edges(spark, sf):
    return graph.contains_edges(ca.symbols(spark, sf))


_DEFINITIONS = ", loc AS (SELECT o_orderkey AS occurrence_id, (o_custkey % 25)::BIGINT AS file_id, (o_custkey * 7 + o_orderkey % 5)::BIGINT AS line FROM orders)"


def _locations(spark, sf):
    o = ca.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("occurrence_id"), (F.col("o_custkey") % 25).alias("file_id"), (F.col("o_custkey") * 7 + F.col("o_orderkey") % 5).alias("line"))


@register("lsp_definition_match", _with(_DEFINITIONS + """ SELECT occurrence_id, arg_min(s.id, (s.end_line - s.start_line, s.id)) AS symbol_id FROM loc l JOIN c_symbols s ON l.file_id = s.file_id AND l.line BETWEEN s.start_line AND s.end_line
  WHERE NOT (s.kind IN ('Class') AND l.line BETWEEN s.start_line + 1 AND s.end_line) GROUP BY occurrence_id"""))
def lsp_definition_match(spark, sf):
    s = ca.symbols(spark, sf)
    body = F.col("kind") == "Class"
    s = s.withColumn("body_start_line", F.when(body, F.col("start_line") + 1)).withColumn("body_end_line", F.when(body, F.col("end_line")))
    return graph.match_definitions(_locations(spark, sf), s)


@register("edge_upgrade", _with(""", e AS (SELECT *, from_symbol_id % 1000 AS occurrence_id FROM c_edges), x AS (SELECT s_suppkey AS occurrence_id, s_suppkey + 1000000000 AS symbol_id FROM supplier)
  SELECT id, CASE WHEN symbol_id IS NOT NULL AND confidence <> 'LspExact' THEN symbol_id ELSE to_symbol_id END AS to_symbol_id, CASE WHEN symbol_id IS NOT NULL THEN 'LspExact' ELSE confidence END AS confidence FROM e LEFT JOIN x ON e.occurrence_id = x.occurrence_id"""))
def edge_upgrade(spark, sf):
    e = ca.edges(spark, sf).withColumn("occurrence_id", F.col("from_symbol_id") % 1000)
    m = ca.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("occurrence_id"), (F.col("s_suppkey") + ca.SUPPLIER).alias("symbol_id"))
    return graph.upgrade_edges(e, m).select("id", "to_symbol_id", "confidence")


_FIND = f""", f AS (SELECT CASE WHEN qualified_name = '{SYMBOL}1' THEN 0 WHEN name = '{SYMBOL}1' THEN 1 WHEN contains(lower(qualified_name), lower('{SYMBOL}1')) THEN 2 WHEN contains(lower(name), lower('{SYMBOL}1')) THEN 3 END AS tier, s.id, name, qualified_name, kind, rel_path FROM c_symbols s LEFT JOIN c_files ON s.file_id = c_files.id)"""


def _find(spark, sf):
    return graph.find_symbols(ca.symbols(spark, sf), ca.files(spark, sf), f"{SYMBOL}1")


@register("find_symbols", _with(_FIND + " SELECT tier, id, name, qualified_name, kind, rel_path FROM f WHERE tier IS NOT NULL"))
def find_symbols(spark, sf):
    return _find(spark, sf)


@register("resolve_symbol", _with(_FIND + """, b AS (SELECT least(tier, 2) AS t, count(*) AS n, min(id) AS id FROM f WHERE tier IS NOT NULL GROUP BY 1 ORDER BY t LIMIT 1) SELECT CASE WHEN n = 1 THEN 'Unique' ELSE 'Ambiguous' END AS status, n AS matches, CASE WHEN n = 1 THEN id END AS id FROM b"""))
def resolve_symbol(spark, sf):
    return graph.resolve_symbol(_find(spark, sf))


@register("resolve_roots", _with(f""", q AS (SELECT s.id, name, qualified_name, rel_path AS path, CASE WHEN qualified_name = 'supplier#000000001' THEN [0, 100] WHEN name = 'supplier#000000001' THEN [1, 90] WHEN lower(qualified_name) = 'supplier#000000001' THEN [2, 80] WHEN lower(name) = 'supplier#000000001' THEN [2, 75]
  WHEN lower(rel_path) = 'supplier#000000001' THEN [3, 70] WHEN contains(lower(qualified_name), 'supplier#000000001') THEN [5, 40] ELSE [6, 0] END AS c FROM c_symbols s JOIN c_files f ON s.file_id = f.id)
  SELECT id, name, qualified_name, path, c[1] AS class, c[2] AS score FROM q WHERE c[2] > 0 AND c[1] <= 2 ORDER BY score DESC, octet_length(encode(qualified_name)), id LIMIT 5"""))
def resolve_roots(spark, sf):
    return graph.resolve_roots(ca.symbols(spark, sf), ca.files(spark, sf), "supplier#000000001")


def _slice_sql(reverse: bool) -> str:
    a, b = ("to_symbol_id", "from_symbol_id") if reverse else ("from_symbol_id", "to_symbol_id")
    root = ca.SUPPLIER + 3 if reverse else ca.CUSTOMER + 7
    return f""", tests AS (SELECT id FROM c_symbols WHERE kind = 'Test'), st AS (SELECT DISTINCT {a} AS a, {b} AS b FROM c_edges WHERE to_symbol_id IS NOT NULL AND {b} NOT IN (SELECT id FROM tests)
    ), w(id, depth) AS (SELECT {root}::BIGINT, 0 UNION SELECT b, depth + 1 FROM w JOIN st ON id = a WHERE depth < 3) SELECT id::BIGINT AS id, min(depth)::INTEGER AS depth FROM w GROUP BY id"""


def _slice(reverse: bool) -> Query:
    def run(spark, sf):
        root = spark.range(1).select(F.lit(ca.SUPPLIER + 3 if reverse else ca.CUSTOMER + 7).cast("long").alias("id"))
        return graph.slice_from(ca.edges(spark, sf), ca.symbols(spark, sf), root, reverse, 3)

    return run


register("forward_slice", "WITH RECURSIVE" + _with(_slice_sql(False))[4:])(_slice(False))
register("reverse_slice", "WITH RECURSIVE" + _with(_slice_sql(True))[4:])(_slice(True))


def _context_sql(mode: str, depth: int) -> str:
    kinds = _in(graph.KINDS.get(mode, graph.DEFAULT_KINDS))
    root, layers = f"{ca.PART + 5}", []
    for d in range(depth):
        ways = ("in", "out") if mode == "impact" and d == 0 else graph.DIRECTIONS[mode]
        steps = " UNION ALL ".join(
            f"SELECT {'from' if w == 'in' else 'to'}_symbol_id AS id, '{w}' AS direction, l.id AS parent_id FROM u JOIN l{d} l ON u.{'to' if w == 'in' else 'from'}_symbol_id = l.id" for w in ways
        )
        seen = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(d + 1))
        layers.append(f"l{d + 1} AS (SELECT id, {d + 1} AS distance, min((direction, parent_id)) AS x FROM ({steps}) WHERE id NOT IN ({seen}) GROUP BY id)")
    rows = f"SELECT id, 0 AS distance, NULL::BIGINT AS parent_id, 'root' AS direction FROM l0 " + " ".join(f"UNION ALL SELECT id, {d}, x[2], x[1] FROM l{d}" for d in range(1, depth + 1))
    return f", u AS (SELECT * FROM c_edges WHERE kind IN {kinds} AND to_symbol_id IS NOT NULL AND confidence <> 'Unresolved'), l0 AS (SELECT {root}::BIGINT AS id), {', '.join(layers)} {rows}"


def _context(mode: str, depth: int) -> Query:
    def run(spark, sf):
        root = spark.range(1).select(F.lit(ca.PART + 5).cast("long").alias("id"))
        return graph.context(ca.edges(spark, sf), ca.symbols(spark, sf), root, mode, depth)

    return run


for _mode, _name in (("neighborhood", "graph_neighborhood"), ("impact", "graph_impact"), ("callers", "graph_callers"), ("dependencies", "graph_dependencies")):
    register(_name, _with(_context_sql(_mode, 2)))(_context(_mode, 2))


@register("relationship_lines", _with(""", n AS (SELECT e.kind, e.from_symbol_id, e.to_symbol_id, a.qualified_name AS a, b.qualified_name AS b FROM c_edges e JOIN c_symbols a ON e.from_symbol_id = a.id JOIN c_symbols b ON e.to_symbol_id = b.id
  ), l AS (SELECT from_symbol_id AS id, '[out ' || kind || '] ' || a || ' -> ' || b AS line FROM n UNION SELECT to_symbol_id, '[in ' || kind || '] ' || a || ' -> ' || b FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS k FROM l)
  SELECT id, string_agg(line, chr(10) ORDER BY line) AS lines FROM r WHERE k <= 10 GROUP BY id"""))
def relationship_lines(spark, sf):
    return graph.relationship_lines(ca.edges(spark, sf), ca.symbols(spark, sf))


# ---- chunks

_WINDOW = "CASE WHEN len(ls) > 0 AND greatest({a}, 1) <= least({b}, len(ls)) THEN array_to_string(ls[greatest({a}, 1):least({b}, len(ls))], chr(10)) || chr(10) ELSE '' END"
_LS = "d AS (SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[] ELSE list_transform(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)), lambda x: regexp_replace(x, '\\r\\z', '')) END AS ls FROM documents)"


def _document_lines(spark, sf):
    return ca.table(spark, sf, "documents").select("doc_id", tx.lines_of(F.col("text")).alias("ls"))


@register("chunk_windows", f"WITH {_LS}, r AS (SELECT *, doc_id % 7 + 1 AS s, doc_id % 7 + 3 + doc_id % 4 AS e FROM d) SELECT doc_id, t AS text, floor(length(t) / 4.0)::BIGINT AS token_count, sha256(t) AS text_hash FROM (SELECT doc_id, {_WINDOW.format(a='s - 2', b='e + 2')} AS t FROM r)")
def chunk_windows(spark, sf):
    i = F.col("doc_id")
    w = _document_lines(spark, sf).select("doc_id", tx.line_window(F.col("ls"), i % 7 + 1, i % 7 + 3 + i % 4, 2).alias("text"))
    return w.withColumn("token_count", tx.chunk_tokens(F.col("text"))).withColumn("text_hash", F.sha2("text", 256))


@register("large_bodies", f"""WITH {_LS}, r AS (SELECT *, 1 AS s, len(ls) AS e FROM d WHERE len(ls) > 0) SELECT doc_id, CASE WHEN e - s + 1 <= 20 THEN {_WINDOW.format(a='s - 2', b='e + 2')} ELSE {_WINDOW.format(a='s - 2', b='least(s + 15, len(ls))')}
  || CASE WHEN greatest(e - 15, s) - least(s + 15, len(ls)) > 0 THEN '// ... ' || (greatest(e - 15, s) - least(s + 15, len(ls))) || ' lines omitted ...' || chr(10) ELSE '' END || {_WINDOW.format(a='greatest(greatest(e - 15, s), least(s + 15, len(ls)) + 1)', b='least(e + 2, len(ls))')} END AS text FROM r""")
def large_bodies(spark, sf):
    d = _document_lines(spark, sf).where(F.size("ls") > 0)
    s, e = F.lit(1), F.size("ls")
    return d.select("doc_id", tx.large_body(F.col("ls"), s, e, s, e, 2, limit=20).alias("text"))


@register("read_file_slice", f"""WITH {_LS}, r AS (SELECT doc_id, ls, least(greatest(doc_id % 30, 1), len(ls)) AS a, len(ls) AS n FROM d) SELECT doc_id, CASE WHEN n = 0 THEN '' ELSE array_to_string(ls[a:least(greatest(least(doc_id % 30 + 9, n), a), a + 4)], chr(10)) END AS text FROM r""")
def read_file_slice(spark, sf):
    i = F.col("doc_id")
    return _document_lines(spark, sf).select("doc_id", chunks.read_lines(F.col("ls"), i % 30, i % 30 + 9, 5).alias("text"))


# ---- search

_ANALYSE = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' AND octet_length(encode(x)) <= 40)"


def _bm25_sql(limit: int) -> str:
    terms = search.query_terms(SEARCH)
    return f"""t AS (SELECT doc_id, {_ANALYSE} AS t FROM documents), l AS (SELECT doc_id, t, len(t) AS n FROM t), a AS (SELECT count(*) AS docs, avg(n) AS m FROM l
    ), q AS (SELECT unnest({terms!r}) AS w), f AS (SELECT doc_id, n, w, len(list_filter(t, lambda x: x = w)) AS tf FROM l, q), df AS (SELECT w, count(DISTINCT doc_id) FILTER (tf > 0) AS df FROM f GROUP BY w
    ), lexical AS (SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / m))), 6) AS score FROM f JOIN df USING (w), a WHERE tf > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {limit})"""


_KNN = """dense AS (SELECT vec_id AS doc_id, round(list_inner_product(embedding::DOUBLE[], q) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q, q))), 6) AS score
  FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) ORDER BY score DESC, doc_id LIMIT 50)"""


#: Lexical indexes that this application has built, by the files that they were built from.
_INDEXES: dict[tuple, str] = {}


def lexical_index(spark, sf):
    """The folder of the documents' lexical index, built at first use and again when their files change."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    files = at.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(at)
    key = (sc.applicationId, *sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    if key not in _INDEXES:
        root = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
        lexical.build(ca.table(spark, sf, "documents"), "doc_id", ["text"], root)
        _INDEXES[key] = root
    return _INDEXES[key]


def _bm25(spark, sf, limit=50):
    return lexical.search(spark, lexical_index(spark, sf), SEARCH, limit, "doc_id")


def _knn(spark, sf, limit=50):
    e = ca.table(spark, sf, "embeddings")
    query = e.where("vec_id = 0").select("embedding").first()["embedding"]  # one row by its id
    return search.knn(e, "vec_id", "embedding", query, limit).withColumnRenamed("vec_id", "doc_id")


@register("bm25_topk", f"WITH {_bm25_sql(50)} SELECT * FROM lexical")
def bm25_topk(spark, sf):
    return _bm25(spark, sf)


@register("knn_cosine", f"WITH {_KNN} SELECT * FROM dense")
def knn_cosine(spark, sf):
    return _knn(spark, sf)


_RRF = f"""WITH {_bm25_sql(50)}, {_KNN}, h AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM lexical UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) FROM dense
), fused AS (SELECT doc_id AS chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM h GROUP BY doc_id ORDER BY score DESC, chunk_id LIMIT 30)"""


def _fused(spark, sf):
    as_hits = lambda df: df.select(F.col("doc_id").alias("chunk_id"), F.lit(None).cast("long").alias("symbol_id"), "score")
    return search.hybrid(as_hits(_bm25(spark, sf)), as_hits(_knn(spark, sf)))


@register("rrf_hybrid", _RRF + " SELECT * FROM fused")
def rrf_hybrid(spark, sf):
    return _fused(spark, sf).select("chunk_id", "score")


@register("rerank_prefix", _RRF + """, p AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM fused), s AS (SELECT chunk_id, place, CASE WHEN place <= 10 THEN (chunk_id * 7919 % 101) / 101.0::DOUBLE ELSE score END AS score FROM p)
  SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY place <= 10 DESC, CASE WHEN place <= 10 THEN score END DESC NULLS LAST, CASE WHEN place <= 10 THEN chunk_id END, place)::INTEGER AS rank FROM s""")
def rerank_prefix(spark, sf):
    return search.rerank(_fused(spark, sf), F.col("chunk_id") * 7919 % 101 / F.lit(101.0), 10).select("chunk_id", F.round("score", 6).alias("score"), "rank")


# ---- ranking and packing

_CANDIDATES = """, cand AS (SELECT s.id, name, qualified_name, rel_path AS path, (s.id % 5)::INTEGER AS distance, CASE s.id % 4 WHEN 0 THEN 'LspExact' WHEN 1 THEN 'Syntax' WHEN 2 THEN 'Heuristic' END AS confidence FROM c_symbols s JOIN c_files f ON s.file_id = f.id WHERE kind = 'Class'
), g AS (SELECT *, CASE distance WHEN 0 THEN 10 WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 0 END + CASE WHEN path = 'src/asia/nation_2.rs' THEN 2 WHEN starts_with(path, 'src/asia/') THEN 1 ELSE 0 END
  + CASE confidence WHEN 'LspExact' THEN 2.0::DOUBLE WHEN 'Syntax' THEN 1.2::DOUBLE WHEN 'Heuristic' THEN 0.5::DOUBLE ELSE 0 END AS graph_score FROM cand)"""


def _candidates(spark, sf):
    s, f = ca.symbols(spark, sf).where("kind = 'Class'"), ca.files(spark, sf).select(F.col("id").alias("file_id"), F.col("rel_path").alias("path"))
    confidence = F.when(F.col("id") % 4 == 0, "LspExact").when(F.col("id") % 4 == 1, "Syntax").when(F.col("id") % 4 == 2, "Heuristic")
    return s.join(f, "file_id").select("id", "name", "qualified_name", "path", (F.col("id") % 5).cast("int").alias("distance"), confidence.alias("confidence"))


def _root_paths(spark):
    return spark.range(1).select(F.lit("src/asia/nation_2.rs").alias("path"))


@register("graph_rank", _with(_CANDIDATES + " SELECT id, round(graph_score, 6)::DOUBLE AS score FROM g"))
def graph_rank(spark, sf):
    return rank.rank(_candidates(spark, sf), _root_paths(spark), "x", "graph").select("id", "score")


_TOK = "list_transform(list_filter(string_split_regex({c}, '[:._/\\\\\\s-]+'), lambda v: v <> ''), lambda v: lower(v))"
_LEX = (
    ", k AS (SELECT *, "
    + ", ".join(f"{_TOK.format(c=c)} AS t{i}" for i, c in enumerate(("name", "qualified_name", "path")))
    + """ FROM g), q AS (SELECT unnest(['asia', 'nation', 'asia nation']) AS w), h AS (SELECT id, graph_score, octet_length(encode(qualified_name)) AS len, w, list_append(t0, lower(name)) AS t0, list_append(t1, lower(qualified_name)) AS t1, list_append(t2, lower(path)) AS t2 FROM k, q
  ), i AS (SELECT w, count(*) FILTER (list_contains(t0, w) OR list_contains(t1, w) OR list_contains(t2, w)) AS df, count(*) AS n FROM h GROUP BY w
  ), m AS (SELECT h.*, greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 0.1) AS idf FROM h JOIN i ON h.w = i.w
  ), v AS (SELECT id, graph_score, idf, """
    + ", ".join(
        f"CASE WHEN list_contains({t}, w) THEN {a} WHEN len(list_filter({t}, lambda x: starts_with(x, w) OR starts_with(w, x))) > 0 THEN {b} {f'WHEN len(list_filter({t}, lambda x: regexp_matches(x, array_to_string(regexp_extract_all(w, chr(46)), chr(46) || chr(42))))) > 0 THEN {c}' if c else ''} ELSE 0 END::DOUBLE AS s{j}"
        for j, (t, a, b, c) in enumerate((("t0", 3, 1.5, 0.5), ("t1", 2, 1, 0.3), ("t2", 1, 0.5, None)))
    )
    + " FROM m), lx AS (SELECT id, any_value(graph_score) AS graph_score, sum(idf * (s0 + s1 + s2)) AS lexical_score FROM v GROUP BY id)"
)


@register("lexical_rank", _with(_CANDIDATES + _LEX + " SELECT id, round(lexical_score, 6) AS score FROM lx"))
def lexical_rank(spark, sf):
    return rank.rank(_candidates(spark, sf), _root_paths(spark), "asia nation", "lexical").select("id", "score")


@register("hybrid_rank", _with(_CANDIDATES + _LEX + " SELECT id, round(lexical_score + graph_score, 6) AS score FROM lx"))
def hybrid_rank(spark, sf):
    return rank.rank(_candidates(spark, sf), _root_paths(spark), "asia nation", "hybrid").select("id", "score")


_PACK = """c AS (SELECT c_custkey // 60 AS query_id, c_custkey AS id, 'f' || c_custkey % 11 AS path, (c_custkey * 37 % 400)::BIGINT AS tokens, c_custkey % 60 = 0 AS is_root, row_number() OVER (PARTITION BY c_custkey // 60 ORDER BY c_custkey) AS place FROM customer
), w(query_id, place, id, status, remaining, nodes, files) AS (
  SELECT query_id, place, id, 'included', greatest(1500 - tokens, 0), 1, [path] FROM c WHERE place = 1
  UNION ALL SELECT query_id, place, id, status, CASE WHEN status = 'included' THEN greatest(remaining - tokens, 0) ELSE remaining END, nodes + (status = 'included')::INT, CASE WHEN status = 'included' AND NOT list_contains(files, path) THEN list_append(files, path) ELSE files END FROM (
    SELECT c.query_id, c.place, c.id, c.tokens, c.path, w.remaining, w.nodes, w.files, CASE WHEN c.is_root THEN 'included' WHEN nodes >= 12 THEN 'Truncated: max_nodes limit reached' WHEN NOT list_contains(files, c.path) AND len(files) >= 8 THEN 'Truncated: max_files limit reached'
    WHEN c.tokens > remaining THEN 'Truncated: token budget exceeded' ELSE 'included' END AS status FROM w JOIN c ON w.query_id = c.query_id AND c.place = w.place + 1))"""


@register("budget_pack", f"WITH RECURSIVE {_PACK} SELECT query_id, id, status, remaining AS left FROM w".replace(" AS left", ' AS "left"'))
def budget_pack(spark, sf):
    c = ca.table(spark, sf, "customer")
    k = F.col("c_custkey")
    own = c.select(F.floor(k / 60).alias("query_id"), k.alias("id"), F.concat(F.lit("f"), (k % 11).cast("string")).alias("path"), (k * 37 % 400).alias("tokens"), (k % 60 == 0).alias("is_root"), k.alias("place"))
    return pack.pack(own, 1500, 12, 8)


# ---- maintenance

_DISK = "SELECT 'p' || o_orderkey AS path, o_custkey AS mtime_ms, floor(o_totalprice + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS size_bytes FROM orders WHERE o_orderstatus <> 'P'"
_INDEX = "SELECT 'p' || o_orderkey AS path, o_custkey AS mtime_ms, floor(o_totalprice)::BIGINT AS size_bytes, CASE WHEN o_orderpriority = '5-LOW' THEN 'Failed' ELSE 'Success' END AS parse_status FROM orders WHERE o_orderstatus <> 'F'"
_DIFF = f"disk AS ({_DISK}), idx AS ({_INDEX}), df AS (SELECT coalesce(d.path, i.path) AS path, CASE WHEN i.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'deleted' WHEN d.mtime_ms <> i.mtime_ms OR d.size_bytes <> i.size_bytes OR parse_status = 'Failed' THEN 'modified' ELSE 'unchanged' END AS status FROM disk d FULL JOIN idx i ON d.path = i.path)"


def _snapshots(spark, sf):
    o = ca.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    base = o.select("o_orderstatus", "o_orderpriority", F.concat(F.lit("p"), k.cast("string")).alias("path"), F.col("o_custkey").alias("mtime_ms"), F.col("o_totalprice").alias("price"), F.lit(None).cast("string").alias("content_hash"))
    disk = base.where("o_orderstatus <> 'P'").withColumn("size_bytes", F.floor(F.col("price") + F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).cast("long"))
    index = base.where("o_orderstatus <> 'F'").withColumn("size_bytes", F.floor("price").cast("long")).withColumn("parse_status", F.when(F.col("o_orderpriority") == "5-LOW", "Failed").otherwise("Success"))
    return tuple(x.drop("price", "o_orderstatus", "o_orderpriority") for x in (disk, index))


@register("index_diff", f"WITH {_DIFF} SELECT path, status FROM df")
def index_diff(spark, sf):
    return maintain.diff(*_snapshots(spark, sf))


@register("index_state", f"WITH {_DIFF} SELECT 'NeedsIncrementalUpdate' AS state, NULL::VARCHAR AS reason, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'deleted') AS deleted FROM df")
def index_state(spark, sf):
    stored = spark.range(1).select(F.lit("schema_version").alias("key"), F.lit("1").alias("value"))
    return maintain.index_state(maintain.diff(*_snapshots(spark, sf)), maintain.rebuild_reason(stored, {"schema_version": "1"}))


_GONE = ", gone AS (SELECT n_nationkey::BIGINT AS file_id FROM nation WHERE n_regionkey = 0)"


def _gone(spark, sf):
    return ca.table(spark, sf, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("file_id"))


@register("cascade_delete", _with(_GONE + """, dead AS (SELECT id FROM c_symbols WHERE file_id IN (SELECT file_id FROM gone)) SELECT id, CASE WHEN to_symbol_id NOT IN (SELECT id FROM dead) THEN to_symbol_id END AS to_symbol_id,
  CASE WHEN to_symbol_id IN (SELECT id FROM dead) THEN 'Unresolved' ELSE confidence END AS confidence FROM c_edges WHERE from_symbol_id NOT IN (SELECT id FROM dead)"""))
def cascade_delete(spark, sf):
    t = {"files": ca.files(spark, sf), "symbols": ca.symbols(spark, sf), "occurrences": ca.occurrences(spark, sf), "edges": ca.edges(spark, sf)}
    return maintain.cascade(t, _gone(spark, sf))["edges"].select("id", "to_symbol_id", "confidence")


@register("affected_occurrences", _with(_GONE + """, e AS (SELECT to_symbol_id, from_symbol_id % 1000 AS occurrence_id FROM c_edges), o AS (SELECT DISTINCT enclosing_symbol_id % 1000 AS id, file_id FROM c_occurrences)
  SELECT occurrence_id FROM e WHERE to_symbol_id IN (SELECT id FROM c_symbols WHERE file_id IN (SELECT file_id FROM gone)) UNION SELECT id FROM o WHERE file_id IN (SELECT file_id FROM gone)"""))
def affected_occurrences(spark, sf):
    e = ca.edges(spark, sf).withColumn("occurrence_id", F.col("from_symbol_id") % 1000)
    o = ca.occurrences(spark, sf).select((F.col("enclosing_symbol_id") % 1000).alias("id"), "file_id").distinct()
    return maintain.affected(o, e, ca.symbols(spark, sf), _gone(spark, sf))


@register("invariants", _with(""", s AS (SELECT * FROM c_symbols WHERE kind <> 'Test') SELECT 'symbols_without_file' AS name, count(*) FILTER (file_id NOT IN (SELECT id FROM c_files)) AS violations FROM s UNION ALL SELECT 'occurrences_without_file', count(*) FILTER (file_id NOT IN (SELECT id FROM c_files)) FROM c_occurrences
  UNION ALL SELECT 'edges_from_missing_symbol', count(*) FILTER (from_symbol_id NOT IN (SELECT id FROM s)) FROM c_edges UNION ALL SELECT 'edges_to_missing_symbol', count(*) FILTER (to_symbol_id NOT IN (SELECT id FROM s)) FROM c_edges"""))
def invariants(spark, sf):
    return maintain.invariants(ca.files(spark, sf), ca.symbols(spark, sf).where("kind <> 'Test'"), ca.occurrences(spark, sf), ca.edges(spark, sf))


@register("incremental_equals_full", "SELECT 'only_full' AS side, 0::BIGINT AS n UNION ALL SELECT 'only_incremental', 0::BIGINT")
def incremental_equals_full(spark, sf):
    """An index whose files of one region had other names, bounds and calls, after these files change to what they are, has the edges of a full build: calls and nesting, with their ids."""
    s, o, f = ca.symbols(spark, sf), ca.occurrences(spark, sf), ca.files(spark, sf)
    if "id" not in o.columns:
        o = o.withColumn("id", F.xxhash64(*o.columns))
    gone = _gone(spark, sf)
    mark = gone.select("file_id", F.lit(True).alias("was"))
    odd = F.col("id") % 3 == 0
    old_s = s.join(mark, "file_id", "left").withColumn("name", F.when(F.col("was") & odd, F.concat(F.lit("old_"), "name")).otherwise(F.col("name"))).withColumn("end_line", F.when(F.col("was") & odd, F.col("start_line")).otherwise(F.col("end_line"))).select(s.columns)
    old_o = o.join(mark, "file_id", "left").withColumn("raw_text", F.when(F.col("was") & odd, F.concat(F.lit("old_"), "raw_text")).otherwise(F.col("raw_text"))).select(o.columns)
    both = lambda oo, ss: graph.call_edges(oo, ss).unionByName(graph.nested_edges(graph.contains_edges(ss)))
    again = {"files": f.join(gone.withColumnRenamed("file_id", "id"), "id", "left_semi"), "symbols": s.join(gone, "file_id", "left_semi"), "occurrences": o.join(gone, "file_id", "left_semi")}
    full = both(o, s)
    merged = maintain.merge({"files": f, "symbols": old_s, "occurrences": old_o, "edges": both(old_o, old_s)}, again, gone)["edges"].select(full.columns)
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(full.exceptAll(merged), "only_full").unionAll(count(merged.exceptAll(full), "only_incremental"))


@register("vector_upsert", "SELECT vec_id, CASE WHEN label = 3 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label + 100 FROM embeddings WHERE label = 3")
def vector_upsert(spark, sf):
    e = ca.table(spark, sf, "embeddings").select("vec_id", "label")
    some = e.where("label = 3").withColumn("label", F.col("label") + 100)
    return search.upsert(e, some.unionAll(some.withColumn("vec_id", F.col("vec_id") + 1_000_000)), "vec_id")


# ---- coverage, exports


@register("coverage_lcov", """WITH l AS (SELECT c_nationkey AS f, c_custkey % 40 AS line, arg_max((c_custkey * 13 % 4), c_custkey) AS hits FROM customer GROUP BY ALL) SELECT 'src/f' || f || '.rs' AS path, count(*) FILTER (hits > 0) AS covered, count(*) AS coverable FROM l GROUP BY f""")
def coverage_lcov(spark, sf):
    c = ca.table(spark, sf, "customer")
    k, f = F.col("c_custkey"), F.col("c_nationkey")
    report, base = F.concat(F.lit("r"), f.cast("string")), k * 10 + 5
    data = c.select(report.alias("report"), base.alias("line_no"), F.format_string("DA:%d,%d", k % 40, k * 13 % 4).alias("line"))
    heads = c.select(report.alias("report"), F.lit(-1).cast("long").alias("line_no"), F.format_string("SF:src/f%d.rs", f).alias("line")).distinct()
    ends = c.groupBy(report.alias("report")).agg((F.max(k) * 10 + 9).alias("line_no")).withColumn("line", F.lit("end_of_record"))
    return coverage.per_file(coverage.lcov(data.unionByName(heads).unionByName(ends)))


@register("export_features", _with(""" SELECT s.id, '{"id":' || s.id || ',"name":"' || name || '","qualified_name":"' || qualified_name || '","kind":"' || kind || '","rel_path":"' || rel_path || '"}' AS json FROM c_symbols s JOIN c_files f ON s.file_id = f.id"""))
def export_features(spark, sf):
    return export.features(ca.symbols(spark, sf), ca.files(spark, sf))


@register("export_graphml", _with(""" SELECT 0 AS section, 0::BIGINT AS id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' || chr(10) || '<graph edgedefault="directed">' AS line UNION ALL SELECT 3, 0, '</graph>' || chr(10) || '</graphml>'
  UNION ALL SELECT 1, id, '<node id="n' || id || '"><data key="name">' || qualified_name || '</data></node>' FROM c_symbols UNION ALL SELECT 2, id, '<edge source="n' || from_symbol_id || '" target="n' || to_symbol_id || '"/>' FROM c_edges WHERE kind = 'Call' AND to_symbol_id IS NOT NULL"""))
def export_graphml(spark, sf):
    return export.graphml(ca.symbols(spark, sf), ca.edges(spark, sf))


_ESC = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@register("render_xml", _with(f""" SELECT path, '<file path="' || {_ESC.format(c='path')} || '">' || {_ESC.format(c='content')} || '</file>' AS text FROM c_pages"""))
def render_xml(spark, sf):
    return export.xml(ca.pages(spark, sf))


@register("render_plain", _with(""" SELECT path, '=== ' || path || ' (' || CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024.0) ELSE printf('%.1f MB', bytes / 1048576.0) END || ', ~' || ceil(length(content) / 4.0)::BIGINT || ' tokens) ===' || chr(10) || content AS text FROM c_pages"""))
def render_plain(spark, sf):
    return export.plain(ca.pages(spark, sf))


@register("symbols_by_file", _with(" SELECT rel_path, count(*) AS symbols, string_agg(name, ',' ORDER BY start_line, s.id) AS names FROM c_symbols s JOIN c_files f ON s.file_id = f.id GROUP BY rel_path"))
def symbols_by_file(spark, sf):
    return export.grouped_symbols(ca.symbols(spark, sf), ca.files(spark, sf))


@register("symbol_lines", _with(" SELECT s.id, lower(kind) || ' ' || qualified_name || ' (' || rel_path || ':' || start_line || ')' AS line FROM c_symbols s JOIN c_files f ON s.file_id = f.id"))
def symbol_lines(spark, sf):
    return export.symbol_list(ca.symbols(spark, sf), ca.files(spark, sf))


@register("test_symbols_filtered", _with(" SELECT id, qualified_name FROM c_symbols WHERE kind <> 'Test'"))
def test_symbols_filtered(spark, sf):
    return ca.symbols(spark, sf).where("kind <> 'Test'").select("id", "qualified_name")


@register("first_hit_wins", "WITH h AS (SELECT l_partkey AS symbol_id, l_orderkey AS seq, l_linenumber AS line, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS r, l_suppkey FROM lineitem) SELECT symbol_id, seq, line, l_suppkey FROM h WHERE r = 1")
def first_hit_wins(spark, sf):
    """The first of a symbol's ordered hits: a struct minimum with map-side partials instead of a window over a symbol's hits."""
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("x")
    g = ca.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("symbol_id")).agg(first)
    return g.select("symbol_id", F.col("x.l_orderkey").alias("seq"), F.col("x.l_linenumber").alias("line"), F.col("x.l_suppkey").alias("l_suppkey"))


@register("layer_frontier", _with(""", r AS (SELECT id, qualified_name, (id % 4)::INTEGER AS depth, (id * 31 % 97)::INTEGER AS score FROM c_symbols), k AS (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY score DESC, octet_length(encode(qualified_name)), id) AS n FROM r) SELECT id, depth, score FROM k WHERE n <= 50"""))
def layer_frontier(spark, sf):
    """The best 50 of each layer."""
    s = ca.symbols(spark, sf).select("id", "qualified_name", (F.col("id") % 4).cast("int").alias("depth"), (F.col("id") * 31 % 97).cast("int").alias("score"))
    n = F.row_number().over(W.partitionBy("depth").orderBy(*rank.order()))
    return s.withColumn("n", n).where("n <= 50").select("id", "depth", "score")
