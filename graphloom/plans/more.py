"""Further registered queries: hit expansion, chunks, ignore rules, snippets, traversal trees, renderings."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from graphloom.functions import text as tx
from graphloom.operators import chunks, graph, models, pack, rank, stats
from graphloom.plans import retrieve
from graphloom.plans.registry import _CANDIDATES, _LS, _WINDOW, _candidates, _document_lines, _root_paths, _with, register
from graphloom.sources import carriers as ca, coverage, ignore


@register("whitespace_token_ids", "SELECT doc_id, least(n, 512)::INTEGER AS tokens, CASE WHEN n > 0 THEN least(n, 512) ELSE 0 END::INTEGER AS last_id FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)")
def whitespace_token_ids(spark, sf):
    d = ca.table(spark, sf, "documents").select("doc_id", models.whitespace_ids(F.col("text")).alias("ids"))
    return d.select("doc_id", F.size("ids").alias("tokens"), F.coalesce(F.array_max("ids"), F.lit(0)).alias("last_id"))


@register("batch_ranges", "SELECT ((c_custkey) // 16)::INTEGER AS batch, min(c_custkey) AS first, max(c_custkey) AS last, count(*) AS n FROM customer GROUP BY 1")
def batch_ranges(spark, sf):
    c = ca.table(spark, sf, "customer").withColumn("batch", models.batch_number(F.col("c_custkey") + 1))
    return c.groupBy("batch").agg(F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"), F.count(F.lit(1)).alias("n"))


@register("list_symbols_kind_after_limit", _with(" SELECT id, name, kind FROM (SELECT * FROM c_symbols WHERE contains(lower(name), '1') ORDER BY id LIMIT 100) WHERE kind = 'Class'"))
def list_symbols_kind_after_limit(spark, sf):
    """The kind is asked of what the limit left, not before it."""
    return graph.list_symbols(ca.symbols(spark, sf), "1", 100, "Class").select("id", "name", "kind")


# chunks: documents as summaries, conversations' turns as their children

_CHUNKS = """ch AS (SELECT doc_id AS id, doc_id AS symbol_id, NULL::BIGINT AS parent_chunk_id, 0::BIGINT AS start_line FROM documents
  UNION ALL SELECT 1000000 + conv_id * 1000 + turn, 5000000 + conv_id * 7 % 50, conv_id, turn FROM conversations)"""


def _chunk_table(spark, sf):
    d = ca.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("symbol_id"), F.lit(None).cast("long").alias("parent_chunk_id"), F.lit(0).cast("long").alias("start_line"))
    k = F.col("conv_id")
    return d.unionByName(ca.table(spark, sf, "conversations").select((1_000_000 + k * 1000 + F.col("turn")).alias("id"), (5_000_000 + k * 7 % 50).alias("symbol_id"), k.alias("parent_chunk_id"), F.col("turn").alias("start_line")))


@register("child_chunks", f"WITH {_CHUNKS}, r AS (SELECT parent_chunk_id, id, row_number() OVER (PARTITION BY parent_chunk_id ORDER BY start_line, id) AS n FROM ch WHERE parent_chunk_id IS NOT NULL) SELECT parent_chunk_id, id, n::INTEGER AS n FROM r WHERE n <= 3")
def child_chunks(spark, sf):
    return chunks.children(_chunk_table(spark, sf), 3)


@register("hit_expansion", f"""WITH {_CHUNKS}, h AS (SELECT id AS chunk_id, (id * 37 % 101) / 101.0::DOUBLE AS score FROM ch), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM h
  ), e AS (SELECT c.symbol_id, score * 1.0 AS score, place, 0 AS origin, 0 AS n FROM p JOIN ch c ON c.id = p.chunk_id UNION ALL SELECT u.symbol_id, score * 0.8::DOUBLE, place, 1, 0 FROM p JOIN ch c ON c.id = p.chunk_id JOIN ch u ON u.id = c.parent_chunk_id
  UNION ALL SELECT symbol_id, score * 0.7::DOUBLE, place, 2, n FROM (SELECT d.symbol_id, score, place, row_number() OVER (PARTITION BY p.chunk_id ORDER BY d.start_line, d.id) AS n FROM p JOIN ch d ON d.parent_chunk_id = p.chunk_id) WHERE n <= 5)
  SELECT symbol_id, round(arg_min(score, (place, origin, n)), 6) AS score, arg_min(origin, (place, origin, n))::INTEGER AS origin FROM e GROUP BY symbol_id""")
def hit_expansion(spark, sf):
    c = _chunk_table(spark, sf)
    hits = c.select(F.col("id").alias("chunk_id"), (F.col("id") * 37 % 101 / F.lit(101.0)).alias("score"))
    return retrieve.expand_hits(hits, c)


def _doc_symbols(spark, sf):
    """Two nested symbols per document, with bodies, and one occurrence."""
    d = ca.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    lit = lambda x: F.lit(x).cast("long")
    outer = d.select((F.col("doc_id") * 2).alias("id"), F.col("doc_id").alias("file_id"), F.concat(F.lit("d"), "doc_id").alias("qualified_name"), lit(1).alias("start_line"), lit(6).alias("end_line"), lit(None).alias("body_start_line"), lit(None).alias("body_end_line"))
    inner = d.select((F.col("doc_id") * 2 + 1).alias("id"), F.col("doc_id").alias("file_id"), F.concat(F.lit("d"), "doc_id", F.lit("::in")).alias("qualified_name"), lit(2).alias("start_line"), lit(4).alias("end_line"), lit(3).alias("body_start_line"), lit(4).alias("body_end_line"))
    parents = d.select((F.col("doc_id") * 2).alias("parent_id"), (F.col("doc_id") * 2 + 1).alias("child_id"))
    occ = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file_id"), (F.col("doc_id") * 2 + 1).alias("enclosing_symbol_id"), F.lit("raw").alias("raw_text"), lit(4).alias("start_line"), lit(4).alias("end_line"))
    return outer.unionByName(inner), parents, occ, d.select(F.col("doc_id").alias("id"), "content")


def _w(a: int, b: int) -> str:
    return _WINDOW.format(a=str(a), b=str(b))


@register("chunk_builder", f"""WITH {_LS}, x AS (
  SELECT 'ParentSummary' AS kind, doc_id * 2 AS symbol_id, 1::BIGINT AS start_line, 1::BIGINT AS end_line, 'd' || doc_id AS qualified_name, {_w(1, 3)} AS text, NULL::VARCHAR AS parent FROM d
  UNION ALL SELECT 'SymbolDecl', doc_id * 2, 1, 1, 'd' || doc_id, {_w(1, 3)}, NULL FROM d UNION ALL SELECT 'SymbolDecl', doc_id * 2 + 1, 2, 2, 'd' || doc_id || '::in', {_w(0, 4)}, 'd' || doc_id FROM d
  UNION ALL SELECT 'SymbolBody', doc_id * 2, 1, 6, 'd' || doc_id, {_w(-1, 8)}, NULL FROM d UNION ALL SELECT 'SymbolBody', doc_id * 2 + 1, 2, 4, 'd' || doc_id || '::in', {_w(0, 6)}, 'd' || doc_id FROM d
  UNION ALL SELECT 'Occurrence', doc_id * 2 + 1, 4, 4, 'd' || doc_id || '::in', {_w(2, 6)}, NULL FROM d)
  SELECT kind, symbol_id, start_line, end_line, qualified_name, sha256(text) AS text_hash, floor(length(text) / 4.0)::BIGINT AS token_count, parent FROM x""")
def chunk_builder(spark, sf):
    """All four kinds of chunks; the parent is shown by its name."""
    built = chunks.build(*_doc_symbols(spark, sf))
    names = built.where("kind = 'ParentSummary'").select(F.col("id").alias("parent_chunk_id"), F.col("qualified_name").alias("parent"))
    return built.join(names, "parent_chunk_id", "left").select("kind", "symbol_id", "start_line", "end_line", "qualified_name", "text_hash", "token_count", "parent")


@register("snippets", f"""WITH {_LS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_w(2, 6)} WHEN len(ls) <= 80 THEN {_WINDOW.format(a='1', b='len(ls) + 2')}
  ELSE {_WINDOW.format(a='1', b='16')} || CASE WHEN len(ls) - 15 - 16 > 0 THEN '// ... ' || (len(ls) - 15 - 16) || ' lines omitted ...' || chr(10) ELSE '' END || {_WINDOW.format(a='greatest(len(ls) - 15, 17)', b='len(ls)')} END AS text FROM d""")
def snippets(spark, sf):
    """A window, or the whole body, or its head and tail where it has more than 80 lines."""
    d = _document_lines(spark, sf)
    n, even = F.size("ls"), F.col("doc_id") % 2 == 0
    null = F.lit(None).cast("int")
    return d.select("doc_id", chunks.snippet(F.col("ls"), F.when(even, 4).otherwise(1), F.when(even, 4).otherwise(n), F.when(even, null).otherwise(1), F.when(even, null).otherwise(n), False, 2).alias("text"))


@register("signatures", f"WITH {_LS} SELECT doc_id, trim(regexp_extract(array_to_string(list_transform(ls[2:4], lambda x: trim(x)), ' '), '^([^{{;]*)', 1)) AS signature FROM d")
def signatures(spark, sf):
    return _document_lines(spark, sf).select("doc_id", tx.signature(F.col("ls"), F.lit(2)).alias("signature"))


@register("test_line_counts", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*(async\\s+)?def test_')))::BIGINT AS python_tests FROM documents")
def test_line_counts(spark, sf):
    return ca.table(spark, sf, "documents").select("doc_id", tx.python_tests(F.col("text")).alias("python_tests"))


_RULES = "docs/\n*.log\n!keep.log\nsrc0/**/main.rs\n/src1/en\n"


@register("ignore_rules", _with(""" SELECT path, CASE WHEN regexp_matches(path, '^src1/en(?:/.*)?$') THEN true WHEN regexp_matches(path, '^src0/(?:.*/)?main\\.rs(?:/.*)?$') THEN true WHEN regexp_matches(path, '^(?:.*/)?[^/]*\\.log(?:/.*)?$') THEN true WHEN regexp_matches(path, '^(?:.*/)?docs/.*$') THEN true ELSE false END AS ignored FROM c_documents"""))
def ignore_rules(spark, sf):
    return ca.documents(spark, sf).select("path", ignore.ignored(F.col("path"), F.lit(False), ignore.parse(_RULES)).alias("ignored"))


@register("safe_paths", _with(""" SELECT page_id, NOT list_contains(string_split(p, '/'), '..') AND NOT starts_with(p, '/') AS safe FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN path WHEN 1 THEN 'a/../' || path ELSE '/' || path END AS p FROM c_pages)"""))
def safe_paths(spark, sf):
    from graphloom.operators.filters import safe_path

    i = F.col("page_id") % 3
    p = F.when(i == 0, F.col("path")).when(i == 1, F.concat(F.lit("a/../"), "path")).otherwise(F.concat(F.lit("/"), "path"))
    return ca.pages(spark, sf).select("page_id", safe_path(p).alias("safe"))


@register("url_decode", "SELECT page_id, url_decode(regexp_replace(url, 'example', '%65xample%20%C3%A9', 'g')) AS url FROM pages")
def url_decode(spark, sf):
    return ca.table(spark, sf, "pages").select("page_id", tx.percent_decode(F.regexp_replace("url", "example", "%65xample%20%C3%A9")).alias("url"))


@register("coverage_cobertura", """SELECT 'src/f' || c_nationkey || '.py' AS path, count(*) FILTER (hits > 0) AS covered, count(*) AS coverable FROM (SELECT c_nationkey, c_custkey % 40 AS line, arg_max(c_custkey % 3, c_custkey) AS hits FROM customer GROUP BY ALL) GROUP BY c_nationkey""")
def coverage_cobertura(spark, sf):
    c = ca.table(spark, sf, "customer")
    k, f = F.col("c_custkey"), F.col("c_nationkey")
    report = F.concat(F.lit("r"), f.cast("string"))
    lines = c.select(report.alias("report"), (k + 10).alias("line_no"), F.format_string('  <line number="%d" hits="%d"/>', k % 40, k % 3).alias("line"))
    heads = c.select(report.alias("report"), F.lit(0).cast("long").alias("line_no"), F.format_string('<class name="c" filename="src/f%d.py">', f).alias("line")).distinct()
    return coverage.per_file(coverage.cobertura(lines.unionByName(heads)))


@register("with_coverage", _with(""" SELECT path, bytes, coalesce(quality, 0)::BIGINT AS covered, coalesce(toxic, 0)::BIGINT AS coverable FROM c_documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""))
def with_coverage(spark, sf):
    d = ca.documents(spark, sf)
    known = ca.table(spark, sf, "labels").join(d.select("doc_id", "path"), "doc_id").select("path", F.col("quality").cast("long").alias("covered"), F.col("toxic").cast("long").alias("coverable"))
    return stats.with_coverage(d.select("path", "bytes"), known).select("path", "bytes", "covered", "coverable")


@register("slice_paths", "WITH RECURSIVE" + _with(f""", st AS (SELECT DISTINCT from_symbol_id AS a, to_symbol_id AS b FROM c_edges WHERE to_symbol_id IS NOT NULL), w(id, path, depth) AS (SELECT {ca.CUSTOMER + 7}::BIGINT, [{ca.CUSTOMER + 7}::BIGINT], 0
  UNION ALL SELECT b, list_append(path, b), depth + 1 FROM w JOIN st ON id = a WHERE depth < 2 AND NOT list_contains(path, b)) SELECT array_to_string(path, '>') AS path, depth::INTEGER AS depth FROM w""")[4:])
def slice_paths(spark, sf):
    """The slice as a tree of paths; a symbol on its own path is not entered again."""
    return graph.slice_paths(ca.edges(spark, sf), ca.CUSTOMER + 7, 2).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth")


@register("layered_retrieval")
def layered_retrieval(spark, sf):
    """Ranked layers with automatic depth around one supplier."""
    e, s, f = ca.edges(spark, sf), ca.symbols(spark, sf), ca.files(spark, sf)
    return retrieve.graph_pack(e, s, f, "Supplier#000000001", retrieve.Options(mode="neighborhood"))


@register("layered_retrieval_fixed_depth", _with(f""", st AS (SELECT to_symbol_id AS near, from_symbol_id AS far, 'in' AS way FROM c_edges WHERE to_symbol_id IS NOT NULL AND confidence <> 'Unresolved' UNION ALL SELECT from_symbol_id, to_symbol_id, 'out' FROM c_edges WHERE to_symbol_id IS NOT NULL AND confidence <> 'Unresolved'
  ), l1 AS (SELECT far AS id, min(way) AS way FROM st WHERE near = {ca.SUPPLIER + 1} GROUP BY far)
  SELECT s.id, qualified_name, 1 AS distance, CASE way WHEN 'in' THEN 'inbound' ELSE 'outbound' END || ' relationship to ' || (SELECT qualified_name FROM c_symbols WHERE id = {ca.SUPPLIER + 1}) AS reason FROM l1 JOIN c_symbols s USING (id)
  UNION ALL SELECT id, qualified_name, 0, 'root' FROM c_symbols WHERE id = {ca.SUPPLIER + 1}"""))
def layered_retrieval_fixed_depth(spark, sf):
    found = retrieve.layered(ca.edges(spark, sf), ca.symbols(spark, sf), ca.files(spark, sf), "Supplier#000000001", retrieve.Options(mode="neighborhood", depth=1))
    return found.select("id", "qualified_name", "distance", "reason")


_PACKED = """WITH RECURSIVE c AS (SELECT c_custkey // 20 AS query_id, c_custkey AS id, 'q' || c_custkey AS qn, 'f' || c_custkey % 3 AS path, (c_custkey % 9 * 4)::BIGINT AS tokens, c_custkey % 20 = 0 AS is_root FROM customer
  ), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_root DESC, id) AS n FROM c
  ), w AS (SELECT query_id, n, id, is_root OR tokens <= 100 AS taken, greatest(100 - CASE WHEN is_root OR tokens <= 100 THEN tokens ELSE 0 END, 0) AS rest FROM o WHERE n = 1
  UNION ALL SELECT o.query_id, o.n, o.id, o.is_root OR o.tokens <= w.rest, greatest(w.rest - CASE WHEN o.is_root OR o.tokens <= w.rest THEN o.tokens ELSE 0 END, 0) FROM w JOIN o ON w.query_id = o.query_id AND o.n = w.n + 1
  ), p AS (SELECT o.*, w.taken FROM o JOIN w ON o.query_id = w.query_id AND o.n = w.n)"""


def _packed_customers(spark, sf):
    """Candidates that don't all fit: their budget is the least one, 100 tokens."""
    k = F.col("c_custkey")
    c = ca.table(spark, sf, "customer").select(F.floor(k / 20).alias("query_id"), k.alias("id"), F.concat(F.lit("q"), k.cast("string")).alias("qualified_name"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("path"), (k % 9 * 4).alias("tokens"), (k % 20 == 0).alias("is_root"), k.alias("place"), F.lit("s").alias("snippet"))
    return c.join(pack.pack(c, 100).select("query_id", "id", "status"), ["query_id", "id"])


@register("pack_sections", _PACKED + """ SELECT query_id, 0 AS place, 'Summary' AS section, 'Query: what' || chr(10) || 'Mode: neighborhood' || chr(10) || 'Token budget: 100' || chr(10) || 'Estimated tokens: ' || coalesce(sum(tokens) FILTER (taken), 0)::BIGINT || chr(10) || 'Roots: ' || count(*) FILTER (taken AND is_root) AS text FROM p GROUP BY query_id
  UNION ALL SELECT query_id, 1, 'Root', coalesce(string_agg(qn || ' (' || path || ')', chr(10) ORDER BY id) FILTER (taken AND is_root), '') FROM p GROUP BY query_id
  UNION ALL SELECT query_id, 2, 'DirectRelationships', coalesce(array_to_string((list(qn ORDER BY is_root DESC, id) FILTER (taken))[1:10], chr(10)), '') FROM p GROUP BY query_id
  UNION ALL SELECT query_id, 3, 'KeyNeighbors', 'Files to read' || chr(10) || coalesce(array_to_string(list_sort(list_distinct(list(path) FILTER (taken AND NOT is_root))), chr(10)), '') FROM p GROUP BY query_id
  UNION ALL SELECT query_id, 4, 'Snippets', 'Context' || chr(10) || coalesce(string_agg('  --- ' || path || ' ' || qn || chr(10) || 's', chr(10) ORDER BY is_root DESC, id) FILTER (taken), '') FROM p GROUP BY query_id
  UNION ALL SELECT query_id, 5, 'OmittedSummary', 'Omitted: ' || count(*) FILTER (NOT taken) FROM p GROUP BY query_id""")
def pack_sections(spark, sf):
    """All six sections of packs from which some candidates are left out."""
    return pack.sections(_packed_customers(spark, sf), "what", "neighborhood", 100)


@register("slice_tree", "WITH RECURSIVE" + _with(f""", st AS (SELECT from_symbol_id AS a, to_symbol_id AS b, row_number() OVER (PARTITION BY from_symbol_id ORDER BY min(id)) AS n FROM c_edges WHERE from_symbol_id IS NOT NULL AND to_symbol_id IN (SELECT id FROM c_symbols) GROUP BY 1, 2
  ), w(id, path, key, again) AS (SELECT {ca.CUSTOMER + 7}::BIGINT, [{ca.CUSTOMER + 7}::BIGINT], []::BIGINT[], false UNION ALL SELECT b, list_append(path, b), list_append(key, n), list_contains(path, b) FROM w JOIN st ON id = a WHERE len(key) < 2 AND NOT again
  ), r AS (SELECT *, row_number() OVER (ORDER BY key) AS place FROM w QUALIFY place <= 21)
  SELECT place::INTEGER AS place, len(key)::INTEGER AS depth, CASE WHEN len(key) > 0 THEN repeat('  ', len(key)) || '└─ ' ELSE '' END || CASE WHEN place > 20 THEN '... (truncated)' ELSE qualified_name || CASE WHEN again THEN ' (already visited)' ELSE '' END END AS line FROM r JOIN c_symbols s ON s.id = r.id""")[4:])
def slice_tree(spark, sf):
    """The first twenty lines of a slice to depth two, and whether there are more: a report."""
    return graph.slice_tree(ca.edges(spark, sf), ca.symbols(spark, sf), ca.CUSTOMER + 7, 2, 20)


_AROUND = f""", st AS (SELECT id AS e, to_symbol_id AS near, from_symbol_id AS far, from_symbol_id AS f, to_symbol_id AS t, raw_text, confidence FROM c_edges WHERE from_symbol_id IS NOT NULL AND to_symbol_id IS NOT NULL
  UNION ALL SELECT id, from_symbol_id, to_symbol_id, from_symbol_id, to_symbol_id, raw_text, confidence FROM c_edges WHERE from_symbol_id IS NOT NULL AND to_symbol_id IS NOT NULL
  ), l0 AS (SELECT {ca.SUPPLIER + 1}::BIGINT AS id), l1 AS (SELECT far AS id, min(near) AS parent FROM st WHERE near IN (SELECT id FROM l0) AND far NOT IN (SELECT id FROM l0) GROUP BY far
  ), listed AS (SELECT id, 0 AS depth FROM l0 UNION ALL SELECT id, 1 FROM l1), nodes AS (SELECT id, depth, row_number() OVER (ORDER BY depth, id) AS place FROM listed QUALIFY place <= 50)"""


@register("graph_context_nodes", _with(_AROUND + " SELECT id, depth, place::INTEGER AS place FROM nodes"))
def graph_context_nodes(spark, sf):
    """The first fifty of a symbol's neighbourhood: max_nodes is the feature."""
    return graph.graph_context(ca.edges(spark, sf), ca.symbols(spark, sf), ca.SUPPLIER + 1, "neighborhood", 1, 50)["nodes"]


@register("graph_context_edges", _with(_AROUND + " SELECT f AS from_id, t AS to_id, raw_text AS label, min(confidence) AS confidence FROM st WHERE near IN (SELECT id FROM nodes WHERE depth < 1) GROUP BY ALL"))
def graph_context_edges(spark, sf):
    return graph.graph_context(ca.edges(spark, sf), ca.symbols(spark, sf), ca.SUPPLIER + 1, "neighborhood", 1, 50)["edges"]


@register("unresolved_edges", _with(" SELECT count(*) FILTER (confidence = 'Unresolved' OR to_symbol_id IS NULL) AS unresolved FROM c_edges WHERE kind IN ('Call', 'Reference')"))
def unresolved_edges(spark, sf):
    return graph.unresolved_edges(ca.edges(spark, sf), ["Call", "Reference"])


@register("lexical_upsert", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'alpha beta alpha' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0), t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' AND octet_length(encode(x)) <= 40) AS t FROM d
  ), l AS (SELECT doc_id, t, len(t) AS n FROM t), a AS (SELECT count(*) AS docs, avg(n) AS m FROM l), f AS (SELECT doc_id, n, w, len(list_filter(t, lambda x: x = w)) AS tf FROM l, (SELECT unnest(['alpha', 'the']) AS w)), df AS (SELECT w, count(*) FILTER (tf > 0) AS df FROM f GROUP BY w)
  SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / m))), 6) AS score FROM f JOIN df USING (w), a WHERE tf > 0 GROUP BY doc_id""")
def lexical_upsert(spark, sf):
    """A lexical index whose documents were replaced and removed finds what one built anew would."""
    import uuid

    from graphloom.durable import shared_dir
    from graphloom.operators import lexical

    d = ca.table(spark, sf, "documents").select("doc_id", "text")
    root = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
    lexical.build(d, "doc_id", ["text"], root)
    lexical.upsert(d.where("doc_id % 5 = 0").withColumn("text", F.lit("alpha beta alpha")), "doc_id", ["text"], root)
    lexical.remove(d.where("doc_id % 7 = 0"), "doc_id", ["text"], root)
    return lexical.search(spark, root, "the Alpha", None, "doc_id")


@register("pack_as_json", """SELECT c_custkey // 20 AS query_id, '{"query_id":' || c_custkey // 20 || ',"nodes":' || '[' || string_agg('{"id":' || c_custkey || ',"name":"' || c_name || '"}', ',' ORDER BY c_custkey) || ']}' AS json FROM customer GROUP BY c_custkey // 20""")
def pack_as_json(spark, sf):
    """A pack as one JSON document per query; a pack's nodes are bounded by its options."""
    c = ca.table(spark, sf, "customer")
    return pack.as_json(c.select(F.floor(F.col("c_custkey") / 20).alias("query_id"), F.col("c_custkey").alias("place"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), ["id", "name"])


@register("pack_as_yaml", """SELECT c_custkey // 20 AS query_id, 'query_id: "' || c_custkey // 20 || '"' || chr(10) || 'nodes:' || chr(10) || string_agg('- id: "' || c_custkey || '"' || chr(10) || '  name: "' || c_name || '"' || chr(10), '' ORDER BY c_custkey) AS yaml FROM customer GROUP BY c_custkey // 20""")
def pack_as_yaml(spark, sf):
    c = ca.table(spark, sf, "customer")
    return pack.as_yaml(c.select(F.floor(F.col("c_custkey") / 20).alias("query_id"), F.col("c_custkey").alias("place"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), ["id", "name"])


@register("effective_budgets", "SELECT DISTINCT p_size AS reserved, greatest(least(12000, 12500 - 50 * p_size - 1000), 0)::INTEGER AS budget FROM part")
def effective_budgets(spark, sf):
    s = F.col("p_size")
    return ca.table(spark, sf, "part").select(s.alias("reserved"), pack.effective_budget(F.lit(12_000), F.lit(12_500), 50 * s, F.lit(1000)).cast("int").alias("budget")).distinct()


@register("root_ranking_ties", _with(" SELECT id, row_number() OVER (ORDER BY octet_length(encode(qualified_name)), id)::INTEGER AS place FROM c_symbols QUALIFY place <= 20"))
def root_ranking_ties(spark, sf):
    """Equal scores: the shorter qualified name in bytes, then the id."""
    s = ca.symbols(spark, sf).withColumn("score", F.lit(1.0)).orderBy(*rank.order()).limit(20)
    return s.select("id", F.row_number().over(W.orderBy(*rank.order())).cast("int").alias("place"))


@register("grouped_tests", _with(" SELECT file_id, count(*) FILTER (kind = 'Test') AS tests, count(*) FILTER (kind <> 'Test') AS others FROM c_symbols GROUP BY file_id"))
def grouped_tests(spark, sf):
    return graph.tests_by_file(ca.symbols(spark, sf))


@register("call_lines", _with(""" SELECT e.id, a.qualified_name || ' -> ' || coalesce(b.qualified_name, '?' || raw_text) || ' [' || confidence || ']' AS line FROM c_edges e JOIN c_symbols a ON e.from_symbol_id = a.id LEFT JOIN c_symbols b ON e.to_symbol_id = b.id WHERE e.kind = 'Call'"""))
def call_lines(spark, sf):
    from graphloom.operators.export import call_lines as lines

    return lines(ca.edges(spark, sf), ca.symbols(spark, sf))


@register("render_markdown", _with(""" SELECT path, '## ' || path || chr(10) || chr(10) || f || CASE WHEN regexp_matches(split_part(path, '/', -1), '^.+\\.[^.]*$') THEN lower(regexp_extract(path, '\\.([^./]*)$', 1)) ELSE '' END || chr(10) || content || CASE WHEN ends_with(content, chr(10)) THEN '' ELSE chr(10) END || f || chr(10) AS text
  FROM (SELECT path, content, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(content, '`+'), lambda x: length(x))), 0) + 1)) AS f FROM c_pages)"""))
def render_markdown(spark, sf):
    from graphloom.operators.export import markdown

    return markdown(ca.pages(spark, sf))


@register("python_symbols")
def python_symbols(spark, sf):
    """The parser over documents as Python sources made of them."""
    from graphloom.sources.parse import parse_files

    d = ca.table(spark, sf, "documents")
    name = F.concat(F.lit("f_"), F.col("doc_id").cast("string"))
    code = F.concat(F.lit("class C:\n    def "), name, F.lit("(self, x):\n        return g(x)\n\ndef g(a):\n    return len("), F.to_json(F.array("text")), F.lit(")\n"))
    return parse_files(d.select(F.concat(name, F.lit(".py")).alias("rel_path"), code.alias("content"))).groupBy("row", "kind").agg(F.count(F.lit(1)).alias("n"))


@register("reached_by_direction", _with(f", u AS (SELECT to_symbol_id AS id FROM c_edges WHERE from_symbol_id = {ca.PART + 5} AND to_symbol_id IS NOT NULL), v AS (SELECT from_symbol_id AS id FROM c_edges WHERE to_symbol_id = {ca.PART + 5}) SELECT id FROM u UNION SELECT id FROM v"))
def reached_by_direction(spark, sf):
    return graph.neighbours(ca.edges(spark, sf), ca.PART + 5)




@register("usage_windows", "SELECT date_trunc('hour', ts) AS start, event_type AS tool, count(*) AS calls, count(*) FILTER (value > 50) AS errors FROM events GROUP BY ALL")
def usage_windows(spark, sf):
    """Usage by event time and tool; the same plan serves a stream."""
    from graphloom.streaming.incremental import usage_windows as windows

    e = ca.table(spark, sf, "events").select("ts", F.col("event_type").alias("tool"), (F.col("value") > 50).alias("failed"))
    return windows(e).select(F.col("window.start").alias("start"), "tool", "calls", "errors")


_TIERS = """, f AS (SELECT CASE WHEN qualified_name = 'red ring' THEN 0 WHEN name = 'red ring' THEN 1 WHEN contains(lower(qualified_name), 'red ring') THEN 2 WHEN contains(lower(name), 'red ring') THEN 3 END AS tier, id, qualified_name FROM c_symbols)"""


@register("search_symbols_limited", _with(_TIERS + " SELECT tier, id, qualified_name FROM f WHERE tier IS NOT NULL ORDER BY tier, id LIMIT 10"))
def search_symbols_limited(spark, sf):
    """The first ten by tier: a top-k report."""
    found = graph.find_symbols(ca.symbols(spark, sf), ca.files(spark, sf), "red ring")
    return found.orderBy("tier", "id").limit(10).select("tier", "id", "qualified_name")


@register("recap_top_three", _with(_CANDIDATES + " SELECT ['Start with', 'Then read', 'Then inspect'][row_number() OVER (ORDER BY round(graph_score, 6) DESC, octet_length(encode(qualified_name)), id)] AS label, id FROM g ORDER BY round(graph_score, 6) DESC, octet_length(encode(qualified_name)), id LIMIT 3"))
def recap_top_three(spark, sf):
    return pack.recap(rank.rank(_candidates(spark, sf), _root_paths(spark), "x", "graph"), rank.order())


@register("embeddable_chunks", _with(" SELECT kind, count(*) * 2 AS n FROM (SELECT 'SymbolBody' AS kind FROM documents UNION ALL SELECT 'SymbolDecl' FROM documents) GROUP BY kind UNION ALL SELECT 'ParentSummary', count(*) FROM documents"))
def embeddable_chunks(spark, sf):
    return chunks.embeddable(chunks.build(*_doc_symbols(spark, sf))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
