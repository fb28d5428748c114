"""The benchmark tables as a code graph: files, symbols, edges, occurrences, chunks.

Nations are Rust files and modules, suppliers their classes, customers their methods; brands
are Python files, parts their functions. Customers call parts, parts call suppliers (from
lineitem and orders); containers hold what starts within their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SUPPLIER, CUSTOMER, PART = 1_000_000_000, 2_000_000_000, 3_000_000_000
EDGE = 100_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, p = (table(spark, sf_dir, t) for t in ("nation", "region", "part"))
    nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("src/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit(".rs")).alias("rel_path"), F.lit("rust").alias("language"))
    brand = F.substring_index("p_brand", "#", -1)
    brands = p.select((F.lit(100) + brand.cast("long")).alias("id"), F.concat(F.lit("lib/brands/brand_"), brand, F.lit(".py")).alias("rel_path"), F.lit("python").alias("language")).distinct()
    return nations.unionByName(brands)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, s, c, p = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "customer", "part"))
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), F.concat_ws("::", "r_name", "n_name").alias("q"), "n_name")

    def make(frame: DataFrame, id_, file_id, name, qn, kind, start, length, complexity, nesting) -> DataFrame:
        return frame.select(
            id_.cast("long").alias("id"), file_id.cast("long").alias("file_id"), name.alias("name"), qn.alias("qualified_name"), kind.alias("kind"), start.cast("long").alias("start_line"), (start + length - 1).cast("long").alias("end_line"),
            length.cast("long").alias("lines_of_code"), complexity.cast("long").alias("complexity_proxy"), nesting.cast("long").alias("nesting_depth"),
        )

    col, lit = F.col, F.lit
    parts = [
        make(nr, col("k"), col("k"), col("n_name"), col("q"), lit("Module"), lit(1), lit(1_000_000_000), lit(1), lit(0)),
        make(s.join(nr, col("s_nationkey") == col("k")), col("s_suppkey") + SUPPLIER, col("k"), col("s_name"), F.concat_ws("::", "q", "s_name"), lit("Class"), col("s_suppkey") * 100 + 2, lit(80), lit(1), lit(0)),
        make(c.join(nr, col("c_nationkey") == col("k")), col("c_custkey") + CUSTOMER, col("k"), col("c_name"), F.concat_ws("::", "q", "c_name"), lit("Method"), col("c_custkey") * 7 + 5, col("c_custkey") % 9 + 1, col("c_custkey") % 6 + 1, col("c_custkey") % 4),
        make(p, col("p_partkey") + PART, F.substring_index("p_brand", "#", -1).cast("long") + 100, col("p_name"), F.concat_ws("::", "p_brand", "p_name"), F.when(col("p_size") % 7 == 0, "Test").otherwise("Function"), col("p_partkey") * 10, lit(9), col("p_size") % 5 + 1, col("p_size") % 3),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    sold = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.min("l_returnflag").alias("flag"))
    confidence = F.when(F.col("l_partkey") % 17 == 0, "Unresolved").when(F.col("flag") == "A", "LspExact").when(F.col("flag") == "N", "Syntax").otherwise("Heuristic")
    calls = sold.select(
        (F.col("o_custkey") * EDGE + F.col("l_partkey")).alias("id"), F.lit("Call").alias("kind"), (F.col("o_custkey") + CUSTOMER).alias("from_symbol_id"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("l_partkey") + PART).alias("to_symbol_id"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("raw_text"), confidence.alias("confidence"),
    )
    made = li.select("l_partkey", "l_suppkey").distinct()
    uses = made.select(
        (-(F.col("l_partkey") * EDGE + F.col("l_suppkey")) - 1).alias("id"), F.when(F.col("l_suppkey") % 3 == 0, "Reference").otherwise("Call").alias("kind"), (F.col("l_partkey") + PART).alias("from_symbol_id"),
        (F.col("l_suppkey") + SUPPLIER).alias("to_symbol_id"), F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("raw_text"), F.lit("Heuristic").alias("confidence"),
    )
    return calls.unionByName(uses)


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    raw = (
        F.when(F.col("l_linenumber") % 3 == 0, F.format_string("self.Customer#%09d", F.col("l_partkey")))
        .when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("parts::"), F.when(F.col("l_suppkey") % 2 == 0, "red ring").otherwise("unknown")))
        .otherwise(F.concat(F.lit("helper_"), F.col("l_suppkey").cast("string")))
    )
    own = j.groupBy("o_custkey", "c_nationkey", raw.alias("raw_text")).agg(F.count(F.lit(1)).alias("times"))
    return own.select(F.xxhash64("o_custkey", "raw_text").alias("id"), F.col("c_nationkey").cast("long").alias("file_id"), (F.col("o_custkey") + CUSTOMER).alias("enclosing_symbol_id"), F.lit("Call").alias("kind"), "raw_text", "times")


def parents(symbols_: DataFrame, contains: DataFrame) -> DataFrame:
    """Symbols with the parent that containment gives them."""
    return symbols_.join(contains.select(F.col("child_id").alias("id"), F.col("parent_id").alias("parent_symbol_id")), "id", "left")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: (page_id, path, bytes, content); the url's host and path are directories."""
    p = table(spark, sf_dir, "pages")
    rest = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    path = F.regexp_replace(rest, r"/$", "/index.html")
    return p.select("page_id", path.alias("path"), F.octet_length("html").cast("long").alias("bytes"), F.col("html").alias("content"))


#: Names as files of many kinds, so that every rule of the filters meets some.
NAMES = "main.rs lib.py README.md notes.txt Cargo.lock debug.log logo.png Makefile data.csv page.html .DS_Store style.css".split()
DIRS = "src docs target node_modules .git assets __pycache__ tests".split()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: (doc_id, path, bytes, content) under source, language and a directory by id."""
    d = table(spark, sf_dir, "documents")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("/"), pick(NAMES, F.col("doc_id")))
    path = F.concat_ws("/", F.col("source"), F.col("lang"), pick(DIRS, F.floor(F.col("doc_id") / 5)), name)
    return d.select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.col("text").alias("content"))


# The same in SQL, as common table expressions.
SQL = f"""
c_files AS (
  SELECT n_nationkey::BIGINT AS id, 'src/' || lower(r_name) || '/' || lower(n_name) || '.rs' AS rel_path, 'rust' AS language FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT 100 + split_part(p_brand, '#', 2)::BIGINT, 'lib/brands/brand_' || split_part(p_brand, '#', 2) || '.py', 'python' FROM part
), c_nr AS (SELECT n_nationkey AS k, r_name || '::' || n_name AS q, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
), c_symbols AS (
  SELECT k::BIGINT AS id, k::BIGINT AS file_id, n_name AS name, q AS qualified_name, 'Module' AS kind, 1::BIGINT AS start_line, 1000000000::BIGINT AS end_line, 1000000000::BIGINT AS lines_of_code, 1::BIGINT AS complexity_proxy, 0::BIGINT AS nesting_depth FROM c_nr
  UNION ALL SELECT s_suppkey + {SUPPLIER}, k, s_name, q || '::' || s_name, 'Class', s_suppkey * 100 + 2, s_suppkey * 100 + 81, 80, 1, 0 FROM supplier JOIN c_nr ON s_nationkey = k
  UNION ALL SELECT c_custkey + {CUSTOMER}, k, c_name, q || '::' || c_name, 'Method', c_custkey * 7 + 5, c_custkey * 7 + 5 + c_custkey % 9, c_custkey % 9 + 1, c_custkey % 6 + 1, c_custkey % 4 FROM customer JOIN c_nr ON c_nationkey = k
  UNION ALL SELECT p_partkey + {PART}, split_part(p_brand, '#', 2)::BIGINT + 100, p_name, p_brand || '::' || p_name, CASE WHEN p_size % 7 = 0 THEN 'Test' ELSE 'Function' END, p_partkey * 10, p_partkey * 10 + 8, 9, p_size % 5 + 1, p_size % 3 FROM part
), c_edges AS (
  SELECT o_custkey * {EDGE} + l_partkey AS id, 'Call' AS kind, o_custkey + {CUSTOMER} AS from_symbol_id, CASE WHEN l_partkey % 17 <> 0 THEN l_partkey + {PART} END AS to_symbol_id, 'part_' || l_partkey AS raw_text,
    CASE WHEN l_partkey % 17 = 0 THEN 'Unresolved' WHEN min(l_returnflag) = 'A' THEN 'LspExact' WHEN min(l_returnflag) = 'N' THEN 'Syntax' ELSE 'Heuristic' END AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
  UNION ALL SELECT DISTINCT -(l_partkey * {EDGE} + l_suppkey) - 1, CASE WHEN l_suppkey % 3 = 0 THEN 'Reference' ELSE 'Call' END, l_partkey + {PART}, l_suppkey + {SUPPLIER}, 'supplier_' || l_suppkey, 'Heuristic' FROM lineitem
), c_occurrences AS (
  SELECT c_nationkey::BIGINT AS file_id, o_custkey + {CUSTOMER} AS enclosing_symbol_id, 'Call' AS kind,
    CASE l_linenumber % 3 WHEN 0 THEN printf('self.Customer#%09d', l_partkey) WHEN 1 THEN 'parts::' || CASE WHEN l_suppkey % 2 = 0 THEN 'red ring' ELSE 'unknown' END ELSE 'helper_' || l_suppkey END AS raw_text, count(*) AS times
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), c_contains AS (
  SELECT c.id AS child_id, arg_max(p.id, (p.start_line, -p.end_line, p.id)) AS parent_id FROM c_symbols c JOIN c_symbols p ON c.file_id = p.file_id AND p.kind IN ('Class', 'Struct', 'Module', 'Trait', 'Impl')
    AND p.start_line <= c.start_line AND p.end_line >= c.start_line AND (p.start_line, -p.end_line, p.id) < (c.start_line, -c.end_line, c.id) GROUP BY c.id
), c_pages AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', '/index.html') AS path, octet_length(encode(html))::BIGINT AS bytes, html AS content FROM pages
), c_documents AS (
  SELECT doc_id, source || '/' || lang || '/' || ({DIRS!r})[(doc_id // 5) % {len(DIRS)} + 1] || '/' || doc_id || '/' || ({NAMES!r})[doc_id % {len(NAMES)} + 1] AS path, octet_length(encode(text))::BIGINT AS bytes, text AS content FROM documents
)"""
