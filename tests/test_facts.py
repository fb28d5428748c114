"""Facts on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import chunks, export, filters, graph, maintain, pack, rank, search, stats
from graphloom.sources import config, coverage, ignore, parse


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,tokens,lines", [("", 0, 0), ("hello", 2, 1), ("你好", 1, 1), ("abcde", 2, 1), ("one\ntwo\n", 2, 2), ("a\r\nb\r\nc\r\n", 3, 3), ("a\n\n", 1, 2)])
def test_tokens_and_lines(spark, text, tokens, lines):
    assert one(spark, tx.estimate_tokens(F.lit(text))) == tokens
    assert one(spark, tx.count_lines(F.lit(text))) == lines


@pytest.mark.parametrize("text,words", [("auth::AuthService", ["auth", "auth", "service", "auth::authservice"]), ("HTTPServer", ["http", "server", "httpserver"]), ("", [""]), ("run", ["run"]), ("a.b/c-d_e", ["a", "b", "c", "d", "e", "a.b/c-d_e"])])
def test_tokenize(spark, text, words):
    assert one(spark, tx.tokenize(F.lit(text))) == words


def test_subsequence(spark):
    assert one(spark, tx.is_subsequence(F.lit("a.c"), F.lit("xa.bc")))
    assert not one(spark, tx.is_subsequence(F.lit("a.c"), F.lit("abc")))
    assert one(spark, tx.is_subsequence(F.lit(""), F.lit("abc")))


@pytest.mark.parametrize("name,ext", [("a.rs", "rs"), (".gitignore", None), ("a.tar.gz", "gz"), ("Makefile", None)])
def test_extension(spark, name, ext):
    assert one(spark, tx.extension(F.lit(name))) == ext


def test_hidden_reasons(spark):
    rows = [("target", True, "build artifacts"), ("target", False, "non-code file"), ("Cargo.lock", False, "lockfile"), ("a.LOG", False, "non-code file"), ("a.log", False, "temporary file"), ("main.rs", False, None), ("README", False, None)]
    df = spark.createDataFrame([(n, d) for n, d, _ in rows], "name string, is_dir boolean")
    got = [r[0] for r in df.select(filters.hidden_reason(F.col("name"), F.col("is_dir"), "code")).collect()]
    assert got == [r for _, _, r in rows]


def test_scan_prunes_below_hidden_directories(spark):
    files = spark.createDataFrame([("src/a.rs", 1), ("target/x/b.rs", 1), ("node_modules/c.js", 1)], "path string, bytes long")
    got = {(r.path, r.reason) for r in filters.scan(files).collect()}
    assert got == {("src", None), ("src/a.rs", None), ("target", "build artifacts"), ("node_modules", "dependencies")}


def test_rollup_root_is_sum(spark):
    df = spark.createDataFrame([("r/a/x", 1), ("r/a/y", 2), ("r/b/z", 4), ("r/w", 8)], "path string, bytes long")
    got = {r.dir: (r.files, r.dirs, r.bytes) for r in stats.tree_rollup(df, ["bytes"]).collect()}
    assert got == {"r": (4, 3, 15), "r/a": (2, 1, 3), "r/b": (1, 1, 4)}


def edges_of(spark, pairs, kinds=None):
    return spark.createDataFrame([(i, "Call", a, b, f"c{i}", "Syntax") for i, (a, b) in enumerate(pairs)], "id long, kind string, from_symbol_id long, to_symbol_id long, raw_text string, confidence string")


def symbols_of(spark, n, tests=()):
    return spark.createDataFrame([(i, 0, f"s{i}", f"m::s{i}", "Test" if i in tests else "Function", 10 * i, 10 * i + 5) for i in range(n)], "id long, file_id long, name string, qualified_name string, kind string, start_line long, end_line long")


def ids(df):
    return {r.id: r.depth for r in df.collect()}


def test_slices(spark):
    root = lambda i: spark.createDataFrame([(i,)], "id long")
    chain, three = edges_of(spark, [(0, 1), (1, 2)]), symbols_of(spark, 3)
    assert ids(graph.slice_from(chain, three, root(0))) == {0: 0, 1: 1, 2: 2}
    assert ids(graph.slice_from(chain, three, root(0), max_depth=1)) == {0: 0, 1: 1}
    assert ids(graph.slice_from(chain, three, root(2), reverse=True)) == {2: 0, 1: 1, 0: 2}
    assert ids(graph.slice_from(edges_of(spark, [(0, 1), (1, 0)]), three, root(0))) == {0: 0, 1: 1}
    assert ids(graph.slice_from(edges_of(spark, [(0, 1), (1, 2)]), symbols_of(spark, 3, {1}), root(0))) == {0: 0}


def test_name_resolution(spark):
    s = spark.createDataFrame([(1, 1, "run", "Function"), (2, 2, "load", "Function"), (3, 2, "dup", "Function"), (4, 1, "dup", "Function"), (5, 1, "m", "Method")], "id long, file_id long, name string, kind string")
    o = spark.createDataFrame([(i, 1, 9, "Call", t) for i, t in enumerate(["run", "x::load", "dup", "self.m", "self.run", "gone"])], "id long, file_id long, enclosing_symbol_id long, kind string, raw_text string")
    got = {r.raw_text: (r.to_symbol_id, r.confidence) for r in graph.resolve_names(o, s).collect()}
    assert got == {"run": (1, "Syntax"), "x::load": (2, "Heuristic"), "dup": (None, "Unresolved"), "self.m": (5, "Syntax"), "self.run": (None, "Unresolved"), "gone": (None, "Unresolved")}


def test_contains_takes_the_last_open_container(spark):
    s = spark.createDataFrame([(1, 0, "Class", 1, 50), (2, 0, "Class", 10, 20), (3, 0, "Method", 12, 13), (4, 0, "Method", 30, 31), (5, 0, "Function", 60, 61), (6, 0, "Method", 1, 9)], "id long, file_id long, kind string, start_line long, end_line long")
    assert {r.child_id: r.parent_id for r in graph.contains_edges(s).collect()} == {2: 1, 3: 2, 4: 1, 6: 1}


def test_lcom(spark):
    s = spark.createDataFrame([(1, "Class", None), (2, "Method", 1), (3, "Method", 1), (4, "Method", 1), (5, "Struct", None)], "id long, kind string, parent_symbol_id long")
    o = spark.createDataFrame([(2, "a"), (3, "a"), (3, "b")], "enclosing_symbol_id long, raw_text string")
    assert {r.id: r.cohesion for r in graph.lcom(s, o).collect()} == {1: 1.0, 5: 0.0}


def test_graph_score(spark):
    rows = [(0, "other/x.rs", None, 10), (1, "other/x.rs", None, 6), (2, "other/x.rs", None, 3), (3, "other/x.rs", None, 1), (4, "other/x.rs", None, 0), (1, "a/r.rs", None, 8), (1, "a/z.rs", None, 7), (1, "a/r.rs", "LspExact", 10), (1, "a/r.rs", "Syntax", 9.2), (1, "a/r.rs", "Heuristic", 8.5), (1, "a/r.rs", "Unresolved", 7)]
    df = spark.createDataFrame([(i, "n", "q", p, d, c) for i, (d, p, c, _) in enumerate(rows)], "id long, name string, qualified_name string, path string, distance int, confidence string")
    root = spark.createDataFrame([("a/r.rs",)], "path string")
    got = [r[0] for r in df.orderBy("id").select(rank.graph_score(root)).collect()]
    assert got == pytest.approx([r[3] for r in rows])


def test_lexical_score_of_an_empty_query_is_positive(spark):
    df = spark.createDataFrame([(1, "load", "m::load", "a/b.rs")], "id long, name string, qualified_name string, path string")
    assert rank.lexical(df, "").first()["lexical_score"] > 0


def test_rrf(spark):
    hits = spark.createDataFrame([("a", 1, 10, 0.9), ("a", 2, None, 0.8), ("b", 2, 20, 0.95), ("b", 3, 30, 0.7)], "list string, chunk_id long, symbol_id long, score double")
    got = [(r.chunk_id, r.symbol_id, r.score) for r in search.rrf(hits, 60, 10).collect()]
    assert got == [(2, 20, pytest.approx(1 / 62 + 1 / 61, abs=1e-6)), (1, 10, pytest.approx(1 / 61, abs=1e-6)), (3, 30, pytest.approx(1 / 62, abs=1e-6))]
    assert search.rrf(hits.where("list = 'a' and chunk_id = 1"), 0).first()["score"] == 0.5


def test_bm25_of_a_blank_query_is_empty(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert search.bm25(df, "id", ["text"], " :: ").count() == 0
    assert search.bm25(df, "id", ["text"], "b c").count() == 1


def test_knn_skips_zero_and_other_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 1.0])], "id long, e array<double>")
    assert [(r.id, r.score) for r in search.knn(df, "id", "e", [2.0, 0.0]).collect()] == [(1, 1.0), (4, 0.707107)]


def test_pack_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, i, f"f{i}", t, False, i) for i, t in enumerate([60, 50, 30])], "query_id long, id long, path string, tokens long, is_root boolean, place int")
    assert [r.status for r in pack.pack(df, 100).orderBy("id").collect()] == ["included", "Truncated: token budget exceeded", "included"]
    roots = spark.createDataFrame([(1, 0, "f", 500, True, 0), (1, 1, "g", 1, False, 1)], "query_id long, id long, path string, tokens long, is_root boolean, place int")
    assert [(r.status, r.left) for r in pack.pack(roots, 50).orderBy("id").collect()] == [("included", 0), ("Truncated: token budget exceeded", 0)]
    assert pack.effective_budget(12_000, 8_000, 1_000, 1_000) == 6_000


def test_windows(spark):
    lines = F.array(*[F.lit(str(i)) for i in range(1, 6)])
    assert one(spark, tx.line_window(lines, F.lit(2), F.lit(3), 1)) == "1\n2\n3\n4\n"
    assert one(spark, tx.line_window(lines, F.lit(7), F.lit(9))) == ""
    assert one(spark, chunks.read_lines(lines, F.lit(9), F.lit(None), 3)) == "5"


def test_chunks_of_a_nested_class(spark):
    text = "\n".join(f"line {i}" for i in range(1, 9))
    s = spark.createDataFrame([(1, 0, "A", 1, 8, None, None), (2, 0, "A::f", 2, 4, 3, 4)], "id long, file_id long, qualified_name string, start_line long, end_line long, body_start_line long, body_end_line long")
    p = spark.createDataFrame([(1, 2)], "parent_id long, child_id long")
    o = spark.createDataFrame([(7, 0, 2, "g", 4, 4)], "id long, file_id long, enclosing_symbol_id long, raw_text string, start_line long, end_line long")
    f = spark.createDataFrame([(0, text)], "id long, content string")
    got = chunks.build(s, p, o, f, 0).collect()
    kinds = sorted((r.kind, r.symbol_id) for r in got)
    assert kinds == [("Occurrence", 2), ("ParentSummary", 1), ("SymbolBody", 1), ("SymbolBody", 2), ("SymbolDecl", 1), ("SymbolDecl", 2)]
    summary = next(r for r in got if r.kind == "ParentSummary")
    assert summary.parent_chunk_id is None
    assert all(r.parent_chunk_id == summary.id for r in got if r.symbol_id == 2 and r.kind != "Occurrence")


def test_diff_sequence(spark):
    schema = "path string, mtime_ms long, size_bytes long, content_hash string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    count = lambda d, i: {r.status: r.n for r in maintain.diff(d, i.withColumn("parse_status", F.lit("Success"))).groupBy("status").agg(F.count("*").alias("n")).collect()}
    three = [("a", 1, 1, "x"), ("b", 1, 1, "y"), ("c", 1, 1, "z")]
    assert count(make(three), make([])) == {"added": 3}
    assert count(make(three), make(three)) == {"unchanged": 3}
    assert count(make([("a", 2, 1, "x"), *three[1:]]), make(three)) == {"modified": 1, "unchanged": 2}
    assert count(make(three[:2]), make(three)) == {"deleted": 1, "unchanged": 2}


def test_state(spark):
    meta = spark.createDataFrame([("schema_version", "7")], "key string, value string")
    assert maintain.rebuild_reason(meta, {"schema_version": "8"}).first()["reason"] == "SchemaVersionChanged"
    assert maintain.rebuild_reason(meta.limit(0), {"schema_version": "8"}).first()["reason"] == "MissingMetadata"


def test_coverage(spark):
    lines = ["SF:a.rs", "DA:1,0", "DA:2,3", "DA:1,2", "end_of_record", "DA:9,9", "SF:b.rs", "DA:1,0", "DA:x,1", "end_of_record"]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "report string, line_no long, line string")
    assert {r.path: (r.covered, r.coverable) for r in coverage.per_file(coverage.lcov(df)).collect()} == {"a.rs": (2, 2), "b.rs": (0, 1)}
    xml = ['<class name="a" filename="a.py">', '<line number="1" hits="1"/>', '<line number="2" hits="0"/>', "</class>", '<line number="3" hits="1"/>']
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(xml)], "report string, line_no long, line string")
    assert {r.path: (r.covered, r.coverable) for r in coverage.per_file(coverage.cobertura(df)).collect()} == {"a.py": (1, 2)}


def test_ignore(spark):
    rules = ignore.parse("*.log\n/build/\n!keep.log\n\n#[keep]\nbuild/important.txt\n") + ignore.parse("secret*", "sub")
    df = spark.createDataFrame([(p, False) for p in ("a.log", "x/keep.log", "build/o.txt", "sub/secret1", "secret1", "xbuild/a", "build/important.txt")], "p string, d boolean")
    got = {r.p: r.x for r in df.select("p", ignore.ignored(F.col("p"), F.col("d"), rules).alias("x")).collect()}
    assert got == {"a.log": True, "x/keep.log": False, "build/o.txt": True, "sub/secret1": True, "secret1": False, "xbuild/a": False, "build/important.txt": False}


def test_config():
    s = config.parse('token_budget = 500 # why\nbm25_top_k=7\nrerank = "yes"\nnonsense = 1\nmax_files = x\n')
    assert (s.token_budget, s.lexical_top_k, s.enable_rerank, s.max_files) == (500, 7, True, None)
    assert config.merge(s, config.Settings(token_budget=9)).token_budget == 9


PYTHON = "import os\nfrom a import b\n\nclass A:\n    def f(self, x):\n        if x:\n            return g(x)\n\n    def h(self):\n        self.f(1)\n\ndef g(a):\n    return os.path.join(a)\n"
RUST = "use x;\n#[test]\nfn check() { run(1); }\nimpl<T> Server<T> for Host {\n  fn go(&self, a: u8) -> u8 {\n    if a > 1 { self.stop() }\n    // fn no() {}\n    \"fn neither() {\"\n  }\n}\nstruct P;\n"


def test_python_parser():
    rows = parse.parse_python("d/m.py", PYTHON)
    names = [(r[2], r[4]) for r in rows if r[1] == "symbol"]
    assert names == [("Class", "m::A"), ("Method", "m::A::f"), ("Method", "m::A::h"), ("Function", "m::g")]
    assert [r[14] for r in rows if r[2] == "Import"] == ["import os", "from a import b"]
    assert [r[14] for r in rows if r[2] == "Call"] == ["g", "self.f", "os.path.join"]
    assert parse.parse_python("m.py", "def (:") == []


def test_rust_parser():
    rows = parse.parse_rust("d/m.rs", RUST)
    assert [(r[2], r[4], r[5], r[7]) for r in rows if r[1] == "symbol"] == [("Test", "m::check", 3, 3), ("Impl", "Host as Server", 4, 10), ("Method", "Host as Server::go", 5, 9), ("Struct", "m::P", 11, 11)]
    assert [(r[14], r[15]) for r in rows if r[1] == "occurrence"] == [("run", "m::check"), ("self.stop", "Host as Server::go")]


def test_graphml_escapes(spark):
    s = spark.createDataFrame([(1, "a<b>&c")], "id long, qualified_name string")
    lines = [r.line for r in export.graphml(s, edges_of(spark, [(1, 1)])).orderBy("section", "id").collect()]
    assert "a&lt;b&gt;&amp;c" in lines[1] and lines[2] == '<edge source="n1" target="n1"/>'


def test_markdown_fence(spark):
    df = spark.createDataFrame([("a.rs", "x ```` y")], "path string, content string")
    assert "`````rust" in export.markdown(df).first()["text"]
