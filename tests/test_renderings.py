"""Trees, highlights, settings, report discovery, parsers' recovery, model hooks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import export, models, pack, stats
from graphloom.sources import config, coverage, parse


def test_coloured_tree(spark):
    rows = [("src", "src", True, None, None), ("src/a.rs", "a.rs", False, 2048, 7), ("z.md", "z.md", False, 3, None)]
    df = spark.createDataFrame(rows, "path string, name string, is_dir boolean, bytes long, tokens long")
    got = {r.path: r.line for r in export.coloured_tree(df, 20).collect()}
    assert got["src"] == "├── \x1b[1;34msrc/\x1b[0m" and got["z.md"].startswith("└── \x1b[33mz.md\x1b[0m")
    assert got["src/a.rs"].startswith("│   └── \x1b[32ma.rs\x1b[0m") and got["src/a.rs"].endswith(", ~7 tokens")


def test_context_dump(spark):
    entries = spark.createDataFrame([("a", "a", True, None), ("a/b", "b", True, None), ("a/b/x.rs", "x.rs", False, 3), ("a/y.py", "y.py", False, 2), ("z.md", "z.md", False, 0), ("q.bin", "q.bin", False, 0)], "path string, name string, is_dir boolean, tokens long")
    files = spark.createDataFrame([("a/b/x.rs", 5, "fn x", None), ("a/y.py", 3, "y\n", None), ("z.md", 4096, None, "TooLarge"), ("q.bin", 1, None, "NonUtf8")], "path string, bytes long, content string, problem string")
    text = "".join(r.text for r in export.context_dump("p", entries, files).orderBy("section", "key").collect())
    assert text == (
        "Project Context: p\nTotal files: 4 | Total tokens: 5\n\n=== DIRECTORY STRUCTURE ===\np\n├── a\n│   ├── b\n│   │   └── x.rs (3 tokens)\n│   └── y.py (2 tokens)\n├── q.bin\n└── z.md\n"
        "\n=== FILE CONTENTS ===\n\n--- FILE: a/b/x.rs (3 tokens) ---\nfn x\n\n--- FILE: a/y.py (2 tokens) ---\ny\n\n--- FILE: q.bin (0 tokens) ---\n[File skipped: Binary or read error]\n\n--- FILE: z.md (0 tokens) ---\n[File skipped: Too large (4 KB)]\n\n"
    )


def test_body_ends():
    rows = parse.parse_python("a.py", "def f():\n    x = 1\n    # own\n\n# other\ndef g():\n    pass\n")
    assert [(r[3], r[9], r[10]) for r in rows if r[1] == "symbol"] == [("f", 2, 3), ("g", 7, 7)]


def test_all_settings():
    got = config.parse('mode = CODE\nmode = odd\nexclude = ["a", "b/*"]\ntokenizer_dir = /t\nembedding_tokenizer = /e\nformat = "json" # x\nbuild_batch_size = 0\nparallel_threads = 4\nlsp_mode = full\nprovider = gpu\n')
    assert got == config.Settings(mode="code", exclude=("a", "b/*"), embedding_tokenizer="/e", rerank_tokenizer="/t", format="json", threads=4, lsp_mode="full")
    assert config.parse(config.render(got)) == got


def test_highlight_and_colours(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(export.highlight(F.lit("A.b a.B ab"), "a.b")) == "\x1b[7mA.b\x1b[0m \x1b[7ma.B\x1b[0m ab"
    got = one(export.coloured_source(F.lit('fn f() { let s = "fn // x"; } // let\n')))
    assert got == '\x1b[35mfn\x1b[0m f() { \x1b[35mlet\x1b[0m s = \x1b[32m"fn // x"\x1b[0m; } \x1b[90m// let\x1b[0m\n'


def test_settings_are_saved(tmp_path):
    path = str(tmp_path / "d" / "own.conf")
    config.save(config.Settings(token_budget=5, include_tests=True), path)
    (tmp_path / "d" / "own.conf").write_text("# mine\nunknown = 1\n" + config.render(config.Settings(token_budget=5, include_tests=True)))
    config.save(config.Settings(token_budget=9), path)
    text = (tmp_path / "d" / "own.conf").read_text()
    assert text == "# mine\nunknown = 1\ninclude_tests = true\ntoken_budget = 9\n"
    assert config.load(path, str(tmp_path / "none")) == config.merge(config.Settings(token_budget=9, include_tests=True))


def test_report_discovery(spark):
    paths = ["lcov.info", "a/coverage.xml", "target/lcov.info", "target/cov/x/cobertura.xml", "target/debug/lcov.info", "target/coverage.xml", "venv/lcov.info", "b/.git/lcov.info", "lcov.txt", "w/target/lcov.info"]
    got = {r.rel_path for r in coverage.discover(spark.createDataFrame([(p,) for p in paths], "rel_path string")).collect()}
    assert got == {"lcov.info", "a/coverage.xml", "target/lcov.info", "target/cov/x/cobertura.xml", "w/target/lcov.info"}
    reports = spark.createDataFrame([("lcov.info", "SF:a.rs\nDA:1,1\nDA:2,0\nend_of_record\n"), ("coverage.xml", '<class filename="b.py">\n<line number="1" hits="3"/>\n</class>\n')], "rel_path string, content string")
    assert {tuple(r) for r in coverage.of_reports(reports).collect()} == {("a.rs", 1, 2), ("b.py", 1, 1)}


def test_parsers_recover():
    rows = parse.parse_python("a.py", "def f():\n    g()\n\n\ndef broken(:\n    x\n\n\n@deco\ndef h():\n    pass\n")
    assert [(r[1], r[3], r[5]) for r in rows if r[1] == "symbol"] == [("symbol", "f", 1), ("symbol", "h", 10)]
    assert parse.parse_python("a.py", "def (((\n") == []
    with pytest.raises(SyntaxError):
        parse.read_python("a.py", "def (((\n")
    long_head = "impl<T: Into<String>, " + "X" * 5000 + "> Show for Holder<T> where T: Fn(u8) -> u8 { fn a(&self) { b(); } }"
    assert [(r[2], r[4]) for r in parse.parse_rust("a.rs", long_head)] == [("Impl", "Holder as Show"), ("Method", "Holder as Show::a"), ("Call", None)]
    assert [r[4] for r in parse.parse_rust("a.rs", "fn a() {}\n}\nfn b() { c(); ")] == ["a::a", "a::b", None]


def test_models_are_checked(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, None)], "k long, t string")
    assert models.embed(texts, "k", "t", lambda: models.hash_embedder(8), dimension=8).count() == 2
    with pytest.raises(Exception, match="not rows of 9"):
        models.embed(texts, "k", "t", lambda: models.hash_embedder(8), dimension=9).collect()

    def scorer():
        return lambda query, docs: np.array([float(query in d) for d in docs])

    assert {tuple(r) for r in models.score_pairs(texts, "k", "t", "a", scorer).collect()} == {(1, 1.0), (2, 0.0)}
    occ = spark.createDataFrame([(1, 5, "Call", 2, 3), (2, 5, "Call", 9, 1), (3, 5, "Import", 2, 3)], "id long, file_id long, kind string, start_line long, start_col long")
    files = spark.createDataFrame([(5, "a.py"), (6, "b.py")], "id long, rel_path string")

    def resolver():
        return lambda path, line, col: ("b.py", line + 1) if line == 2 else None

    assert [tuple(r) for r in models.resolve_places(occ, files, resolver).collect()] == [(1, 6, 3)]


def test_packs_as_documents(spark):
    rows = [(1, 1, "a: \"b\"", "included"), (1, 2, None, "included"), (1, 3, "c", "Truncated")]
    df = spark.createDataFrame(rows, "query_id long, place int, name string, status string")
    assert pack.as_json(df, ["name"]).first()["json"] == '{"query_id":1,"nodes":[{"name":"a: \\"b\\""},{}]}'
    assert pack.as_yaml(df, ["name"]).first()["yaml"] == 'query_id: "1"\nnodes:\n- name: "a: \\"b\\""\n- name: null\n'
    parts = spark.createDataFrame([(1, 1, "two"), (1, 0, "one")], "query_id long, place int, text string")
    assert pack.as_text(parts).first()["text"] == "one\ntwo"


def test_selection_and_features(spark):
    df = spark.createDataFrame([(True, 5, 2, 1), (False, 7, 7, 7), (True, 1, 1, None)], "selected boolean, bytes long, lines long, tokens long")
    assert tuple(stats.selection_totals(df).first()) == (2, 6, 3, 1)
    s = spark.createDataFrame([(2, 1, "b", "m::b", "Function"), (10, 1, "a", "m::a", "Class")], "id long, file_id long, name string, qualified_name string, kind string")
    f, m = spark.createDataFrame([(1, "m.py")], "id long, rel_path string"), spark.createDataFrame([("m", 3)], "module_path string, total_loc long")
    got = [r.json for r in export.feature_export(s, f, m).orderBy("section", "key").collect()]
    assert got[0] == '{"schema_version":"1"}' and '"id":2' in got[1] and '"id":10' in got[2] and got[3] == '{"module_path":"m","total_loc":3}'


def test_vectors_of_another_length_are_refused(spark):
    from graphloom.operators import search

    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    new = spark.createDataFrame([(2, [3.0, 3.0]), (3, [4.0, 4.0])], "id long, v array<double>")
    assert sorted((r.id, r.v[0]) for r in search.append_vectors(index, new, "id", "v", 2).collect()) == [(1, 1.0), (2, 3.0), (3, 4.0)]
    with pytest.raises(Exception, match="isn't of length 2 but 1"):
        search.append_vectors(index, spark.createDataFrame([(5, [1.0])], index.schema), "id", "v", 2).collect()
