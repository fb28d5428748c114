"""Keeping an index: versions, replays, failures, freshness, ignore files, search parts."""

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.operators import graph, lexical, maintain
from graphloom.sources.corpus import scan_files
from graphloom.streaming import incremental


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_py", ".py")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def facts(tables):
    """Edges by names, symbols, and what state files are in: the same for two ways to one index."""
    names = tables["symbols"].select("id", "qualified_name")
    e = tables["edges"].join(names.withColumnsRenamed({"id": "from_symbol_id", "qualified_name": "a"}), "from_symbol_id").join(names.withColumnsRenamed({"id": "to_symbol_id", "qualified_name": "b"}), "to_symbol_id", "left")
    return sorted(map(str, e.select("id", "kind", "a", "b", "raw_text", "confidence").collect())), sorted(map(str, tables["symbols"].select("qualified_name", "kind", "parent_symbol_id").collect())), sorted(map(str, tables["files"].select("rel_path", "parse_status").collect()))


def test_a_replayed_batch_gives_the_same(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    write(src, a_py="class A:\n    def f(self):\n        g()\n", b_py="def g():\n    pass\n")
    incremental.apply_batch(spark, scan_files(spark, str(src)), out, 0)
    first = facts(incremental.load(spark, out))
    write(src, c_py="def g():\n    pass\n")
    new = scan_files(spark, str(src)).where("rel_path = 'c.py'")
    incremental.apply_batch(spark, new, out, 1)
    second = facts(incremental.load(spark, out))
    assert first != second and any("Contains" in e for e in second[0]) and any("Unresolved" in e for e in second[0])
    incremental.apply_batch(spark, new, out, 1)
    assert facts(incremental.load(spark, out)) == second
    incremental.apply_batch(spark, scan_files(spark, str(src)).where("rel_path <> 'c.py'"), out, 0)
    assert facts(incremental.load(spark, out, below=1)) == first and facts(incremental.load(spark, out)) == second


FILES = {"a_py": "def f():\n    g()\n    h()\n", "b_py": "def g():\n    pass\n\n\nclass K:\n    def m(self):\n        f()\n", "c_py": "def h():\n    g()\n"}


@pytest.fixture
def project(tmp_path):
    write(tmp_path / "p", **FILES)
    return tmp_path / "p"


def test_update_equals_a_build(spark, project, tmp_path):
    path = str(tmp_path / "index")
    engine = Engine.ensure_fresh(spark, str(project), path)
    assert engine.state().first()["state"] == "Ready"
    again = Engine.ensure_fresh(spark, str(project), path)
    assert again.path == engine.path  # nothing to do
    write(project, b_py="def g():\n    pass\n\n\ndef h():\n    pass\n", d_py="class D:\n    def go(self):\n        f()\n")
    (project / "c.py").unlink()
    said = []
    fresh = Engine.ensure_fresh(spark, str(project), path, progress=said.append)
    assert said == ["NeedsIncrementalUpdate"] and fresh.path != engine.path
    built = Engine.build(spark, str(project))
    assert facts(fresh.tables) == facts(built.tables)
    texts = lambda e: sorted((r.kind, r.qualified_name, r.text_hash) for r in e.tables["chunks"].collect())
    assert texts(fresh) == texts(built)
    assert {r.qualified_name for r in fresh.retrieve("go", "lexical").collect()} >= {"d::D::go"}
    assert all(r.violations == 0 for r in fresh.invariants().collect())


def test_a_file_that_stops_parsing_keeps_its_graph(spark, project, tmp_path):
    path = str(tmp_path / "index")
    before = facts(Engine.ensure_fresh(spark, str(project), path).tables)
    write(project, b_py="def ((((\n")
    failed = Engine.ensure_fresh(spark, str(project), path)
    after = facts(failed.tables)
    assert after[:2] == before[:2] and "Row(rel_path='b.py', parse_status='Failed')" in after[2]
    assert failed.state().first()["modified"] == 1  # tried again
    write(project, b_py=FILES["b_py"])
    assert facts(Engine.ensure_fresh(spark, str(project), path).tables) == before


def test_a_version_that_differs_is_built_anew(spark, project, tmp_path):
    path = str(tmp_path / "index")
    own = Engine.load_or_build(spark, str(project), path)
    maintain.write_metadata(spark, own.path, {"schema_version": "0"})
    state = Engine.load(spark, path, str(project)).state().first()
    assert (state.state, state.reason) == ("NeedsFullRebuild", "SchemaVersionChanged")
    assert Engine.ensure_fresh(spark, str(project), path).state().first()["state"] == "Ready"
    with pytest.raises(FileNotFoundError):
        Engine.load(spark, str(tmp_path / "nothing"))


def test_search_parts(spark, project, tmp_path):
    from graphloom.operators.models import hash_embedder

    own = Engine.build(spark, str(project)).save(str(tmp_path / "index"))
    assert own.build_search() == ([], [])
    small = lambda: hash_embedder(16)
    assert own.build_search(small, "m1") == (["dense"], []) and own.build_search(small, "m1") == ([], []) and own.build_search(small, "m2") == (["dense"], [])
    assert own.build_search(small, "m2", force=True) == (["lexical", "dense"], [])

    def broken():
        raise RuntimeError("no model")

    done, warnings = own.build_search(broken, "m3")
    assert done == [] and len(warnings) == 1 and warnings[0].startswith("dense: ")
    assert own.retrieve("h", "hybrid", embedder=small).count() > 0


def test_clear_by_language_and_backend(spark, project, tmp_path):
    (project / "x.rs").write_text("fn r() { g(); }\n")
    own = Engine.build(spark, str(project))
    assert own.clear("python", "other").tables["files"].count() == 4
    left = own.clear("python", "scanner")
    assert [r.rel_path for r in left.tables["files"].collect()] == ["x.rs"] and {r.confidence for r in left.tables["edges"].where("kind = 'Call'").collect()} == {"Unresolved"}


def test_ignore_files_hide_entries(spark, tmp_path):
    root = tmp_path / "p"
    write(root, **{".gitignore": "*.gen\n# [deps]\n/only_here\n", "a.txt": "x", "b.gen": "x", "only_here": "x", "d__only_here": "x", "d__.gitignore": "!keep.gen\n\n#[keep]\nout.tmp2\n", "d__keep.gen": "x", "d__other.gen": "x", ".git__info__exclude": "*.exc\n", "e.exc": "x", "g.glob": "x"})
    own = Engine(spark, {}, str(root))
    files = lambda **k: {r.path for r in own.project(**k).where("not is_dir and path not like '.git%' and path not like '%.gitignore'").collect()}
    assert files() == {"a.txt", "d/only_here", "d/keep.gen", "g.glob"}
    assert files(global_ignore="*.glob") == {"a.txt", "d/only_here", "d/keep.gen"}
    assert files(exclude=("a.*",)) == {"d/only_here", "d/keep.gen", "g.glob"}
    assert len(files(respect_ignore=False)) == 8 and files(respect_ignore=False, exclude=("d/",)) == {"a.txt", "b.gen", "only_here", "e.exc", "g.glob"}


def test_lexical_index_reads_its_terms_only(spark, tmp_path):
    root = str(tmp_path / "lexical")
    docs = spark.createDataFrame([(i, f"word{i} common", f"title {i}") for i in range(200)] + [(500, None, None)], "doc long, text string, title string")
    lexical.build(docs, "doc", ["text", "title"], root)
    found = lexical.search(spark, root, "word7 WORD7", None)
    assert [r.doc for r in found.collect()] == [7] and lexical.count(spark, root) == 201
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "PushedFilters" in plan and "In(term, [word7])" in plan or "EqualTo(term,word7)" in plan
    from graphloom.operators.search import bm25

    want = sorted(map(tuple, bm25(docs, "doc", ["text", "title"], "common title 3", None).collect()))
    assert sorted(map(tuple, lexical.search(spark, root, "common title 3", None).collect())) == want
    lexical.upsert(spark.createDataFrame([(7, "changed", "t"), (900, "new word7", "t")], docs.schema), "doc", ["text", "title"], root)
    lexical.remove(spark.createDataFrame([(3,)], "doc long"), "doc", ["text", "title"], root)
    assert [r.doc for r in lexical.search(spark, root, "word7", None).collect()] == [900] and lexical.search(spark, root, "word3").count() == 0
    assert lexical.count(spark, root) == 201 and lexical.search(spark, root, "!!").count() == 0


def test_sweeps_equal_pairing(spark):
    """Containment and definitions of one hot file with overlapping ranges, against every pair."""
    import random

    rng = random.Random(3)
    rows = []
    for i in range(400):
        a = rng.randrange(1, 300)
        b = a + rng.choice([0, 1, 5, 40, 200])
        body = rng.choice([None, (a + 1, b), (a, b - 1), (b + 5, b)])
        rows.append((i, 7 if i % 10 else 8, rng.choice(["Class", "Function", "Module"]), a, b, *(body or (None, None))))
    s = spark.createDataFrame(rows, "id long, file_id long, kind string, start_line long, end_line long, body_start_line long, body_end_line long")
    key = lambda r: (r[3], -r[4], r[0])
    want = set()
    for c in rows:
        fits = [p for p in rows if p[1] == c[1] and p[2] != "Function" and key(p) < key(c) and p[4] >= c[3]]
        if fits:
            want.add((max(fits, key=key)[0], c[0]))
    assert {tuple(r) for r in graph.contains_edges(s).collect()} == want
    places = [(i, 7 + i % 2, rng.randrange(1, 400)) for i in range(500)]
    at = spark.createDataFrame(places, "occurrence_id long, file_id long, line long")
    want = set()
    for i, f, line in places:
        fits = [(r[4] - r[3], r[0]) for r in rows if r[1] == f and r[3] <= line <= r[4] and not (r[5] is not None and r[5] <= line <= r[6])]
        if fits:
            want.add((i, min(fits)[1]))
    assert {tuple(r) for r in graph.match_definitions(at, s).collect()} == want


def test_cohesion_both_ways(spark):
    import random

    rng = random.Random(4)
    symbols = [(c * 1000, None, "Class") for c in (1, 2, 3)] + [(c * 1000 + m, c * 1000, "Method") for c in (1, 2, 3) for m in range(1, 40)]
    occ = [(i, s[0], f"r{rng.randrange(30)}") for i, s in enumerate(x for x in symbols for _ in range(3) if x[2] == "Method")] + [(9000 + m, 1000 + m, "hot") for m in range(1, 40)]
    s = spark.createDataFrame(symbols, "id long, parent_symbol_id long, kind string")
    o = spark.createDataFrame(occ, "id long, enclosing_symbol_id long, raw_text string")
    by_pairs = {tuple(r) for r in graph.lcom(s, o).collect()}
    assert by_pairs == {tuple(r) for r in graph.lcom(s, o, most_pairs=0).collect()} == {tuple(r) for r in graph.lcom(s, o, most_pairs=80).collect()}


def graph_of(spark, pairs, n):
    e = spark.createDataFrame([(i, "Call", a, b, f"c{i}", "Syntax") for i, (a, b) in enumerate(pairs)], "id long, kind string, from_symbol_id long, to_symbol_id long, raw_text string, confidence string")
    s = spark.createDataFrame([(i, f"s{i}", f"m::s{i}", "Function", 1, i + 1, i + 1) for i in range(n)], "id long, name string, qualified_name string, kind string, file_id long, start_line long, end_line long")
    return e, s


def test_graph_context(spark):
    from graphloom.operators import export

    e, s = graph_of(spark, [(0, 1), (0, 2), (1, 3), (3, 0), (2, 3), (4, 0)], 5)
    got = graph.graph_context(e, s, 0, "callees", 3)
    assert [(r.id, r.depth) for r in got["nodes"].orderBy("place").collect()] == [(0, 0), (1, 1), (2, 1), (3, 2)]
    assert {(r.from_id, r.to_id) for r in got["edges"].collect()} == {(0, 1), (0, 2), (1, 3), (2, 3), (3, 0)}
    assert {r.message for r in got["diagnostics"].collect()} == {"Cycle or loop detected at symbol: m::s2", "Cycle or loop detected at symbol: m::s3"}
    cut_off = graph.graph_context(e, s, 0, "callees", 3, max_nodes=2)
    assert cut_off["nodes"].count() == 2 and ("warning", "Context truncated: max_nodes limit (2) reached.") in {tuple(r) for r in cut_off["diagnostics"].collect()}
    assert graph.graph_context(e, s, 0, "callers", 1, include_root=False)["nodes"].count() == 2
    files = spark.createDataFrame([(1, "m.py", "one\ntwo\nthree\nfour\nfive\n")], "id long, rel_path string, content string")
    doc = export.graph_documents(got, s, files, 0, "callees", 3, 200, 2).first()
    assert "Root: function s0\nPath: m.py:1-1\nMode: callees\n" in doc.markdown and "m::s0 -> m::s1\nm::s0 -> m::s2\n" in doc.markdown and "```python\none\n```" in doc.markdown and "_(2 additional files omitted due to max_files limit)_" in doc.markdown
    import json

    parsed = json.loads(doc.json)
    assert parsed["root"]["name"] == "s0" and len(parsed["nodes"]) == 4 and {"from": "m::s0", "to": "m::s1"} in parsed["edges"]
    yaml = pytest.importorskip("yaml")
    again = yaml.safe_load(doc.yaml)
    assert again["root"]["qualified_name"] == "m::s0" and len(again["edges"]) == 5 and again["max_nodes"] == 200


def test_slice_tree(spark):
    e, s = graph_of(spark, [(0, 2), (0, 1), (2, 3), (3, 0), (1, 1), (0, 2)], 4)
    lines = [r.line for r in graph.slice_tree(e, s, 0).orderBy("place").collect()]
    assert lines == ["m::s0", "  └─ m::s2", "    └─ m::s3", "      └─ m::s0 (already visited)", "  └─ m::s1", "    └─ m::s1 (already visited)"]
    assert [r.line for r in graph.slice_tree(e, s, 0, max_lines=2).orderBy("place").collect()] == ["m::s0", "  └─ m::s2", "    └─ ... (truncated)"]
    assert graph.slice_tree(e, s, 0, max_depth=1).count() == 3


def test_a_slice_that_goes_on_is_an_error(spark):
    e, s = graph_of(spark, [(i, i + 1) for i in range(6)], 7)
    root = spark.createDataFrame([(0,)], "id long")
    s = s.withColumn("kind", F.lit("Function"))
    assert graph.slice_from(e, s, root).count() == 7
    with pytest.raises(RuntimeError):
        graph.slice_from(e, s, root, max_rounds=3)
    assert graph.context(e, s, root, "callees", 12).agg(F.max("distance")).first()[0] == 6
