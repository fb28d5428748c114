"""The engine on a small project of its own."""

import pytest

from graphloom.engine import Engine
from graphloom.plans.retrieve import Options

FILES = {
    "src/a.py": "def run_pipeline():\n    load()\n    process()\n\n\ndef unrelated():\n    pass\n",
    "src/b.py": "class Store:\n    def save(self):\n        self.flush()\n\n    def flush(self):\n        pass\n\n\ndef load():\n    pass\n\n\ndef process():\n    save_all()\n",
    "src/c.rs": "struct Point;\nimpl Point {\n    fn norm(&self) -> f32 { self.dot(self) }\n    fn dot(&self, o: &Point) -> f32 { 1.0 }\n}\n#[test]\nfn checks() { norm(); }\n",
    "target/x.py": "def hidden():\n    pass\n",
    "README.md": "# It\n",
    "debug.log": "x\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return Engine.build(spark, str(root)).save(str(tmp_path_factory.mktemp("index")))


def by_name(engine, name):
    return engine.symbols(name, 1).first()["id"]


def test_graph(engine):
    names = {r.qualified_name for r in engine.tables["symbols"].collect()}
    assert {"a::run_pipeline", "b::Store", "b::Store::save", "Point", "Point::norm"} <= names and "c::checks" not in names and "x::hidden" not in names
    assert {r.target_name for r in engine.callees(by_name(engine, "run_pipeline")).collect()} == {"b::load", "b::process"}
    assert {r.source_name for r in engine.callers(by_name(engine, "load")).collect()} == {"a::run_pipeline"}
    assert {r.source_name for r in engine.callers(by_name(engine, "flush")).collect()} == {"b::Store::save"}
    reached = engine.slice(by_name(engine, "run_pipeline")).count()
    assert reached == 3
    assert all(r.violations == 0 for r in engine.invariants().collect())
    assert engine.resolve("run_pipeline").first()["status"] == "Unique" and engine.resolve("zzz").first()["status"] == "NotFound"
    assert engine.state().first()["state"] == "Ready"


def test_metrics(engine):
    got = {r.id: r for r in engine.metrics().collect()}
    assert got[by_name(engine, "run_pipeline")].fan_out == 2 and got[by_name(engine, "load")].fan_in == 1
    assert {r.module_path for r in engine.modules().collect()} == {"src"}


def test_retrieval(engine):
    got = {r.qualified_name: r for r in engine.retrieve("run_pipeline", options=Options(mode="callees")).collect()}
    assert got["a::run_pipeline"].is_root and got["b::load"].distance == 1 and got["b::load"].status == "included"
    none = engine.retrieve("no such thing here")
    assert none.count() == 0
    lexical = {r.qualified_name for r in engine.retrieve("flush", "lexical").collect()}
    assert "b::Store::flush" in lexical
    assert engine.retrieve("flush", "hybrid").count() >= len(lexical)
    fixed = engine.retrieve("run_pipeline", options=Options(mode="neighborhood", depth=2, budget=1)).collect()
    assert {r.status for r in fixed if not r.is_root} <= {"included", "Truncated: token budget exceeded"}


def test_project(engine):
    seen = {r.path: r.reason for r in engine.project().collect()}
    assert seen["target"] == "build artifacts" and "target/x.py" not in seen and seen["debug.log"] == "temporary file"
    s = engine.summary().first()
    assert (s.files, s.dirs, s.hidden_files, s.hidden_dirs) == (4, 1, 1, 1)
    assert any(r.line.startswith("└──") for r in engine.tree().collect())
    assert "## src/a.py" in {r.path: r.text for r in engine.render().collect()}["src/a.py"]
    assert engine.read_file("src/a.py", 2, 3).first()["text"] == "    load()\n    process()"
    assert engine.read_file("../x").count() == 0
    assert {(r.what, r.name): r.n for r in engine.info().collect()}[("language", "python")] == 2
