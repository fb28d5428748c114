"""Reading trees of files, in one go and as a stream."""

from pyspark.sql import functions as F

from graphloom.sources.corpus import scan_files
from graphloom.streaming import incremental


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_py", ".py")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_scan_files(spark, tmp_path):
    write(tmp_path, a_py="x = 1\n", d__b_py=b"\xff\xfe", d__c_py="y" * 100)
    got = {r.rel_path: (r.bytes, r.content, r.problem) for r in scan_files(spark, str(tmp_path), 50).collect()}
    assert got == {"a.py": (6, "x = 1\n", None), "d/b.py": (2, None, "NonUtf8"), "d/c.py": (100, None, "TooLarge")}


def edges(spark, root):
    t = incremental.load(spark, root)
    names = t["symbols"].select(F.col("id").alias("to_symbol_id"), "qualified_name")
    return {(r.raw_text, r.qualified_name, r.confidence) for r in t["edges"].join(names, "to_symbol_id", "left").collect()}


def test_stream_keeps_the_graph_up_to_date(spark, tmp_path):
    src, out, cp = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "cp")
    write(src, a_py="def f():\n    g()\n", b_py="def g():\n    pass\n")
    incremental.follow(spark, str(src), out, cp).awaitTermination()
    assert edges(spark, out) == {("g", "b::g", "Heuristic")}
    write(src, c_py="def g():\n    pass\n\ndef k():\n    f()\n")  # a second g makes the first call ambiguous
    incremental.follow(spark, str(src), out, cp).awaitTermination()
    assert edges(spark, out) == {("g", None, "Unresolved"), ("f", "a::f", "Heuristic")}
