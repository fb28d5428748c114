"""Properties that hold for any input."""

import random

from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import chunks, filters, graph, pack, search, stats
from graphloom.sources.corpus import workspace_root


def test_rrf_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(1)
    rows = [(f"l{k}", i, None, rng.random()) for k in range(3) for i in rng.sample(range(50), 20)]
    schema = "list string, chunk_id long, symbol_id long, score double"
    one = sorted(map(tuple, search.rrf(spark.createDataFrame(rows, schema)).collect()))
    rng.shuffle(rows)
    assert one == sorted(map(tuple, search.rrf(spark.createDataFrame(rows, schema).repartition(5)).collect()))


def test_pack_keeps_its_limits(spark):
    rng = random.Random(2)
    rows = [(q, i, f"f{rng.randrange(9)}", rng.randrange(300), False, i) for q in range(20) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id long, id long, path string, tokens long, is_root boolean, place int")
    out = pack.pack(df, 1000, 10, 4).join(df, ["query_id", "id"]).where("status = 'included'")
    for r in out.groupBy("query_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.countDistinct("path").alias("f")).collect():
        assert r.t <= 1000 and r.n <= 10 and r.f <= 4


def test_slices_are_what_reachability_gives(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)}
    tests = {5, 9, 30}
    edges = spark.createDataFrame([(i, "Call", a, b) for i, (a, b) in enumerate(pairs)], "id long, kind string, from_symbol_id long, to_symbol_id long")
    symbols = spark.createDataFrame([(i, "Test" if i in tests else "Function") for i in range(60)], "id long, kind string")
    root = spark.createDataFrame([(0,)], "id long")
    depth, layer = {0: 0}, [0]
    while layer:
        nxt = sorted({b for a, b in pairs if a in layer and b not in depth and b not in tests})
        depth |= {b: depth[layer[0]] + 1 for b in nxt}
        layer = nxt
    assert {r.id: r.depth for r in graph.slice_from(edges, symbols, root).collect()} == depth


def test_rollup_of_the_top_is_the_sum(spark):
    rng = random.Random(4)
    rows = [("r/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + f"/{i}", rng.randrange(100)) for i in range(300)]
    out = {r.dir: r for r in stats.tree_rollup(spark.createDataFrame(rows, "path string, bytes long"), ["bytes"]).collect()}
    assert out["r"].bytes == sum(b for _, b in rows) and out["r"].files == 300 and out["r"].dirs == len(out)


def test_containment_equals_a_stack_sweep(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        start = rng.randrange(300)
        rows.append((i, rng.randrange(3), rng.choice(["Class", "Module", "Function", "Method"]), start, start + rng.randrange(60)))
    want = {}
    for f in range(3):
        stack = []
        for i, _, kind, start, end in sorted((r for r in rows if r[1] == f), key=lambda r: (r[3], -r[4], r[0])):
            while stack and start > stack[-1][1]:
                stack.pop()
            if stack:
                want[i] = stack[-1][0]
            if kind in ("Class", "Module"):
                stack.append((i, end))
    df = spark.createDataFrame(rows, "id long, file_id long, kind string, start_line long, end_line long")
    assert {r.child_id: r.parent_id for r in graph.contains_edges(df).collect()} == want


def test_windows_stay_inside_the_file(spark):
    df = spark.range(-3, 12).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(-2), F.lit(9))).alias("e"))
    lines = F.array(*[F.lit(f"l{i}") for i in range(1, 6)])
    for r in df.select("s", "e", tx.line_window(lines, F.col("s"), F.col("e")).alias("w"), chunks.read_lines(lines, F.col("s"), F.col("e"), 2).alias("c")).collect():
        want = [f"l{i}\n" for i in range(max(r.s, 1), min(r.e, 5) + 1)]
        assert r.w == "".join(want) and 1 <= len(r.c.split("\n")) <= 2


def test_scan_never_shows_what_is_below_a_hidden_directory(spark):
    rng = random.Random(6)
    names = ["src", "target", "a", ".git", "build", "x.rs", "y.log"]
    rows = list({("/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) + f"/f{i}.rs", 1) for i in range(200)})
    shown = {r.path for r in filters.scan(spark.createDataFrame(rows, "path string, bytes long")).collect()}
    bad = {"target", ".git", "build"}
    assert all(not bad & set(p.split("/")[:-1]) for p in shown)
    assert {p for p, _ in rows if not bad & set(p.split("/")[:-1])} <= shown


def test_workspace_root(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "pyproject.toml").touch()
    assert workspace_root(str(tmp_path / "a" / "b")) == str((tmp_path / "a").resolve())
