"""Automatic depth of layered retrieval: its bounds one by one."""

import pytest

from graphloom.plans.retrieve import Options, layered


def frames(spark, pairs, tokens=None, paths=None):
    ids = sorted({x for p in pairs for x in p})
    name = lambda i: "root" if i == 0 else f"s{i:02d}"
    e = spark.createDataFrame([(k, "Call", a, b, "Syntax") for k, (a, b) in enumerate(pairs)], "id long, kind string, from_symbol_id long, to_symbol_id long, confidence string")
    s = spark.createDataFrame([(i, name(i), f"m::{name(i)}", "Function", i, "x" * 4 * (tokens or {}).get(i, 1)) for i in ids], "id long, name string, qualified_name string, kind string, file_id long, snippet string")
    f = spark.createDataFrame([(i, (paths or {}).get(i, f"src/f{i}.rs")) for i in ids], "id long, rel_path string")
    return e, s, f


CHAIN = [(0, 1), (1, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize(
    "tokens, paths, options, want",
    [
        (None, None, {}, {0: 0, 1: 1, 2: 2, 3: 3}),  # three layers at most
        ({0: 10, 1: 50, 2: 100}, None, {"budget": 100}, {0: 0, 1: 1}),  # the second layer costs more than what is left
        ({0: 10, 1: 5000}, None, {"budget": 100}, {0: 0, 1: 1}),  # the first comes whatever it costs
        (None, {3: "vendor/f3.rs"}, {}, {0: 0, 1: 1, 2: 2}),  # 1 for the distance, 1.2 for the confidence, -4 for the path: below the floor
        (None, None, {"depth": 4}, {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}),  # asked for
    ],
)
def test_depth(spark, tokens, paths, options, want):
    got = layered(*frames(spark, CHAIN, tokens, paths), "root", Options(mode="callees", ranking="graph", **options))
    assert {r.id: r.distance for r in got.collect()} == want


def test_frontier(spark):
    got = layered(*frames(spark, [(0, i) for i in range(1, 81)]), "root", Options(mode="callees", ranking="graph", budget=100_000)).collect()
    assert sorted(r.id for r in got) == list(range(51))  # fifty of equal rank: the first by id
