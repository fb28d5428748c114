"""Every registered query gives the rows of its SQL."""

import pytest
from compare import connect, of_duck, of_spark

from graphloom.plans import more  # noqa: F401
from graphloom.plans.registry import ORACLES, QUERIES

#: Rows depend on a driver loop with state, or on a parser: held by tests of their own.
WITHOUT_SQL = {"layered_retrieval", "python_symbols"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert of_spark(QUERIES[name](spark, sf_dir)) == of_duck(con, ORACLES[name])


def test_queries_without_sql(spark, sf_dir):
    packed = QUERIES["layered_retrieval"](spark, sf_dir).collect()
    assert sum(r.is_root for r in packed) == 1 and len(packed) > 1 and {r.distance for r in packed} <= {0, 1, 2, 3}
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    got = {(r.row, r.kind): r.n for r in QUERIES["python_symbols"](spark, sf_dir).collect()}
    assert got == {("symbol", "Class"): n, ("symbol", "Method"): n, ("symbol", "Function"): n, ("occurrence", "Call"): 2 * n}


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["chunk_id", "score"] and out.count() > 0


def test_core_does_not_import_the_training_data_package():
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[1] / "graphloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"graphloom\.llm|from \.+llm|import llm", p.read_text()), p
