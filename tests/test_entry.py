import importlib
import sys

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def canonical(value):
    if value is None or value != value:
        return None
    return repr(float(value)) if isinstance(value, float) else tuple(map(canonical, value)) if isinstance(value, list | tuple) else str(value)


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    if not glob.glob(f"{SF}/*.parquet"):
        pytest.skip("no test data")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_queries_match_their_sql(spark, duck):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    wrong = []
    for name in sorted(oracles):
        df = queries[name](spark, SF)
        mine = sorted(repr(tuple(canonical(r[k]) for k in sorted(df.columns))) for r in df.collect())
        cursor = duck.execute(oracles[name])
        columns = [x[0] for x in cursor.description]
        order = [columns.index(k) for k in sorted(columns)]
        if sorted(columns) != sorted(df.columns) or mine != sorted(repr(tuple(canonical(r[i]) for i in order)) for r in cursor.fetchall()):
            wrong.append(name)
    assert wrong == []


def test_core_stands_without_the_optional_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("siftworks.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "siftworks.llm", None)
    names = set(importlib.reload(__spark_entry__).queries())
    assert "p2_found" in names and "p1_found" not in names
