"""Registered queries against their SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.operators import topology
from gridloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
#: A third of the queries, or with GRIDLOOM_ALL_QUERIES all of them.
SOME = sorted(catalog.ORACLES)[:: 1 if os.environ.get("GRIDLOOM_ALL_QUERIES") else 3]


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    one = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    df = catalog.QUERIES[name](spark, FOLDER)
    found = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(found.fetchall(), names)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 35


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["voronoi_cells", "circumcenters", "wkt_polygons"])
def test_no_broadcast_by_guess(spark, name):
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_part" not in line] == []  # counts by partition are broadcast


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_triangles_are_chosen_once(spark, monkeypatch):
    calls, subset = [], topology.subset
    monkeypatch.setattr(topology, "subset", lambda *a: calls.append(1) or subset(*a))
    catalog.QUERIES["circumcenters"](spark, FOLDER)
    assert len(calls) == 1
