"""Every query with an oracle gives DuckDB's rows; the others keep their invariants."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from planarium import plans

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    cursor = duck.execute(ORACLES[name])
    found = [c[0] for c in cursor.description]
    assert sorted(found) == names
    order = [found.index(c) for c in names]
    assert mine == sorted(repr(tuple(row[k] for k in order)) for row in cursor.fetchall())


def test_entry_has_rows_and_names_agree(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plan_has_no_cross_product(spark):
    for name in ("knn2_ratio_match", "band_join", "offset_neighbour_join", "corner_prf", "arc_votes", "nearest_edge_projection"):
        text = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scan_is_pruned_and_pushed(spark):
    text = QUERIES["scan_filter_project"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity" in text
    assert "l_extendedprice" not in text
