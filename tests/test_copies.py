"""Queries over parts that repeat with shifted keys: ties and differences at a tolerance that single rows seldom have."""

import time

import duckdb
import numpy as np
import pytest

from planarium import plans
from planarium.operators import fitting

QUERIES, ORACLES = plans.load()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("copies")
    duckdb.sql(f"COPY (SELECT * REPLACE (p_partkey + 2000 * k AS p_partkey) FROM '/root/testdata/sf0.01/part.parquet', range(6) AS t(k)) TO '{at}/part.parquet'")
    return str(at)


@pytest.fixture
def both(spark, folder):
    def rows(name):
        df = QUERIES[name](spark, folder)
        names = sorted(df.columns)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
        return sorted(map(tuple, df.select(*names).collect())), sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall())

    return rows


def test_affine_errors_at_the_tolerance(both):
    mine, theirs = both("affine_hypotheses")
    assert mine == theirs and len(mine) == 150


def test_rectified_rows_of_many_matches(both):
    mine, theirs = both("rectified_rows")
    assert mine == theirs and len(mine) == 5


def test_triangulated_points_of_many_matches(both):
    mine, theirs = both("triangulated_points")
    assert mine == theirs and len(mine) == 12_000


def test_two_view_poses_of_many_matches(both):
    mine, theirs = both("two_view_poses")
    assert mine == theirs and len(mine) == 5


def test_cell_lookup_broadcasts_no_table_of_pixels(spark, folder, both):
    text = QUERIES["projected_cell_lookup"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text
    mine, theirs = both("projected_cell_lookup")
    assert len(mine) == 12_000 and set(mine) == set(theirs)


def _cpu(weights):
    """CPU seconds of the best line of 40 points that each recur 50 times: two thousand points have two million pairs."""
    r = np.random.default_rng(2)
    x, y = np.tile(r.integers(0, 50, 40), 50).astype(float), np.tile(r.integers(0, 900, 40), 50).astype(float)
    start = time.process_time()
    fitting._best_line(x, y, 2.0, weights)
    return time.process_time() - start


@pytest.mark.parametrize("name, weights", [("even_line", (1.0, 1.0)), ("fixpoint_extraction", (1.0, 0.0)), ("ransac_exhaustive_line", (1.0, 0.0))])
def test_lines_of_points_that_repeat(both, name, weights):
    mine, theirs = both(name)
    assert mine == theirs and len(mine) >= 150
    assert _cpu(weights) < 3


def _plain(x, y, weights):
    """The best line of all pairs, each judged in the order of equals."""
    i, j = np.triu_indices(len(x), 1)
    apart = np.hypot(x[j] - x[i], y[j] - y[i]) > 0
    i, j = i[apart], j[apart]
    votes, even, score = fitting._judged(x, y, np.ones(len(x), np.int64), i, j, len(x), 2.0, weights)
    k = int(score.argmax())
    return int(i[k]), int(j[k]), int(votes[k]), float(even[k]), float(score[k]) / 1e9


@pytest.mark.parametrize("weights", [(1.0, 1.0), (1.0, 0.0)])
def test_lines_of_points_that_differ(weights):
    r = np.random.default_rng(4)
    for wide, high, shift in ((50, 100, 0.0), (8, 20, 0.3), (6, 40, 1e6)):
        for block in (1 << 20, 1 << 8):
            x, y = r.integers(0, wide, 90).astype(float), r.integers(0, high * 10, 90) / 10 + shift
            assert fitting._best_line(x, y, 2.0, weights, block=block) == _plain(x, y, weights)
    x, y = r.normal(size=90) * 10, r.normal(size=90) * 10
    assert fitting._best_line(x, y, 2.0, weights) == _plain(x, y, weights)
    # five thousand places of fifty thousand: twelve million pairs, each of five thousand points
    some = r.choice(50_000, 5000, replace=False)
    start = time.process_time()
    fitting._best_line(some % 50 + 1.0, some // 50 / 10, 2.0, weights)
    assert time.process_time() - start < 4


def test_only_as_many_lines_as_asked_for(spark):
    rows = [(1, k, float(k % 10), float(k // 10)) for k in range(100)]
    dots = spark.createDataFrame(rows, "k int, id int, x double, y double")
    every = fitting.fit_lines(dots, ["k"], "id", "x", "y", 0.1, drawn=None, outliers=0.0).orderBy("line").collect()
    assert len(every) > 2
    assert fitting.fit_lines(dots, ["k"], "id", "x", "y", 0.1, drawn=None, outliers=0.0, lines=2).orderBy("line").collect() == every[:2]
