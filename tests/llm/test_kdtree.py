import math
import random

import numpy as np
import pytest

from planarium.llm import kdtree


def plain(rows, k=20, every=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for i, v in good:
        if i % every == 0:
            least[i] = min(least.get(i, v), v)
    out = []
    for q, v in least.items():
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("shard,block,leaf", [(16384, 8192, 256), (40, 3, 4)])
def test_top_k(spark, monkeypatch, shard, block, leaf):
    monkeypatch.setattr(kdtree, "SHARD", shard)
    monkeypatch.setattr(kdtree, "BLOCK", block)
    r = random.Random(1)
    rows = [(i, [r.choice([-1.0, 0.5, r.gauss(0, 1)]) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 340)]
    rows += [(40, None), (60, [None] * 8), (80, [float("nan")] * 8), (400, [float("inf")] * 8), (None, [1.0] * 8), (20, rows[3][1]), (20, [-5.0]), (7, rows[7][1]), (420, [0.1, 0.2]), (421, [0.3, -0.2]), (440, []), (441, [])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    assert sorted(map(tuple, kdtree.top_k(table).collect())) == plain(rows)
    assert kdtree.top_k(table.limit(0)).count() == 0


def test_large_components(spark):
    rows = [(i, [1e15 * (i - 9), 3e14 + i]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, kdtree.top_k(table).collect())) == plain(rows)


def test_tree_prunes():
    r = np.random.default_rng(0)
    points = (r.normal(size=(4000, 3)) * 64).round()
    tree = kdtree.Tree(np.arange(4000), points, 32)
    who, ids, scores, opened = tree.search(points[:50], np.arange(50), 5, np.full(50, -np.inf))
    for q in range(50):
        best = np.lexsort((np.arange(4000), -(points @ points[q])))
        assert ids[who == q].tolist() == [i for i in best if i != q][:5]
    assert opened < 50 * len(tree.rows) / 4
    floors = np.array([scores[who == q][-1] for q in range(50)])
    again = tree.search(points[:50], np.arange(50), 5, floors)
    assert again[1].tolist() == ids.tolist() and again[3] <= opened


def test_splits_halve():
    r = np.random.default_rng(0)
    points = (r.normal(size=(5000, 4)) * 64).round().astype(np.int64)
    splits = kdtree.Splits(points[:2000], 16)
    many = np.bincount(splits.place(points), minlength=16)
    assert splits.cells == 16 and many.min() > 5000 / 16 / 2 and many.max() < 5000 / 16 * 2
    assert kdtree.Splits(points[:1], 16).cells == kdtree.Splits(np.zeros((9, 4), np.int64), 16).cells == 1


def test_queries_travel_only_where_bounds_reach(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD", 50)
    kept = {}
    monkeypatch.setattr(kdtree, "written", lambda df, name, real=kdtree.written: kept.setdefault(name, real(df, name)))
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(16)]
    rows = [(i, [c + r.gauss(0, 0.05) for c in centres[i % 16]]) for i in range(1600)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # one very common vector
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, kdtree.top_k(table).collect())) == plain(rows)
    shards = sum(x.shards for x in kept["shards"].collect())
    queries = kept["vector-queries"].count()
    assert shards >= 32 and kept["away-queries"].count() < 0.5 * queries * shards
