import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planarium.operators import walls


def test_arcs_merge_over_the_seam(spark):
    schema = "pano int, plane int, nx double, ny double, nz double, umin double, umax double, length double, score double"
    n = (0.0, 0.0, 1.0)
    tilt = (math.sin(0.3), 0.0, math.cos(0.3))
    rows = [(1, 1, *n, 0.9, 0.05, 3.0, 1.0), (1, 1, 0.0, 0.0, -1.0, 0.04, 0.2, 2.0, 1.0), (1, 1, *n, 0.4, 0.5, 1.0, 1.0), (1, 1, *tilt, 0.9, 0.2, 1.0, 1.0), (1, 2, *n, 0.0, 0.1, 1.0, 1.0)]
    got = walls.merge_arcs(spark.createDataFrame(rows, schema), "pano").collect()
    assert len(got) == 4
    best = max(got, key=lambda r: r.length)
    assert (best.umin, best.umax, best.score) == (0.9, 0.2, 1.0) and abs(best.nz) == pytest.approx(1)
    assert best.length == pytest.approx(0.3 * 2 * math.pi)  # measured from end to end


def test_main_directions(spark):
    r = np.random.default_rng(0)
    turn = np.linalg.qr(r.normal(size=(3, 3)))[0]
    rows = []
    for k in range(3):
        for _ in range(40):
            a = r.uniform(0, 2 * math.pi)
            n = math.cos(a) * turn[:, (k + 1) % 3] + math.sin(a) * turn[:, (k + 2) % 3]
            rows.append((*map(float, n), 1.0))
    arcs = spark.createDataFrame([("a", *r) for r in rows] + [("b", 0.0, 0.0, 1.0, 0.0)], "k string, nx double, ny double, nz double, weight double")
    found = walls.manhattan_frames(arcs, "k").orderBy("k", "axis").collect()
    assert [r.k for r in found] == ["a"] * 3 + ["b"] * 3
    got = np.array([[r.x, r.y, r.z] for r in found[:3]])
    assert np.sort(np.abs(got @ turn).max(1)).min() > 0.99
    assert np.abs(got @ got.T - np.eye(3)).max() < 0.05


def test_corners_of_a_room(spark):
    lines = [(1, 0, 0.0, 0.0, 1.0, 0.0), (1, 1, 4.0, 0.0, 0.0, 1.0), (1, 2, 0.0, 3.0, 1.0, 0.0), (1, 3, 0.0, 0.0, 0.0, 1.0)]
    dots = [(1, x / 4, y) for x in range(17) for y in (0.0, 3.0)] + [(1, x, y / 4) for y in range(13) for x in (0.0, 4.0)]
    got = walls.wall_corners(spark.createDataFrame(lines, "plan int, line int, ax double, ay double, bx double, by double"), spark.createDataFrame(dots, "plan int, x double, y double"), "plan", 0.1).orderBy("line").collect()
    assert [tuple(r)[2:6] for r in got] == [(0, 0, 4, 0), (4, 0, 4, 3), (0, 3, 4, 3), (0, 0, 0, 3)]


def test_traced_wall_is_straight(spark):
    w = spark.createDataFrame([(100.0, -0.5, 150.0, -0.8), (1000.0, -0.4, 20.0, -0.4)], "u0 double, v0 double, u1 double, v1 double")
    rows = walls.traced_wall(w, 1024).collect()
    assert len(rows) == 51 + 45
    for u0 in (100.0, 1000.0):
        own = [r for r in rows if r.u0 == u0]
        assert own[0].v == pytest.approx(own[0].v0) and own[-1].v == pytest.approx(own[-1].v1)
        a = [(r.col + 0.5) / 1024 * 2 * math.pi - math.pi for r in own]
        xy = np.array([(math.sin(t) / math.tan(r.v), math.cos(t) / math.tan(r.v)) for t, r in zip(a, own)])
        d = xy - xy[0]
        assert np.abs(d[:, 0] * d[-1, 1] - d[:, 1] * d[-1, 0]).max() < 1e-9


def test_outlines(spark):
    line = spark.createDataFrame([("a", k, x) for k, x in enumerate([900, 1000, 20, 60, 10])], "k string, i int, x int")
    assert [r.part for r in walls.split_at_seam(line, ["k"], "i", "x").orderBy("i").collect()] == [0, 0, 1, 1, 2]
    shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    polygons = spark.createDataFrame([("a", shape)], "k string, corners array<struct<x:double,y:double>>")
    dots = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 3.9, 3.0), ("a", 5.0, 1.0)], "k string, x double, y double")
    assert sorted((r.x, r.y) for r in walls.inside(dots, polygons, ["k"]).collect()) == [(1.0, 1.0), (3.9, 3.0)]
    spread = walls.spread_points(polygons, ["k"], 5)
    assert 3 <= spread.count() <= 5 and walls.inside(spread, polygons, ["k"]).count() == spread.count()
    corners = spark.createDataFrame([(0.7, -0.4)], "u double, v double")
    once = walls.stretched(walls.stretched(corners, 2.0, 1.0), 0.5, 1.0).first()
    assert (once.u, once.v) == (pytest.approx(0.7), pytest.approx(-0.4))


def boundary(corners, noise=0.0):
    r = np.random.default_rng(5)
    rows, col = [], 0
    for s, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1])):
        for t in np.linspace(0.02, 0.98, 30):
            p = np.array(a) + (np.array(b) - a) * t + r.normal(0, noise, 2)
            rows.append(("room", s, col, float(p[0]), float(p[1])))
            col += 1
    return rows


def test_rooms_along_axes(spark):
    schema = "k string, segment int, col int, x double, y double"
    shape = [(-2.0, -2.0), (3.0, -2.0), (3.0, 1.0), (1.0, 1.0), (1.0, 4.0), (-2.0, 4.0)]
    got = walls.manhattan_walls(spark.createDataFrame(boundary(shape, 0.01), schema), "k", 0.05).orderBy("seq").collect()
    assert len(got) == 6
    for x, y in shape:
        assert min(math.hypot(r.x - x, r.y - y) for r in got) < 0.05
    # a step that has no segment of its own is put in
    rows = [("room", 0, k, 0.0 + k * 0.1, 0.0) for k in range(20)] + [("room", 1, 20 + k, 2.0 + k * 0.1, 0.5) for k in range(20)]
    rows += [("room", 2, 40 + k, 4.0, 0.5 + k * 0.1) for k in range(20)] + [("room", 3, 60 + k, 4.0 - k * 0.2, 2.5) for k in range(20)] + [("room", 4, 80 + k, 0.0, 2.5 - k * 0.125) for k in range(20)]
    got = walls.manhattan_walls(spark.createDataFrame(rows, schema), "k", 0.1).orderBy("seq").collect()
    assert [(round(r.x, 2), round(r.y, 2)) for r in got] == [(1.95, 0.0), (1.95, 0.5), (4.0, 0.5), (4.0, 2.5), (0.0, 2.5), (0.0, 0.0)]
    pixels = walls.corner_pixels(spark.createDataFrame([("a", 0, 1.0, 1.0), ("a", 1, -1.0, 1.0), ("a", 2, -1.0, -1.0), ("a", 3, 1.0, -1.0)], "k string, seq int, x double, y double"), "k", F.lit(1.5), 512, 1024).orderBy("seq").collect()
    assert [round(r.u + 0.5) for r in pixels] == [128, 896, 640, 384]
    assert all(256 < r.v < 512 for r in pixels)


def test_ends_of_walls():
    from planarium.operators.walls import _ends

    dots = np.array([[x, 0.0] for x in np.linspace(1, 9, 17)])
    far = np.array([[0.0, 0.0], [10.0, 0.0], [40.0, 0.0]])
    # no point is within the radius of any crossing until it has grown
    assert _ends(0, 0, 1, 0, dots, far, 0.25, 2.0, 5, 2.0)[:4] == (0, 0, 10, 0)
    # an end too far away gives way to the line's own on that side, both to both
    assert _ends(0, 0, 1, 0, dots, np.array([[0.5, 0.0], [40.0, 0.0]]), 0.6, 2.0, 5, 1.0)[:4] == (0.5, 0, 9, 0)
    assert _ends(0, 0, 1, 0, dots, np.array([[-30.0, 0.0], [40.0, 0.0]]), 0.6, 2.0, 5, 1.0)[:4] == (1, 0, 9, 0)
    assert _ends(0, 0, 1, 0, dots, far[:1], 0.6, 2.0, 5, 1.0) == (1, 0, 9, 0, 0)


def test_lines_are_even_and_drawn(spark):
    from planarium.operators import fitting

    r = np.random.default_rng(2)
    dots = [("a", k, float(x), 0.0) for k, x in enumerate(np.linspace(0, 10, 60))] + [("a", 100 + k, 3.0 + float(r.normal(0, 0.01)), float(5 + r.normal(0, 0.01))) for k in range(59)]
    dots += [("b", 0, 1.0, 1.0), ("b", 1, 1.0, 1.0), ("c", 0, 0.0, 0.0), ("c", 1, 1.0, 0.0), ("d", 0, 1.0, 1.0)]
    table = spark.createDataFrame(dots, "k string, id int, x double, y double")
    for drawn in (None, 3000):
        got = fitting.fit_lines(table, ["k"], "id", "x", "y", 0.05, outliers=0.6, drawn=drawn).collect()
        first = [g for g in got if g.k == "a"][0]
        assert (first.line, first.inliers, abs(first.by)) == (0, 60, 0.0) and first.uniformity > 0.09  # as many points in one place are no wall
        assert {g.k for g in got} == {"a", "c"}
    pairs = [p for a, b in fitting._pairs(9, 10, None, 0) for p in zip(a.tolist(), b.tolist())]
    assert pairs == [(i, j) for i in range(9) for j in range(i + 1, 9)]
