import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from planarium.operators import bundle, infer, propagate, vision


def scene(seed=0, n=60):
    r = np.random.default_rng(seed)
    x = r.uniform(-2, 2, (n, 3)) + [0, 0, 6]
    a = 0.2
    turn = np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
    t = np.array([-1.0, 0.1, 0.2])
    y = x @ turn.T + t
    return x, turn, t, x[:, :2] / x[:, 2:], y[:, :2] / y[:, 2:]


def test_homography_and_fundamental():
    r = np.random.default_rng(1)
    h = np.array([[1.1, 0.2, 3], [-0.1, 0.9, 1], [0.01, 0.02, 1]])
    a = r.uniform(0, 10, (20, 2))
    m = np.c_[a, np.ones(20)] @ h.T
    assert vision.homography(a, m[:, :2] / m[:, 2:]) == pytest.approx(h, abs=1e-8)
    _, _, _, p, q = scene()
    f = vision.fundamental(p, q)
    assert vision.epipolar_errors(f, p, q).max() < 1e-9
    assert abs(np.linalg.det(f)) < 1e-12


def test_pose_and_points():
    x, turn, t, p, q = scene()
    r, d, n = vision.best_pose(vision.fundamental(p, q), p, q)
    assert n == len(x) and r == pytest.approx(turn, abs=1e-6) and d == pytest.approx(t / np.linalg.norm(t), abs=1e-6)
    got = vision.triangulate(np.eye(3, 4), np.c_[r, d], p, q)
    assert got * np.linalg.norm(t) == pytest.approx(x, abs=1e-6)
    k = vision.intrinsics(640, 480)
    h1, h2 = vision.rectifying(k, turn, t)
    u, v = (np.c_[z, np.ones(len(z))] @ k.T @ h.T for z, h in ((p, h1), (q, h2)))
    assert (u[:, 1] / u[:, 2]) == pytest.approx(v[:, 1] / v[:, 2], abs=1e-6)


def test_robust_models(spark):
    _, _, _, p, q = scene(3)
    rows = pd.DataFrame(np.c_[p, q], columns=["x1", "y1", "x2", "y2"])
    rows.loc[:14, "x2"] += np.linspace(0.2, 1, 15)
    rows["pair"] = 1
    few = rows.head(5).assign(pair=2)
    got = vision.robust_models(spark.createDataFrame(pd.concat([rows, few])), "pair", "fundamental", 1e-6, 200).collect()
    assert [(r.pair, r.inliers, r.n) for r in got] == [(1, 45, 60)]
    again = vision.robust_models(spark.createDataFrame(rows.sample(frac=1, random_state=1)), "pair", "fundamental", 1e-6, 200).first()
    assert again.m == got[0].m
    flat = vision.robust_models(spark.createDataFrame(rows), "pair", "homography", 0.5, 50, median=True).first()
    assert flat.n == 60


def test_bundle_adjustment(spark):
    r = np.random.default_rng(4)
    cams = np.c_[r.normal(0, 0.05, (3, 3)), r.normal(0, 0.2, (3, 3)), np.full(3, 500.0), np.full(3, 1e-3), np.full(3, 1e-4)]
    points = r.uniform(-1, 1, (8, 3)) - [0, 0, 6]
    seen = [(c, p, *map(float, bundle.project(cams[c : c + 1], points[p : p + 1])[0])) for c in range(3) for p in range(8)]
    obs = spark.createDataFrame(seen, "cam_id int, pt_id int, u double, v double")
    table = lambda x, name, cols: spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], f"{name} int, " + ", ".join(f"{c} double" for c in cols))
    c, p = table(cams, "cam_id", bundle._CAM), table(points, "pt_id", "xyz")
    assert bundle.error(obs, c, p) < 1e-9
    off = table(points + r.normal(0, 0.02, points.shape), "pt_id", "xyz")
    _, _, errors = bundle.adjust(obs, c, off, rounds=4)
    assert all(b < a for a, b in zip(errors, errors[1:])) and errors[-1] < errors[0] / 20
    by_cam, by_point = bundle.jacobians(cams, points[:3])
    eps = 1e-4
    moved = cams.copy()
    moved[:, 4] += eps
    assert (bundle.project(moved, points[:3]) - bundle.project(cams, points[:3])) / eps == pytest.approx(by_cam[:, :, 4], rel=1e-2, abs=1e-2)


def test_labels_and_layouts(spark):
    cells = [("p", m, n, 0.0 if n < 4 else 100.0, 0.0, 0.0, 2 if (m, n) == (3, 1) else 3 if (m, n) == (3, 6) else 0) for m in range(6) for n in range(8)]
    got = propagate.spread_labels(spark.createDataFrame(cells, "pano string, m int, n int, l double, a double, b double, label int"), "pano").collect()
    assert all(r.label == (0 if r.m == 0 else 2 if r.n < 4 else 3) for r in got)
    square = [("a", 0, 0.0, 0.0), ("a", 1, 1.0, 0.0), ("a", 2, 1.0, 1.0), ("a", 3, 0.0, 1.0)]
    bow = [("b", 0, 0.0, 0.0), ("b", 1, 1.0, 1.0), ("b", 2, 1.0, 0.0), ("b", 3, 0.0, 1.0)]
    general = spark.createDataFrame(square + bow, "room string, seq int, x double, y double")
    assert {r.room: r.simple for r in propagate.is_simple(general, "room").collect()} == {"a": True, "b": False}
    cuboid = spark.createDataFrame([("b", k, 9.0, 9.0) for k in range(4)] + [("a", 0, 8.0, 8.0)], general.schema)
    got = propagate.with_fallback(general, cuboid, "room").collect()
    assert {(r.room, r.x) for r in got if r.room == "b"} == {("b", 9.0)} and sum(r.room == "a" for r in got) == 4
    line = spark.createDataFrame([("a", float(k), k * math.tan(0.3)) for k in range(9)], "room string, x double, y double")
    assert propagate.main_direction(line, ["room"]).first().degrees == pytest.approx(math.degrees(0.3))
    walls = propagate.cuboid_walls(spark.createDataFrame([("a", s, float(s + k), float(s - k)) for s in range(4) for k in range(3)], "room string, segment int, x double, y double"), "room")
    assert sorted((r.wall, r.axis, r.at) for r in walls.collect()) == [(0, "y", -1.0), (1, "x", 2.0), (2, "y", 1.0), (3, "x", 4.0)]


def test_models_are_plugged_in(spark):
    image = np.zeros((4, 6, 3), np.uint8)
    image[:, 3:] = 255
    table = spark.createDataFrame([("i", 4, 6, bytearray(image.tobytes()))], "path string, height int, width int, data binary")
    got = infer.labels(table, infer.brightness_prompts).collect()
    assert {(r.col < 3, r.label) for r in got} == {(True, 1), (False, 5)} and len(got) == 24
    assert infer.depths(table, infer.row_depth).where("row = 2").first().d == 1.0


def _peak(call, *given):
    tracemalloc.start()
    try:
        call(*given)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_fundamental_of_many_matches_stays_small():
    _, _, _, p, q = scene(5, 5000)
    assert _peak(vision.fundamental, p, q) < 50  # 5,000 squared doubles are 200 MB
    assert vision.epipolar_errors(vision.fundamental(p, q), p, q).max() < 1e-9


def test_poses_of_many_matches_stay_small():
    _, _, _, p, q = scene(6, 5000)
    k = vision.intrinsics(640, 480)
    a, b = (np.c_[z, np.ones(len(z))] @ k.T for z in (p, q))
    rows = pd.DataFrame(np.c_[a[:, :2], b[:, :2]], columns=["x1", "y1", "x2", "y2"])
    assert _peak(vision._pair_poses, (1,), rows, k, 0.5, 8, 0, False) < 50  # rectified_rows, triangulated_points and two_view_poses start here


def test_homography_of_many_matches_stays_small():
    a = np.random.default_rng(7).uniform(0, 10, (3000, 2))
    m = np.c_[a, np.ones(3000)] @ np.array([[1.1, 0.2, 3], [-0.1, 0.9, 1], [0.01, 0.02, 1]]).T
    b = m[:, :2] / m[:, 2:]
    assert _peak(vision.homography, a, b) < 50  # two rows a match: 6,000 squared doubles are 288 MB
    assert vision.transfer_errors(vision.homography(a, b), a, b).max() < 1e-8
