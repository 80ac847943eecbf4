import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planarium.functions import geometry as G
from planarium.functions import paths
from planarium.operators import evaluate, fitting, graphs, layout, lines, matching, raster, relational, sequences


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_pano_files(spark):
    names = ["floor_01_partial_room_02_pano_3.jpg", "x.JPG", "notes.txt", "floor_01_partial_room_02_pano_3.jpg.bak"]
    df = spark.createDataFrame([(n,) for n in names], "file string")
    got = df.select(*paths.pano_ids(F.col("file")), paths.room_of(F.col("file")).alias("room"), paths.after_token(F.regexp_replace("file", r"\.jpg.*", ""), "pano").alias("pano")).collect()
    assert tuple(got[0]) == ("01", "02", "3", "02", "3")
    assert tuple(got[1]) == (None, None, None, None, None)
    assert one(spark, a=paths.key_suffix(F.lit("complete_room_07")), b=paths.key_suffix(F.lit("merger")), c=paths.stem(F.lit("/a/b/c.d.jpg")), d=paths.scene_name(F.lit(7))) == ("07", "00", "c.d", "scene_00007")
    assert [r[0] for r in spark.createDataFrame([("0001",), ("12",), ("abc",)], "n string").where(paths.is_scene(F.col("n"))).collect()] == ["0001", "12"]
    split = spark.createDataFrame([(2999,), (3000,), (3249,), (3250,)], "n int").select(paths.split_of(F.col("n"))).collect()
    assert [r[0] for r in split] == ["train", "valid", "valid", "test"]


def test_catalogue(spark):
    rows = [("0000", "01", r, f"p{r}{k}") for r, n in (("01", 2), ("02", 3)) for k in range(n)] + [("0000", "02", "01", "a"), ("0000", "02", "01", "b"), ("0000", "02", "03", "c")]
    panos = spark.createDataFrame(rows, "scene_id string, floor_id string, room_id string, file string")
    assert relational.groups_with_many(panos, ["scene_id", "floor_id", "room_id"]).count() == 3
    whole = {r.floor_id: r.complete for r in relational.all_members_have_many(panos, ["scene_id", "floor_id"], ["room_id"]).collect()}
    assert whole == {"01": True, "02": False}
    assert relational.scene_index(panos).first().json.startswith('{"total_scenes":1,"total_included_floors":2,"scenes":{"0000":{"01":{"01":["p010","p011"]')
    assert relational.scene_index(panos.limit(0)).first().json == '{"total_scenes":0,"total_included_floors":0,"scenes":{}}'
    with pytest.raises(Exception, match="missing"):
        relational.must_be_empty(panos, "missing").collect()


def test_projection_and_crossing(spark):
    x, y, d = G.clamped_projection(*lit(3, 4, 0, 0, 2, 0))
    assert one(spark, x=x, y=y, d=d) == (2.0, 0.0, math.sqrt(17))
    x, y = G.crossing(*lit(0, 0, 1, 1, 0, 2, 1, 1))
    assert one(spark, x=x, y=y) == (1.0, 1.0)
    assert one(spark, x=G.crossing(*lit(0, 0, 1, 1, 0, 1, 1, 2))[0])[0] is None
    assert one(spark, s=G.similarity(*lit(0, 0, 1, 0, 0, 0, 0, 2)), m=G.mirrored_similarity(*lit(0, 0, 2, 1, 0, 0, 2, -1))) == (0.0, pytest.approx(1.0))
    ends = G.line_box(*lit(1, 1, 1, 0, 0, 0, 4, 2))
    assert tuple(one(spark, **{f"c{k}": e for k, e in enumerate(ends)})) == (0.0, 1.0, 4.0, 1.0)


def test_sphere_round_trips(spark):
    r = np.random.default_rng(0)
    for x, y, z in r.normal(size=(10, 3)):
        n = math.sqrt(x * x + y * y + z * z)
        u, v = G.c2_pixel(*lit(x, y, z), 256, 512)
        assert tuple(one(spark, **dict(zip("xyz", G.c2_ray(u, v, 256, 512))))) == pytest.approx((x / n, y / n, z / n))
        for plane in (1, 2, 3):
            u, v = G.c3_uv(*lit(x, y, z), F.lit(plane))
            assert tuple(one(spark, **dict(zip("xyz", G.c3_xyz(u, v, F.lit(plane)))))) == pytest.approx((x / n, y / n, z / n))
        q = r.normal(size=4)
        q /= np.linalg.norm(q)
        e = np.array([[0, -q[3], q[2]], [q[3], 0, -q[1]], [-q[2], q[1], 0]])
        m = (2 * q[0] ** 2 - 1) * np.eye(3) + 2 * np.outer(q[1:], q[1:]) - 2 * q[0] * e
        assert tuple(one(spark, **dict(zip("xyz", G.rotated(tuple(lit(*q)), tuple(lit(x, y, z))))))) == pytest.approx(m @ [x, y, z])


def test_sequences(spark):
    bins = spark.createDataFrame([("a", b, float(b)) for b in (1, 2, 6, 20)], "k string, bin long, v double")
    filled = sorted(sequences.fill_gaps(bins, ["k"], ["v"], 5).select("bin", "v").collect())
    assert [tuple(r) for r in filled] == [(b, float(b)) for b in (1, 2, 3, 4, 5, 6, 20)]
    r = np.random.default_rng(1)
    values = r.normal(size=9)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "k string, i int, v double")
    got = [x.smooth for x in sequences.moving_average(df, ["k"], "i", "v", 5).orderBy("i").collect()]
    assert got == pytest.approx(np.convolve(np.pad(values, 2, "edge"), np.ones(5) / 5, "valid"))
    ring = spark.createDataFrame([("a", i, v) for i, v in enumerate([5, 1, 0, 2, 0, 1, 4, 5])], "k string, i int, v int")
    assert [x.i for x in sequences.circular_peaks(ring, ["k"], "i", "v", 8, 2).orderBy("i").collect()] == [0, 3, 7]
    rooms = spark.createDataFrame([("f", k, w, h) for k, (w, h) in enumerate([(3.0, 2.0), (3.0, 1.0), (2.0, 2.0), (1.0, 1.0)])], "f string, id int, w double, h double")
    packed = {x.name: (x.x, x.y) for x in sequences.shelf_pack(rooms, ["f"], ["id"], "w", "h", "id").collect()}
    assert packed == {0: (0.0, 0.0), 1: (0.0, 2.0), 2: (0.0, 3.0), 3: (2.0, 3.0)}


def test_band_join_is_naive_join(spark):
    r = np.random.default_rng(2)
    a = spark.createDataFrame([(int(k % 3), i, float(v)) for i, (k, v) in enumerate(zip(r.integers(0, 9, 80), r.normal(0, 3, 80)))], "k int, a int, x double")
    b = a.select("k", F.col("a").alias("b"), F.col("x").alias("y"))
    naive = a.join(b, "k").where("abs(x - y) <= 0.7").select("a", "b")
    got = matching.band_join(a, b, ["k"], "x", "y", 0.7).select("a", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, naive.collect()))


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {x.node: x.root for x in graphs.connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert graphs.connected_components(edges.limit(0)).count() == 0


def test_rectangles_and_overlap():
    r = np.random.default_rng(3)
    for angle in r.uniform(0, 3, 8):
        turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
        inside = np.r_[r.uniform(0, 1, (50, 2)), [[0, 0], [1, 0], [1, 1], [0, 1]]] * [4, 3] @ turn.T
        corners, area = layout.least_rectangle(inside)
        assert area == pytest.approx(12) and layout.area(corners) == pytest.approx(12)
    box = np.array([[0, 0], [2, 0], [2, 1], [0, 1]], float)
    assert layout.overlap(box, box) == pytest.approx(1)
    assert layout.overlap(box, box / [2, 1]) == pytest.approx(0.5)
    assert layout.overlap(box, box + 9) == 0
    assert len(layout.hull(np.array([[0, 0], [1, 1], [2, 2]], float))) == 2
    assert layout.least_rectangle(np.array([[1.0, 2.0]]))[1] == 0


def test_corner_scores(spark):
    schema = "room int, id int, x double, y double"
    truth = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])], schema)
    s = evaluate.corner_scores(truth, truth, ["room"], 0.02).first()
    assert (s.precision_, s.recall_, s.f) == (1, 1, 1)
    twice = truth.union(truth.withColumn("id", F.col("id") + 10))
    s = evaluate.corner_scores(twice, truth, ["room"], 0.02).first()
    assert (s.precision_, s.recall_) == (0.5, 1)
    moved = truth.withColumn("x", F.col("x") + 5)
    assert evaluate.corner_scores(evaluate.to_truth_centre(moved, truth, ["room"]), truth, ["room"], 0.02).first().f == 1
    assert evaluate.corner_scores(moved, truth, ["room"], 0.02).first().f == 0


def test_histogram_and_line(spark):
    flat = spark.createDataFrame([("a", float(v)) for v in range(100)], "k string, v double")
    bins = fitting.histogram(flat, ["k"], "v", 10)
    assert [x.n for x in bins.orderBy("bin").collect()] == [10] * 10
    assert fitting.uniformity(bins, ["k"]).first().uniformity == pytest.approx(0.1)
    points = spark.createDataFrame([("a", i, float(i), 2.0 * i) for i in range(10)] + [("a", 50 + i, float(i * i), 40.0 - i) for i in range(4)], "k string, id int, x double, y double")
    got = fitting.best_line(points, ["k"], "id", "x", "y", 1e-6).first()
    assert (got.i, got.j) == (0, 1) and got.inliers >= 10
    found = fitting.extract_lines(points, ["k"], "id", "x", "y", 1e-6, 2).orderBy("round").collect()
    assert len(found) == 2 and found[1].i >= 50


def test_sphere_directions():
    assert len(lines.icosahedron(0)) == 12
    assert len(lines.icosahedron(2)) == 162


def test_raster(spark):
    image = raster.grid(spark, 8, 8).withColumn("v", F.col("row") * 8 + F.col("col"))
    samples = spark.createDataFrame([(0, 1.5, 2.25), (1, -1.0, 0.0), (2, 7.5, 7.5)], "id int, sx double, sy double")
    got = {x.id: x.v for x in raster.bilinear(samples, image, [], "v", 8, 8).collect()}
    assert got == {0: pytest.approx(2.25 * 8 + 1.5), 1: 0.0, 2: 63.0}
    two = raster.grid(spark, 16, 16).select("row", "col", *(F.when(F.col("col") < 8, 0.0).otherwise(100.0).alias(c) for c in ("l", "a", "b")))
    sp = raster.slic(two, [], 16, 4, 3, 1.0)
    sides = sp.where("sp > 0").groupBy("sp").agg(F.min("col").alias("lo"), F.max("col").alias("hi")).collect()
    assert all(s.hi < 8 or s.lo >= 8 for s in sides)
    ones = raster.grid(spark, 176 + 160, 512).withColumn("d", F.lit(1.0))
    points = raster.cloud(ones, 336, 512)
    assert points.count() == 88 * 256
    assert points.where("abs(x * x + y * y + z * z - 1) > 1e-9").count() == 0


def test_streaming_counts(spark, tmp_path):
    from planarium.streaming import windows

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = windows.arriving(spark, str(tmp_path / "in"), events.schema, 2)
    q = windows.counts(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.counts(events, "1 day").select("start", "event_type", "n")
    got = spark.table("daily").select("start", "event_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert windows.sessions(events, "2 hours").agg(F.sum("n")).first()[0] == events.count()
