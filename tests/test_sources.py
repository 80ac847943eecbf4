import json
import zipfile

import numpy as np

from pyspark.sql import functions as F

from planarium.operators import relational
from planarium.sources import files as S

TREE = {
    "merger": {
        "floor_01": {
            "complete_room_07": {
                "vertices": [[0, 0]],
                "partial_room_02": {
                    "pano_5": {
                        "image_path": "panos/a.jpg",
                        "floor_plan_transformation": {"rotation": 30, "translation": [1, 2], "scale": 2.5},
                        "layout_complete": {"vertices": [[0, 0], [4, 0], [4, 3]], "doors": [[0, 0], [1, 0], [9, 9], [2, 0], [3, 0], [9, 9]], "windows": [[0, 0], [1, 1], [2, 2], [3, 3]]},
                    }
                },
            }
        },
        "floor_02": {"complete_room_01": {"partial_room_01": {"pano_5": {"floor_plan_transformation": {"translation": {"x": 7, "y": 8, "z": 9}}}, "pano_6": {}}}},
        "note": 3,
    }
}


def test_panoramas(spark, tmp_path):
    for name in ("0000/panos/floor_01_partial_room_01_pano_1.jpg", "0000/panos/floor_01_partial_room_01_pano_2.jpg", "0000/panos/notes.txt", "0000/panos/x.JPG", "abc/panos/floor_01_partial_room_01_pano_2.jpg", "0001/readme.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    listing = S.files(spark, str(tmp_path))
    assert [r.scene_id for r in S.scenes(listing, 4).collect()] == ["0000", "0001"]
    panos = S.panoramas(listing)
    assert sorted((r.scene_id, r.pano_id) for r in panos.collect()) == [("0000", "1"), ("0000", "2")]
    assert S.images(listing).count() == 3
    index = json.loads(relational.scene_index(panos).first().json)
    assert index["scenes"]["0000"]["01"]["01"] == ["floor_01_partial_room_01_pano_1.jpg", "floor_01_partial_room_01_pano_2.jpg"]
    assert S.manifest(panos, "/sub").first().target.startswith("/sub/0000/panos/floor_01")


def test_arrays_and_archives(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1, 2], [3, np.inf]]))
    np.save(tmp_path / "b.npy", np.arange(3))
    got = S.arrays(S.files(spark, str(tmp_path), "*.npy")).collect()
    assert len(got) == 7 and sum(r.value is None for r in got) == 1
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("d/one.txt", "1")
        z.writestr("d/two.png", "2")
    members = S.archive_members(S.files(spark, str(tmp_path), "*.zip"), r"\.txt$").collect()
    assert [(r.member, bytes(r.content)) for r in members] == [("d/one.txt", b"1")]


def test_text_problems(spark, tmp_path):
    (tmp_path / "p.txt").write_text("\n".join(["2 2 3", "0 0 1.5 2.5", "0 1 3 4", "1 1 5 6", *map(str, range(18)), *map(str, range(100, 106))]) + "\n")
    obs, cams, points = S.bundle_problem(spark, str(tmp_path / "p.txt"))
    assert sorted(map(tuple, obs.collect())) == [(0, 0, 1.5, 2.5), (0, 1, 3.0, 4.0), (1, 1, 5.0, 6.0)]
    assert sorted(map(tuple, cams.collect())) == [(0, *map(float, range(9))), (1, *map(float, range(9, 18)))]
    assert sorted(map(tuple, points.collect())) == [(0, 100.0, 101.0, 102.0), (1, 103.0, 104.0, 105.0)]
    (tmp_path / "c.txt").write_text("1.5 2\n3 4.25\n")
    assert sorted(map(tuple, S.corners(spark, str(tmp_path / "c.txt")).collect())) == [(1.5, 2.0), (3.0, 4.25)]


def test_annotations(spark, tmp_path):
    (tmp_path / "tree.json").write_text(json.dumps(TREE, indent=1))
    tree = S.annotations(spark, str(tmp_path / "tree.json"))
    rows = {(r.floor_id, r.pano_id): r for r in tree.collect()}
    assert set(rows) == {("01", "5"), ("02", "5"), ("02", "6")}
    one, two = rows["01", "5"], rows["02", "5"]
    assert (one.complete_id, one.partial_id, one.image, one.rotation, one.tx, one.ty, one.tz, one.scale) == ("07", "02", "panos/a.jpg", 30, 1, 2, 0, 2.5)
    assert (two.rotation, two.tx, two.ty, two.tz) == (0, 7, 8, 9)
    assert [tuple(r)[2:] for r in S.vertices(tree).orderBy("seq").collect()] == [(0, 0, 0), (1, 4, 0), (2, 4, 3)]
    assert sorted((r.element, r.x0, r.x1) for r in S.elements(tree, "doors").collect()) == [(0, 0, 1), (1, 2, 3)]
    assert S.elements(tree, "windows").count() == 0
    assert S.pano_of(tree, "5").first().floor_id == "01"


def test_plans(spark):
    got = S.floor_plan_points(spark, 3, 5).collect()
    assert len(got) == 30 and {(r.x, r.y) for r in got if r.edge == 3} == {(-3.0, 10 - 1.25 * k) for k in range(5)}
    noisy = S.floor_plan_points(spark, 1, 50, 0.1, 3)
    assert 0.0 < noisy.where("edge = 0").selectExpr("stddev(y)").first()[0] < 0.3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("0000", "1", 1.0)], "scene_id string, pano_id string, x double")
    S.write_points(df, str(tmp_path / "points"))
    assert (tmp_path / "points/scene_id=0000/pano_id=1").is_dir()
    S.write_text(df, str(tmp_path / "text"), "scene_id", "pano_id")
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["0000 1"]


def test_pixels(spark, tmp_path):
    import struct
    import zlib

    raw = b"\x00" + bytes([255, 0, 0, 0, 255, 0])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    assert sorted((r.row, r.col, r.r, r.g, r.b) for r in S.pixels(spark, str(tmp_path)).collect()) == [(0, 0, 255, 0, 0), (0, 1, 0, 255, 0)]


def test_settings():
    text = "model: HoHo  # a name\nlr: 0.1\ndata:\n  size: [4, 5]\n  deep:\n    on: true\n  path: a:b\nlast: \"x # y\"\n"
    got = S.setting(text.replace(' # y', ''), {"data.size": [1], "new.one": 2})
    assert got == {"model": "HoHo", "lr": 0.1, "data": {"size": [1], "deep": {"on": True}, "path": "a:b"}, "last": "x", "new": {"one": 2}}
    assert S.setting("") == {}


def test_files_are_copied(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in (1, 2, 3):
        (tmp_path / f"in/{k}.jpg").write_bytes(bytes([k]) * k)
    listed = S.files(spark, str(tmp_path / "in")).select("path", F.concat(F.lit(f"file://{tmp_path}/out/"), F.regexp_extract("path", r"([^/]+)$", 1)).alias("target"))
    assert sorted(r.length for r in S.copied(listed).collect()) == [1, 2, 3]
    assert (tmp_path / "out/2.jpg").read_bytes() == b"\x02\x02"
