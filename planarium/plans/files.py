"""Queries of sources and sinks: listings made from orders, and small files written to the shared folder and read again."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.numbers import fixed
from ..session import shared_root
from ..sources import files as S
from . import query

_PATH = """'zind/' || CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END || (o_custkey % 2000) || '/panos/floor_0' || (o_orderkey % 3) || '_partial_room_0' || (o_orderkey % 5)
    || '_pano_' || (o_orderkey % 11) || CASE WHEN o_orderkey % 4 = 0 THEN '.png' WHEN o_orderkey % 9 = 0 THEN '.JPG' ELSE '.jpg' END"""
_LISTED = f"l AS (SELECT o_orderkey, {_PATH} AS path FROM orders)"


def listing(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", F.expr(_PATH).alias("path"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/planarium/{name}-{uuid.uuid4().hex}"


def _put(spark: SparkSession, folder: str, contents: dict[str, bytes]) -> str:
    """Write small files through the store that Spark uses."""
    sc = spark.sparkContext
    for name, data in contents.items():
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(data))
        out.close()
    return folder


@query(f"WITH {_LISTED}, s AS (SELECT DISTINCT unnest(string_split(path, '/')) AS scene_id FROM l) SELECT scene_id, length(scene_id) = 4 AS four FROM s WHERE regexp_full_match(scene_id, '[0-9]+')")
def list_scenes(orders: DataFrame) -> DataFrame:
    every, four = S.scenes(listing(orders)), S.scenes(listing(orders), 4).withColumn("four", F.lit(True))
    return every.join(four, "scene_id", "left").select("scene_id", F.coalesce("four", F.lit(False)).alias("four"))


@query(rf"""
    WITH {_LISTED}, p AS (SELECT string_split(path, '/') AS p, path FROM l),
    f AS (SELECT p[2] AS scene_id, p[4] AS file, path, regexp_extract(p[4], '^floor_(\d+)_partial_room_(\d+)_pano_(\d+)\.jpg$', ['f', 'r', 'n']) AS m FROM p)
    SELECT scene_id, file, m.f AS floor_id, m.r AS room_id, m.n AS pano_id, path FROM f WHERE m.n <> '' AND regexp_full_match(scene_id, '[0-9]+')
""")
def list_panoramas(orders: DataFrame) -> DataFrame:
    found = S.panoramas(listing(orders).select("path"))
    return found.select("scene_id", "file", *(F.col(c).cast("string").alias(c) for c in ("floor_id", "room_id", "pano_id")), "path")


@query(f"WITH {_LISTED} SELECT o_orderkey, path FROM l WHERE suffix(path, '.jpg') OR suffix(path, '.png')")
def list_images(orders: DataFrame) -> DataFrame:
    return S.images(listing(orders)).select("o_orderkey", "path")


@query("SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS name")
def glob_files(spark: SparkSession, folder: str) -> DataFrame:
    """The tables that lie in the folder, by a listing that reads no file."""
    return S.files(spark, folder, "*.parquet").select(F.regexp_extract("path", r"([^/]+)\.parquet", 1).alias("name")).distinct()


@query("SELECT 'k' || c_nationkey AS path, c_custkey % 5 AS pano, arg_min(c_custkey, c_custkey)::BIGINT AS place FROM customer WHERE c_custkey % 5 = 2 GROUP BY ALL")
def pano_lookup(customer: DataFrame) -> DataFrame:
    """The first panorama 2 of each nation's tree, in the order of floors and rooms."""
    key = F.col("c_custkey")
    step = lambda n, w: F.lpad(F.expr(f"c_custkey div {n} % 1000").cast("string"), w, "0")
    tree = customer.select(F.concat(F.lit("k"), "c_nationkey").alias("path"), (key % 5).alias("pano_id"), step(1_000_000, 3).alias("floor_id"), step(1000, 3).alias("complete_id"), step(1, 3).alias("partial_id"), key.cast("long").alias("place"))
    return S.pano_of(tree, F.lit(2)).select("path", F.col("pano_id").alias("pano"), "place")


@query("SELECT * FROM (VALUES ('a.npy', 0, 0, 1.5), ('a.npy', 0, 1, 2.0), ('a.npy', 1, 0, NULL), ('a.npy', 1, 1, 4.0), ('b.npy', 0, 0, 7.0), ('b.npy', 1, 0, 8.0), ('b.npy', 2, 0, 9.0)) AS t(name, row_, col_, value)".replace("1.5)", "1.5::DOUBLE)"))
def read_arrays(spark: SparkSession) -> DataFrame:
    def packed(x: np.ndarray) -> bytes:
        np.save(out := io.BytesIO(), x)
        return out.getvalue()

    folder = _put(spark, _folder(spark, "arrays"), {"a.npy": packed(np.array([[1.5, 2.0], [np.nan, 4.0]])), "b.npy": packed(np.array([7, 8, 9]))})
    return S.arrays(S.files(spark, folder, "*.npy")).select(paths.basename(F.col("path")).alias("name"), F.col("row").alias("row_"), F.col("col").alias("col_"), "value")


@query("SELECT * FROM (VALUES (0, 0, 1.0, 2.0, 6.0, 100.0), (0, 1, 3.0, 4.0, 6.0, 103.0), (1, 1, 5.0, 6.0, 15.0, 103.0), (1, 2, 7.0, 8.0, 15.0, 106.0)) AS t(cam_id, pt_id, u, v, f, x)".replace("(0, 0, 1.0, 2.0, 6.0, 100.0)", "(0, 0, 1.0::DOUBLE, 2.0::DOUBLE, 6.0::DOUBLE, 100.0::DOUBLE)"))
def read_bundle(spark: SparkSession) -> DataFrame:
    text = "2 3 4\n0 0 1.0 2.0\n0 1 3.0 4.0\n1 1 5.0 6.0\n1 2 7.0 8.0\n" + "".join(f"{k}.0\n" for k in range(18)) + "".join(f"{100 + k}.0\n" for k in range(9))
    obs, cams, points = S.bundle_problem(spark, _put(spark, _folder(spark, "bundle"), {"p.txt": text.encode()}) + "/p.txt")
    return obs.join(cams.select("cam_id", "f"), "cam_id").join(points.select("pt_id", "x"), "pt_id").select("cam_id", "pt_id", "u", "v", "f", "x")


@query("SELECT * FROM (VALUES (1.5::DOUBLE, 2.0::DOUBLE), (3.0, 4.25), (-7.0, 0.5)) AS t(x, y)")
def read_corners(spark: SparkSession) -> DataFrame:
    return S.corners(spark, _put(spark, _folder(spark, "corners"), {"c.txt": b"1.5 2\n3 4.25\n\n-7 0.5\n"}) + "/c.txt")


@query("SELECT * FROM (VALUES ('one.zip', 'scene/2d/a.png', 'AA'), ('two.zip', '2d/c.png', 'C')) AS t(name, member, content)")
def read_archives(spark: SparkSession) -> DataFrame:
    def packed(members: dict[str, str]) -> bytes:
        with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
            for name, data in members.items():
                z.writestr(name, data)
        return out.getvalue()

    folder = _put(spark, _folder(spark, "archives"), {"one.zip": packed({"scene/2d/a.png": "AA", "scene/3d/b.png": "B"}), "two.zip": packed({"2d/c.png": "C", "2d/": ""})})
    found = S.archive_members(S.files(spark, folder, "*.zip"), r"2d/.*\.png$")
    return found.select(paths.basename(F.col("path")).alias("name"), "member", F.col("content").cast("string").alias("content"))


def _png(height: int, width: int, kind: int, values: list[int]) -> bytes:
    """A PNG of 8 bits a channel: kind 0 is grey, 2 colour, 6 colour with a fourth channel."""
    step = len(values) // height
    raw = b"".join(b"\x00" + bytes(values[k * step : (k + 1) * step]) for k in range(height))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@query("""
    SELECT * FROM (VALUES ('c.png', 0, 0, 255, 10, 0, 82.115::DOUBLE), ('c.png', 0, 1, 1, 2, 3, 1.815), ('f.png', 0, 0, 9, 8, 7, 8.185), ('f.png', 1, 0, 200, 100, 50, 124.2),
        ('g.png', 0, 0, 0, 0, 0, 0.0), ('g.png', 0, 1, 128, 128, 128, 128.0), ('g.png', 0, 2, 255, 255, 255, 255.0), ('none.png', NULL, NULL, NULL, NULL, NULL, NULL)) AS t(name, row_, col_, r, g, b, grey)
""")
def decode_images(spark: SparkSession) -> DataFrame:
    """Pixels of a colour, a four-channel and a grey image, and of a file that is none."""
    images = {"c.png": _png(1, 2, 2, [255, 10, 0, 1, 2, 3]), "f.png": _png(2, 1, 6, [9, 8, 7, 0, 200, 100, 50, 255]), "g.png": _png(1, 3, 0, [0, 128, 255]), "none.png": b"no image"}
    found = S.pixels(spark, _put(spark, _folder(spark, "images"), images))
    return found.select(paths.basename(F.col("path")).alias("name"), F.col("row").alias("row_"), F.col("col").alias("col_"), "r", "g", "b", fixed("grey").alias("grey"))


@query("""
    WITH p(edge, ax, ay, cx, cy) AS (VALUES (0, 0, 0, 10, 0), (1, 10, 0, 10, 10), (2, 10, 10, -3, 10), (3, -3, 10, -3, 5), (4, -3, 5, 0, 5), (5, 0, 5, 0, 0))
    SELECT edge, i::INTEGER AS i, floor((ax + (cx - ax) * (i / 4)) * 10000 + 0.5) / 10000 AS x, floor((ay + (cy - ay) * (i / 4)) * 10000 + 0.5) / 10000 AS y FROM p, range(5) AS t(i)
""")
def plan_points(spark: SparkSession) -> DataFrame:
    return S.floor_plan_points(spark, 3, 5).select("edge", "i", fixed("x").alias("x"), fixed("y").alias("y"))


@query("SELECT p_brand AS scene_id, p_partkey % 3 AS pano_id, count(*) AS n, floor(sum(p_retailprice) * 100 + 0.5) / 100 AS total FROM part GROUP BY ALL")
def points_sink(part: DataFrame) -> DataFrame:
    """Point clouds written by scene and panorama, and read back."""
    spark = part.sparkSession
    folder = _folder(spark, "points")
    S.write_points(part.select(F.col("p_brand").alias("scene_id"), (F.col("p_partkey") % 3).alias("pano_id"), F.col("p_retailprice").alias("x")), folder)
    found = spark.read.schema("x double, scene_id string, pano_id long").parquet(folder)
    return found.groupBy("scene_id", "pano_id").agg(F.count("*").alias("n"), fixed(F.sum("x"), 2).alias("total"))


@query(f"WITH {_LISTED} SELECT replace(path, '.', '_layout.') || ' ' || path AS line, CASE WHEN o_custkey % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM l JOIN orders USING (o_orderkey) WHERE o_orderkey % 3 = 0")
def pair_list_sink(orders: DataFrame) -> DataFrame:
    """Lists of layout and image by split, written as text and read back."""
    spark, out = orders.sparkSession, None
    rows = orders.where("o_orderkey % 3 = 0").select(F.expr(_PATH).alias("path"), (F.col("o_custkey") % 10 < 8).alias("train")).withColumn("layout", F.replace("path", F.lit("."), F.lit("_layout.")))
    for name, own in (("train", rows.where("train")), ("test", rows.where("not train"))):
        folder = _folder(spark, name)
        S.write_text(own, folder, "layout", "path")
        lines = spark.read.text(folder).select(F.col("value").alias("line"), F.lit(name).alias("split"))
        out = lines if out is None else out.union(lines)
    return out


@query("SELECT p_partkey // 2000 AS pano, p_partkey % 2000 // 50 AS row_, p_partkey % 50 AS col_, p_retailprice AS value FROM part")
def array_sink(part: DataFrame) -> DataFrame:
    """Grids written as `.npy` files, one a panorama, and read back."""
    from .rasters import panos

    spark = part.sparkSession
    folder = _folder(spark, "grids")
    S.write_arrays(panos(part).select("pano", "row", "col", F.col("v").alias("value")), ["pano"], folder).write.format("noop").mode("overwrite").save()
    found = S.arrays(S.files(spark, folder, "*.npy")).where("value is not null")
    return found.select(F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("long").alias("pano"), F.col("row").cast("long").alias("row_"), F.col("col").cast("long").alias("col_"), "value")


@query("SELECT n_name AS name, n_regionkey AS region, 1 AS times FROM nation")
def cached_table(nation: DataFrame) -> DataFrame:
    """A table made once and read from its cache after that."""
    spark, made = nation.sparkSession, []
    folder = _folder(spark, "cache")

    def make() -> DataFrame:
        made.append(1)
        return nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))

    S.cached(spark, folder, make)
    return S.cached(spark, folder, make).withColumn("times", F.lit(len(made)))
