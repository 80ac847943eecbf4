"""Queries of views and pairs of views: resampled panoramas, poses from matches, depths, rows that match."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numbers import fixed
from ..operators import raster as R
from ..operators import vision
from . import query
from .rasters import _PANO, _PI, _f, panos

_HEIGHT, _WIDTH = 40, 50


def _image(part: DataFrame) -> DataFrame:
    return panos(part).select("pano", "row", "col", F.col("s").cast("double").alias("value"))


def _sampled(coordinates: str, wrap: bool = True) -> str:
    """SQL that takes q (pano, row_, col_, sx, sy) to values by four lookups; the given CTEs make q."""
    x1 = f"(x0 + 1) % {_WIDTH}" if wrap else f"least(x0 + 1, {_WIDTH - 1})"
    ring = f"((sx % {_WIDTH}) + {_WIDTH}) % {_WIDTH} AS sx, greatest(0.0, least({_HEIGHT - 1}.0, sy)) AS sy" if wrap else "sx, sy"
    inside = "" if wrap else f" WHERE sx >= 0 AND sx < {_WIDTH} AND sy >= 0 AND sy < {_HEIGHT}"
    return f"""WITH {_PANO}, k AS (SELECT DISTINCT pano FROM g), {coordinates},
        w AS (SELECT pano, row_, col_, {ring} FROM q), z AS (SELECT *, floor(sx)::BIGINT AS x0, floor(sy)::BIGINT AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM w{inside}),
        c AS (SELECT pano, row_, col_, x0 AS x, y0 AS y, (1 - fx) * (1 - fy) AS t FROM z UNION ALL SELECT pano, row_, col_, {x1}, y0, fx * (1 - fy) FROM z
            UNION ALL SELECT pano, row_, col_, x0, least(y0 + 1, {_HEIGHT - 1}), (1 - fx) * fy FROM z UNION ALL SELECT pano, row_, col_, {x1}, least(y0 + 1, {_HEIGHT - 1}), fx * fy FROM z),
        v AS (SELECT c.pano, row_, col_, sum(t * s) AS value FROM c JOIN g ON g.pano = c.pano AND g.r = c.y AND g.c = c.x GROUP BY ALL)
        SELECT q.pano, q.row_::INTEGER AS row_, q.col_::INTEGER AS col_, {_f("coalesce(value, 0)", 3)} AS value FROM q LEFT JOIN v USING (pano, row_, col_)"""


def _out(found: DataFrame) -> DataFrame:
    return found.select("pano", F.col("row").alias("row_"), F.col("col").alias("col_"), fixed("value", 3).alias("value"))


_RAY = f"""i AS (SELECT pano, i // {_WIDTH} AS row_, i % {_WIDTH} AS col_ FROM k, range({_HEIGHT * _WIDTH}) AS t(i)),
    a AS (SELECT *, ((col_ + 0.5::DOUBLE) / {_WIDTH} * 2 - 1) * {_PI} AS lon, (0.5 - (row_ + 0.5::DOUBLE) / {_HEIGHT}) * {_PI} AS lat FROM i),
    r AS (SELECT *, cos(lat) * sin(lon) AS x, sin(lat) AS y, cos(lat) * cos(lon) AS z FROM a)"""
_PLACE = f"(atan2(x, z) / {_PI} + 1) / 2 * {_WIDTH} - 0.5 AS sx, (0.5 - asin(y / sqrt(x * x + y * y + z * z)) / {_PI}) * {_HEIGHT} - 0.5 AS sy"


@query(_sampled(f"""i AS (SELECT pano, i // 8 AS row_, i % 8 AS col_ FROM k, range(48) AS t(i)),
    d AS (SELECT pano, row_, col_, col_ - 3.5::DOUBLE AS x, -(row_ - 2.5::DOUBLE) AS y, 4 / tan(40 * {_PI} / 180) AS z, radians(33.0 + pano) AS b, radians(10.0) AS a FROM i),
    e AS (SELECT *, y * cos(a) + z * sin(a) AS y2, -y * sin(a) + z * cos(a) AS z2 FROM d),
    f AS (SELECT pano, row_, col_, x * cos(b) + z2 * sin(b) AS x, y2 AS y, -x * sin(b) + z2 * cos(b) AS z FROM e),
    q AS (SELECT pano, row_, col_, (atan2(x, z) / {_PI} + 1) / 2 * {_WIDTH} AS sx, (0.5 - asin(y / sqrt(x * x + y * y + z * z)) / {_PI}) * {_HEIGHT} AS sy FROM f)"""))
def perspective_views(part: DataFrame) -> DataFrame:
    """A view of six by eight pixels out of each panorama, in a direction of its own."""
    return _out(R.perspective_view(_image(part), ["pano"], "value", _HEIGHT, _WIDTH, (6, 8), 80.0, F.col("pano") + 33.0, F.lit(10.0)))


_C, _S = math.cos(0.4), math.sin(0.4)


@query(_sampled(f"{_RAY}, t AS (SELECT pano, row_, col_, x, {_C!r} * y - {_S!r} * z AS y, {_S!r} * y + {_C!r} * z AS z FROM r), q AS (SELECT pano, row_, col_, {_PLACE} FROM t)"))
def rotated_panoramas(part: DataFrame) -> DataFrame:
    return _out(R.rotated_panorama(_image(part), ["pano"], "value", _HEIGHT, _WIDTH, [1.0, 0.0, 0.0, 0.0, _C, -_S, 0.0, _S, _C]))


@query(_sampled(f"{_RAY}, t AS (SELECT pano, row_, col_, x / 1.7 AS x, y, z / 0.8 AS z FROM r), q AS (SELECT pano, row_, col_, {_PLACE} FROM t)"))
def stretched_panoramas(part: DataFrame) -> DataFrame:
    return _out(R.stretched_panorama(_image(part), ["pano"], "value", _HEIGHT, _WIDTH, 1.7, 0.8))


@query(_sampled(f"""i AS (SELECT pano, i // {_WIDTH} AS row_, i % {_WIDTH} AS col_ FROM k, range({_HEIGHT * _WIDTH}) AS t(i)),
    q AS (SELECT pano, row_, col_, (1.13::DOUBLE * col_ + 0.21 * row_ - 3.3) / (0.001::DOUBLE * col_ + 0.002 * row_ + 1) AS sx, (-0.11::DOUBLE * col_ + 0.93 * row_ + 4.1) / (0.001::DOUBLE * col_ + 0.002 * row_ + 1) AS sy FROM i)""", wrap=False))
def warped_images(part: DataFrame) -> DataFrame:
    return _out(R.warped(_image(part), ["pano"], "value", _HEIGHT, _WIDTH, [1.13, 0.21, -3.3, -0.11, 0.93, 4.1, 0.001, 0.002, 1.0]))


@query(f"""
    WITH w AS (SELECT (-180 + 30 * k)::DOUBLE AS yaw, 0.0::DOUBLE AS pitch FROM range(12) AS t(k) UNION ALL SELECT (-180 + 60 * k)::DOUBLE, p::DOUBLE FROM range(6) AS t(k), (VALUES (45), (-45)) AS s(p) UNION ALL VALUES (0.0, 90.0), (0.0, -90.0)),
    d AS (SELECT yaw, pitch, i // 3 AS row_, i % 3 AS col_, (i % 3 - 1 + 0.25)::DOUBLE AS x, -(i // 3 - 1 + 0.25)::DOUBLE AS y, 1.5 / tan(30 * {_PI} / 180) AS z FROM w, range(9) AS t(i)),
    e AS (SELECT *, y * cos(radians(pitch)) + z * sin(radians(pitch)) AS y2, -y * sin(radians(pitch)) + z * cos(radians(pitch)) AS z2 FROM d),
    f AS (SELECT *, x * cos(radians(yaw)) + z2 * sin(radians(yaw)) AS x3, -x * sin(radians(yaw)) + z2 * cos(radians(yaw)) AS z3 FROM e)
    SELECT yaw, pitch, row_::INTEGER AS row_, col_::INTEGER AS col_, {_f("(0.5 - asin(y2 / sqrt(x3 * x3 + y2 * y2 + z3 * z3)) / " + _PI + ") * 512", 3)} AS v, {_f("x3", 3)} AS x FROM f
""")
def tangent_views(spark: SparkSession) -> DataFrame:
    """Where the pixels of the 26 crops that cover a sphere lie: their latitude on the panorama, and their ray's x."""
    views = spark.createDataFrame(G.look_at_views(), "yaw double, pitch double").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8))))
    views = views.withColumn("row_", F.expr("i div 3").cast("int")).withColumn("col_", (F.col("i") % 3).cast("int"))
    ray = G.perspective_ray(F.col("col_") + 0.25, F.col("row_") + 0.25, 3, 3, 60.0, F.col("yaw"), F.col("pitch"))
    return views.select("yaw", "pitch", "row_", "col_", fixed(G.c2_pixel(*ray, 512, 1024)[1], 3).alias("v"), fixed(ray[0], 3).alias("x"))


_CAMERA = vision.intrinsics(640, 480)
_TURN = 0.1


def _points() -> tuple[str, str, str]:
    """The coordinates of a part as a point before two cameras; whole steps, so that estimates round to them."""
    return "p_size / 10.0 - 2.5", "p_partkey % 13 / 4.0 - 1.5", "6.0 + p_partkey % 17 / 10.0"


def _matches(part: DataFrame) -> DataFrame:
    """Each fifth of the parts seen by a camera at the origin, and by one that has turned by 0.1 and moved by (0.8, 0, 0.6)."""
    x, y, z = (F.expr(e).cast("double") for e in _points())
    f, g, u, v = (float(_CAMERA[i, j]) for i, j in ((0, 0), (1, 1), (0, 2), (1, 2)))
    c, s = math.cos(_TURN), math.sin(_TURN)
    x2, z2 = c * x + s * z + 0.8, -s * x + c * z + 0.6
    return part.select((F.col("p_partkey") % 5).alias("pair"), "p_partkey", (f * x / z + u).alias("x1"), (g * y / z + v).alias("y1"), (f * x2 / z2 + u).alias("x2"), (g * y / z2 + v).alias("y2"))


def _found(part: DataFrame) -> DataFrame:
    return vision.best_poses(vision.pose_hypotheses(_matches(part), "pair", _CAMERA, 0.5, 64), "pair")


@query(f"""
    WITH n AS (SELECT p_partkey % 5 AS pair, count(*) AS n FROM part GROUP BY ALL)
    SELECT pair, n, n AS inliers, n AS front, {_f("cos(0.1)", 3)} AS r00, {_f("sin(0.1)", 3)} AS r02, 0.0::DOUBLE AS r01, 0.8::DOUBLE AS tx, 0.6::DOUBLE AS tz FROM n
""")
def two_view_poses(part: DataFrame) -> DataFrame:
    """From matches to the fundamental and essential matrices, four poses, and the one with all points in front."""
    near = lambda c: fixed(c, 3) + F.lit(0.0)
    return _found(part).select("pair", "n", "inliers", "front", near(F.col("r")[0]).alias("r00"), near(F.col("r")[2]).alias("r02"), near(F.col("r")[1]).alias("r01"), near(F.col("t")[0]).alias("tx"), near(F.col("t")[2]).alias("tz"))


@query("""
    WITH n AS (SELECT p_partkey % 5 AS pair, count(*) AS n FROM part GROUP BY ALL) SELECT pair, k::INTEGER AS place, CASE WHEN k = 0 THEN n ELSE 0 END AS behind_all FROM n, range(2) AS t(k)
""")
def pose_counts(part: DataFrame) -> DataFrame:
    """Of the four poses one has all points in front of both cameras, and one, its mirror, none."""
    found = vision.pose_hypotheses(_matches(part), "pair", _CAMERA, 0.5, 64)
    ends = found.groupBy("pair").agg(F.max("front").alias("most"), F.min("front").alias("least"))
    return ends.select("pair", F.posexplode(F.array("most", "least")).alias("place", "behind_all"))


@query("SELECT p_partkey % 5 AS pair, p_partkey, floor((p_size / 10.0 - 2.5) * 100 + 0.5) / 100 AS x, floor((p_partkey % 13 / 4.0 - 1.5) * 100 + 0.5) / 100 AS y, floor((6.0 + p_partkey % 17 / 10.0) * 100 + 0.5) / 100 AS z, true AS front FROM part")
def triangulated_points(part: DataFrame) -> DataFrame:
    matches = _matches(part)
    found = vision.triangulated(matches, _found(part), "pair", _CAMERA)
    near = lambda c: (fixed(c, 2) + F.lit(0.0)).alias(c)
    return found.select("pair", "p_partkey", near("x"), near("y"), near("z"), ((F.col("z") > 0) & (F.col("z2") > 0)).alias("front"))


@query("SELECT p_partkey % 5 AS pair, count(*) AS n, 0.0::DOUBLE AS apart FROM part GROUP BY ALL")
def rectified_rows(part: DataFrame) -> DataFrame:
    """After rectification partners lie in one row."""
    matches, turned = _matches(part), vision.rectifications(_found(part), "pair", _CAMERA)
    met = matches.join(turned, "pair")
    row = lambda h, k: (F.col(h)[3] * F.col(f"x{k}") + F.col(h)[4] * F.col(f"y{k}") + F.col(h)[5]) / (F.col(h)[6] * F.col(f"x{k}") + F.col(h)[7] * F.col(f"y{k}") + F.col(h)[8])
    return met.groupBy("pair").agg(F.count("*").alias("n"), fixed(F.max(F.abs(row("h1", 1) - row("h2", 2))), 2).alias("apart"))


@query(f"""
    SELECT c_custkey, {_f("cos(radians(c_acctbal / 50)) * 2 - sin(radians(c_acctbal / 50)) * (c_custkey % 7)")} AS x, {_f("sin(radians(c_acctbal / 50)) * 2 + cos(radians(c_acctbal / 50)) * (c_custkey % 7)")} AS y, 1.5::DOUBLE AS z FROM customer
""")
def heading_turn(customer: DataFrame) -> DataFrame:
    x, y, z = G.heading(F.lit(2.0), (F.col("c_custkey") % 7).cast("double"), F.lit(1.5), F.col("c_acctbal") / 50)
    return customer.select("c_custkey", fixed(x).alias("x"), fixed(y).alias("y"), z.cast("double").alias("z"))


@query(f"""
    WITH l AS (SELECT p_partkey, p_size / 50.0 + 0.1 AS a, p_retailprice / 1000 AS b, -(p_partkey % 300) * 1.0 AS c FROM part)
    SELECT p_partkey, {_f("-c / b", 3)} AS y0, {_f("-(c + a * 640.0) / b", 3)} AS y1 FROM l
""")
def epipolar_ends(part: DataFrame) -> DataFrame:
    y0, y1 = G.line_at_sides(F.col("p_size") / 50.0 + 0.1, F.col("p_retailprice") / 1000, -(F.col("p_partkey") % 300) * 1.0, 640.0)
    return part.select("p_partkey", fixed(y0, 3).alias("y0"), fixed(y1, 3).alias("y1"))


@query(f"""
    WITH u AS (SELECT c_custkey, c_custkey % 900 + 7.0 AS p, 0.2 + c_custkey % 11 / 10.0 AS u FROM customer)
    SELECT c_custkey, {_f("-(p - 512 + 0.5) / sin(u) * cos(u) + 256 - 0.5", 3)} AS y, {_f("-(p - 256 + 0.5) / cos(u) * sin(u) + 512 - 0.5", 3)} AS x FROM u
""")
def wall_solve(customer: DataFrame) -> DataFrame:
    """Where a wall at x, or at y, is seen at a longitude."""
    p, u = (F.col("c_custkey") % 900 + 7.0).cast("double"), (0.2 + F.col("c_custkey") % 11 / 10.0).cast("double")
    return customer.select("c_custkey", fixed(G.wall_y(p, u, 512, 1024), 3).alias("y"), fixed(G.wall_x(p, u, 512, 1024), 3).alias("x"))


@query(f"""
    WITH s AS (SELECT s_suppkey, s_acctbal / 100 AS x1, (s_suppkey % 300)::DOUBLE AS y1, (s_suppkey * 13 % 320)::DOUBLE AS x2, (s_suppkey * 7 % 310)::DOUBLE AS y2, radians(30.0 * (s_nationkey % 12)) AS b FROM supplier),
    p AS (SELECT s_suppkey, k, b, (CASE WHEN k = 0 THEN x1 ELSE x2 END) - 159.5 AS x, -((CASE WHEN k = 0 THEN y1 ELSE y2 END) - 159.5) AS y, 160 / tan(30 * {_PI} / 180) AS z FROM s, range(2) AS t(k)),
    r AS (SELECT s_suppkey, k, x * cos(b) + z * sin(b) AS x, y, -x * sin(b) + z * cos(b) AS z FROM p),
    n AS (SELECT a.s_suppkey, a.y * c.z - a.z * c.y AS nx, a.z * c.x - a.x * c.z AS ny, a.x * c.y - a.y * c.x AS nz FROM r a JOIN r c ON a.s_suppkey = c.s_suppkey AND a.k = 0 AND c.k = 1)
    SELECT s_suppkey, {_f("nx / sqrt(nx * nx + ny * ny + nz * nz)")} AS nx, {_f("ny / sqrt(nx * nx + ny * ny + nz * nz)")} AS ny, {_f("nz / sqrt(nx * nx + ny * ny + nz * nz)")} AS nz FROM n
""")
def segment_normals(supplier: DataFrame) -> DataFrame:
    """Segments in crops of a panorama as great circles."""
    key, yaw = F.col("s_suppkey"), 30.0 * (F.col("s_nationkey") % 12)
    ray = lambda x, y: G.perspective_ray(x, y, 320, 320, 60.0, yaw, F.lit(0.0))
    n = G.segment_normal(ray(F.col("s_acctbal") / 100, (key % 300).cast("double")), ray((key * 13 % 320).cast("double"), (key * 7 % 310).cast("double")))
    return supplier.select("s_suppkey", *(fixed(c).alias(name) for c, name in zip(n, ("nx", "ny", "nz"))))


@query("SELECT p_partkey FROM part WHERE p_size >= 3 AND p_size < 45 AND p_partkey % 40 >= 3 AND p_partkey % 40 < 37 AND p_partkey % 48 >= 3 AND p_partkey % 48 < 45 AND p_partkey % 39 >= 3 AND p_partkey % 39 < 37")
def border_matches(part: DataFrame) -> DataFrame:
    """Matches that keep clear of the borders of both images, 48 by 40 pixels large."""
    key = F.col("p_partkey")
    return part.where(G.within_border(F.col("p_size"), key % 40, 48, 40) & G.within_border(key % 48, key % 39, 48, 40)).select("p_partkey")
