"""Queries on grids: rays, views, resampling, superpixels, series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numbers import fixed
from ..operators import raster as R
from . import query
from .matching import _GRID, _V, grid, vectors

_PANO = "g AS (SELECT p_partkey // 2000 AS pano, p_partkey % 2000 // 50 AS r, p_partkey % 50 AS c, p_retailprice AS v, p_size AS s FROM part)"


def panos(part: DataFrame) -> DataFrame:
    """Parts as images of 40 x 50 pixels."""
    key = F.col("p_partkey")
    return part.select(F.expr("p_partkey div 2000").alias("pano"), F.expr("p_partkey % 2000 div 50").alias("row"), (key % 50).alias("col"), F.col("p_retailprice").alias("v"), F.col("p_size").alias("s"))



_PI = repr(math.pi)


def _f(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {10**digits}"


@query(f"""
    WITH p AS (SELECT p_partkey // 2048 AS pano, p_partkey % 2048 // 64 AS r, p_partkey % 64 AS c, p_retailprice / 600 AS d FROM part),
    k AS (SELECT * FROM p WHERE r >= 4 AND r < 28 AND (r - 4) % 2 = 0 AND c % 2 = 0),
    x AS (SELECT pano, r, c, cos(((r + 0.5)::DOUBLE / 32 - 0.5) * {_PI}) * cos((c + 0.5)::DOUBLE / 64 * 2 * {_PI}) * d AS x, cos(((r + 0.5)::DOUBLE / 32 - 0.5) * {_PI}) * sin((c + 0.5)::DOUBLE / 64 * 2 * {_PI}) * d AS y,
        -sin(((r + 0.5)::DOUBLE / 32 - 0.5) * {_PI}) * d AS z FROM k)
    SELECT pano, r AS row_, c AS col_, {_f("x")} AS x, {_f("y")} AS y, {_f("z")} AS z FROM x WHERE z < 1.2
""")
def sphere_reproject(part: DataFrame) -> DataFrame:
    depth = part.select(F.expr("p_partkey div 2048").alias("pano"), F.expr("p_partkey % 2048 div 64").alias("row"), (F.col("p_partkey") % 64).alias("col"), (F.col("p_retailprice") / 600).alias("d"))
    points = R.cloud(depth, 32, 64, crop=4, stride=2, top=1.2)
    return points.select("pano", F.col("row").alias("row_"), F.col("col").alias("col_"), *(fixed(c).alias(c) for c in "xyz"))


@query(f"""
    WITH g AS (SELECT i // 32 AS r, i % 32 AS c FROM range(768) AS t(i)), f AS (SELECT *, 16::DOUBLE / tan(45::DOUBLE * {_PI} / 180) AS f FROM g),
    d AS (SELECT r, c, f, c - 15.5::DOUBLE AS x, -(r - 11.5::DOUBLE) AS y, f AS z FROM f),
    w AS (SELECT r, c, f, (atan2(x, z) / {_PI} + 1) / 2 * 512 AS u, (0.5 - asin(y / sqrt(x * x + y * y + z * z)) / {_PI}) * 256 AS v FROM d),
    b AS (SELECT *, (0.5 - v / 256) * {_PI} AS lat, (u / 512 * 2 - 1) * {_PI} AS lon FROM w)
    SELECT r::INTEGER AS row_, c::INTEGER AS col_, {_f("u")} AS u, {_f("v")} AS v, {_f("f * cos(lat) * sin(lon) / (cos(lat) * cos(lon)) + 15.5", 3)} AS px, {_f("-f * sin(lat) / (cos(lat) * cos(lon)) + 11.5", 3)} AS py FROM b
""")
def persp_equirect_roundtrip(spark: SparkSession) -> DataFrame:
    g = R.grid(spark, 24, 32)
    u, v = G.c2_pixel(*G.perspective_ray(F.col("col"), F.col("row"), 32, 24, 90.0, F.lit(0.0), F.lit(0.0)), 256, 512)
    there = g.withColumn("u", u).withColumn("v", v)
    ray = G.c2_ray(F.col("u"), F.col("v"), 256, 512)
    f = 0.5 * 32 / math.tan(0.5 * 90 * math.pi / 180)
    px, py = f * ray[0] / ray[2] + 15.5, -f * ray[1] / ray[2] + 11.5
    return there.select(F.col("row").alias("row_"), F.col("col").alias("col_"), fixed("u").alias("u"), fixed("v").alias("v"), fixed(px, 3).alias("px"), fixed(py, 3).alias("py"))


@query(f"""
    WITH v AS (
        SELECT c_custkey, n_nationkey, degrees(atan2((n_nationkey * 3)::DOUBLE - c_acctbal / 1000, n_regionkey * 2.0 - 1.5)) - (c_custkey % 360) AS yaw,
            max(sqrt(power(n_regionkey * 2.0 - 1.5, 2) + power((n_nationkey * 3)::DOUBLE - c_acctbal / 1000, 2))) OVER (PARTITION BY c_custkey) AS far
        FROM customer JOIN nation ON n_regionkey = c_nationkey % 5
    )
    SELECT c_custkey, n_nationkey, {_f("yaw")} AS yaw, {_f("CASE WHEN far > 2 THEN greatest(45.0, 90.0 * least(1.0, 2 / far)) ELSE 90.0 END")} AS fov FROM v
""")
def yaw_fov_views(customer: DataFrame, nation: DataFrame) -> DataFrame:
    met = customer.join(nation, F.col("n_regionkey") == F.col("c_nationkey") % 5)
    dx, dy = F.col("n_regionkey") * 2.0 - 1.5, (F.col("n_nationkey") * 3).cast("double") - F.col("c_acctbal") / 1000
    far = met.groupBy("c_custkey").agg(F.max(G.norm(dx, dy)).alias("far"))
    views = met.withColumn("yaw", G.yaw_to(dx, dy, F.col("c_custkey") % 360)).select("c_custkey", "n_nationkey", "yaw").join(far, "c_custkey")
    return views.select("c_custkey", "n_nationkey", fixed("yaw").alias("yaw"), fixed(G.field_of_view(F.col("far"))).alias("fov"))


#: A homography of the queries, in row order.
_H = [1.1, 0.2, -3.0, -0.1, 0.9, 4.0, 0.001, 0.002, 1.0]


@query(f"WITH {_GRID} SELECT r, c, {_f('(1.1 * c + 0.2 * r - 3.0) / (0.001 * c + 0.002 * r + 1.0)')} AS x, {_f('(-0.1 * c + 0.9 * r + 4.0) / (0.001 * c + 0.002 * r + 1.0)')} AS y FROM g")
def homography_apply(part: DataFrame) -> DataFrame:
    x, y = G.homogeneous(_H, F.col("c"), F.col("r"))
    return grid(part).select("r", "c", fixed(x).alias("x"), fixed(y).alias("y"))


@query(f"""
    WITH {_PANO}, s AS (SELECT pano, r * 50 + c AS id, c * 0.7 + 0.3 AS sx, r * 0.8 + 0.6 AS sy FROM g), n AS (SELECT *, floor(sx)::INT AS x0, floor(sy)::INT AS y0 FROM s),
    w AS (
        SELECT pano, id, x0 + dx AS c, y0 + dy AS r, (CASE WHEN dx = 1 THEN sx - x0 ELSE 1 - (sx - x0) END) * (CASE WHEN dy = 1 THEN sy - y0 ELSE 1 - (sy - y0) END) AS w
        FROM n, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS o(dx, dy)
    ), b AS (SELECT w.pano, id, sum(w * v) AS v FROM w JOIN g ON g.pano = w.pano AND g.r = least(w.r, 39) AND g.c = least(w.c, 49) GROUP BY ALL)
    SELECT pano, id, {_f("coalesce(b.v, 0)", 3)} AS v FROM s LEFT JOIN b USING (pano, id)
""")
def bilinear_sample(part: DataFrame) -> DataFrame:
    g = panos(part)
    samples = g.select("pano", (F.col("row") * 50 + F.col("col")).alias("id"), (F.col("col") * 0.7 + 0.3).alias("sx"), (F.col("row") * 0.8 + 0.6).alias("sy"))
    return R.bilinear(samples, g, ["pano"], "v", 40, 50).select("pano", "id", fixed("v", 3).alias("v"))


@query(f"""
    WITH {_PANO}, t AS (SELECT i // 80 AS r2, i % 80 AS c2 FROM range(4800) AS x(i))
    SELECT pano, r2::INTEGER AS row_, c2::INTEGER AS col_, (CASE WHEN greatest(s / 50.0, (1000 - v) / 100) > 0.5 THEN CASE WHEN s / 50.0 >= (1000 - v) / 100 THEN 1 ELSE 2 END ELSE 0 END)::INTEGER AS label
    FROM t JOIN g ON g.r = floor(r2 * 40 / 60)::INT AND g.c = floor(c2 * 50 / 80)::INT
""")
def nn_resize(part: DataFrame) -> DataFrame:
    label = R.label_by_threshold([F.col("s") / 50.0, (1000 - F.col("v")) / 100])
    labels = panos(part).select("pano", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), label.alias("label"))
    return R.resized(labels, (40, 50), (60, 80)).select("pano", F.col("row").alias("row_"), F.col("col").alias("col_"), "label")


@query(f"""
    WITH {_V}, w AS (SELECT vec_id, k - 1 AS k, e[k] AS w FROM v, range(1, 65) AS t(k))
    SELECT vec_id, i::INTEGER AS i, {_f(f"sum(w * cos(k * (i + 0.5)::DOUBLE / 8 * {_PI}))")} AS value FROM w, range(8) AS t(i) GROUP BY ALL
""")
def dct_reconstruct(embeddings: DataFrame) -> DataFrame:
    weights = vectors(embeddings).select("vec_id", F.posexplode("e").alias("k", "w"))
    return R.cosine_series(weights, ["vec_id"], "k", "w", 8).select("vec_id", "i", fixed("value").alias("value"))


@query(f"""
    WITH {_V}, r AS (SELECT vec_id, i, e[i + 1] AS a, e[(i + 16) % 64 + 1] AS b FROM v, range(64) AS t(i))
    SELECT vec_id, (i - 16 + 64) % 64 AS i, {_f("avg(x)")} AS mean FROM (SELECT vec_id, i, b AS x FROM r UNION ALL SELECT vec_id, (i + 16) % 64, a FROM r) GROUP BY ALL
""")
def tta_undo(embeddings: DataFrame) -> DataFrame:
    rolled = vectors(embeddings).select("vec_id", F.posexplode("e").alias("i", "a"), "e")
    rolled = rolled.select("vec_id", "i", "a", F.col("e")[F.col("i") + 16 - F.when(F.col("i") >= 48, 64).otherwise(0)].alias("b"))
    both = rolled.select("vec_id", "i", F.col("b").alias("x")).unionByName(rolled.select("vec_id", ((F.col("i") + 16) % 64).alias("i"), F.col("a").alias("x")))
    back = both.groupBy("vec_id", ((F.col("i") - 16 + 64) % 64).cast("long").alias("i")).agg(fixed(F.avg("x")).alias("mean"))
    return back


@query(f"""
    WITH {_V}, q AS (SELECT vec_id, e[1] / n AS s, e[2] / n AS a, e[3] / n AS b, e[4] / n AS c, e[5] AS x, e[6] AS y, e[7] AS z FROM (SELECT *, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3] + e[4] * e[4]) AS n FROM v)),
    d AS (SELECT *, a * x + b * y + c * z AS dot, 2 * s * s - 1 AS k FROM q)
    SELECT vec_id, {_f("k * x + 2 * a * dot - 2 * s * (b * z - c * y)")} AS x, {_f("k * y + 2 * b * dot - 2 * s * (c * x - a * z)")} AS y, {_f("k * z + 2 * c * dot - 2 * s * (a * y - b * x)")} AS z FROM d
""")
def quat_rotate(embeddings: DataFrame) -> DataFrame:
    e = [F.col("e")[k] for k in range(7)]
    size = G.norm(*e[:4])
    turned = G.rotated(tuple(x / size for x in e[:4]), tuple(e[4:]))
    return vectors(embeddings).select("vec_id", *(fixed(t).alias(n) for n, t in zip("xyz", turned)))


_F = [0.1, -0.3, 0.2, 0.25, 0.05, -0.4, -0.15, 0.35, 0.1]


@query(f"""
    WITH {_V}, l AS (SELECT vec_id, e[1] AS x1, e[2] AS y1, e[3] AS x2, e[4] AS y2 FROM v),
    d AS (SELECT vec_id,
        abs((0.1 * x1 - 0.3 * y1 + 0.2) * x2 + (0.25 * x1 + 0.05 * y1 - 0.4) * y2 + (-0.15 * x1 + 0.35 * y1 + 0.1)) / nullif(sqrt(power(0.1 * x1 - 0.3 * y1 + 0.2, 2) + power(0.25 * x1 + 0.05 * y1 - 0.4, 2)), 0) AS d1,
        abs((0.1 * x2 + 0.25 * y2 - 0.15) * x1 + (-0.3 * x2 + 0.05 * y2 + 0.35) * y1 + (0.2 * x2 - 0.4 * y2 + 0.1)) / nullif(sqrt(power(0.1 * x2 + 0.25 * y2 - 0.15, 2) + power(-0.3 * x2 + 0.05 * y2 + 0.35, 2)), 0) AS d2 FROM l)
    SELECT vec_id, {_f("d1")} AS d1, {_f("d2")} AS d2, d1 > 0.3 OR d2 > 0.3 AS outlier FROM d
""")
def epipolar_outliers(embeddings: DataFrame) -> DataFrame:
    d1, d2 = G.epipolar_distances(_F, *(F.col("e")[k] for k in range(4)))
    return vectors(embeddings).select("vec_id", fixed(d1).alias("d1"), fixed(d2).alias("d2"), ((d1 > 0.3) | (d2 > 0.3)).alias("outlier"))


@query(f"""
    WITH {_GRID}, l AS (SELECT r, c, s % 4 AS label FROM g), o AS (SELECT a.r, a.c, count(DISTINCT b.label) > 1 AS border FROM l a JOIN l b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL)
    SELECT * FROM o
""")
def border_mask(part: DataFrame) -> DataFrame:
    labels = grid(part).select("r", "c", (F.col("s") % 4).alias("label"))
    return R.borders(labels, "r", "c", "label").select("r", "c", "border")


@query(f"""
    WITH {_GRID} SELECT r, c, (CASE WHEN s % 4 <> 0 THEN s % 4 WHEN r > 12 AND r < 28 THEN 2 WHEN r <= 12 THEN 3 WHEN r >= 28 THEN 1 ELSE 0 END)::INTEGER AS label FROM g
""")
def label_order(part: DataFrame) -> DataFrame:
    label = R.enforced(F.col("s") % 4, F.col("r"), F.lit(12), F.lit(28))
    return grid(part).select("r", "c", label.cast("int").alias("label"))


def _slic_sql(rounds: int) -> str:
    ctes = [
        "p AS (SELECT pano * 2000 + r * 50 + c AS id, pano, r, c, v / 10 AS l, s::DOUBLE AS a, (s % 7)::DOUBLE AS b FROM g)",
        "c0 AS (SELECT pano, (r // 8) * 8 + c // 8 + 1 AS sp, l::DOUBLE AS l, a, b, r::DOUBLE AS r, c::DOUBLE AS c FROM p WHERE (r - 4) % 8 = 0 AND (c - 4) % 8 = 0 AND r >= 4 AND c >= 4)",
        "s0 AS (SELECT *, 0::BIGINT AS sp, 'infinity'::DOUBLE AS dist FROM p)",
    ]
    for k in range(rounds):
        ctes.append(f"""d{k} AS (SELECT s.id, k.sp, floor(sqrt((power(s.l - k.l, 2) + power(s.a - k.a, 2) + power(s.b - k.b, 2)) + (power(s.r - k.r, 2) + power(s.c - k.c, 2)) * 1.5625) * 1000000 + 0.5) / 1000000 AS d
            FROM s{k} s JOIN c{k} k ON s.pano = k.pano AND abs(s.r - k.r) <= 8 AND abs(s.c - k.c) <= 8 QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY d, k.sp) = 1)""")
        ctes.append(f"""s{k + 1} AS (SELECT s.id, s.pano, s.r, s.c, s.l, s.a, s.b, CASE WHEN d.d < s.dist THEN d.sp ELSE s.sp END AS sp, CASE WHEN d.d < s.dist THEN d.d ELSE s.dist END AS dist FROM s{k} s LEFT JOIN d{k} d USING (id))""")
        ctes.append(f"c{k + 1} AS (SELECT pano, sp, avg(l) AS l, avg(a) AS a, avg(b) AS b, avg(r) AS r, avg(c) AS c FROM s{k + 1} WHERE sp > 0 GROUP BY ALL)")
    return f"WITH {_PANO}, " + ", ".join(ctes) + f" SELECT pano, r AS row_, c AS col_, sp, CASE WHEN sp > 0 THEN floor(dist * 1000 + 0.5) / 1000 END AS dist FROM s{rounds}"


@query(_slic_sql(3))
def slic_iterations(part: DataFrame) -> DataFrame:
    pixels = panos(part).select("pano", "row", "col", (F.col("v") / 10).alias("l"), F.col("s").cast("double").alias("a"), (F.col("s") % 7).cast("double").alias("b"))
    found = R.slic(pixels, ["pano"], 50, 8, 3, 10.0)
    return found.select("pano", F.col("row").alias("row_"), F.col("col").alias("col_"), "sp", F.when(F.col("sp") > 0, fixed("dist", 3)).alias("dist"))
