"""Queries of single geometric functions, of assignments to directions, and of polygons, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import numbers as N
from ..functions.numbers import fixed
from ..operators import evaluate, lines, propagate
from . import query
from .matching import _GRID, _V, grid, vectors
from .rasters import _PI, _f


@query(f"""
    WITH p AS (SELECT c_custkey AS id, (c_custkey % 11)::DOUBLE AS ax, (c_custkey % 7)::DOUBLE AS ay, cos(c_acctbal / 100) AS dx, sin(c_acctbal / 100) AS dy FROM customer),
    k AS (SELECT *, list_sort([(0 - ax) / dx, (10 - ax) / dx, (0 - ay) / dy, (6 - ay) / dy]) AS t FROM p)
    SELECT id, {_f("ax + t[2] * dx")} AS x0, {_f("ay + t[2] * dy")} AS y0, {_f("ax + t[3] * dx")} AS x1, {_f("ay + t[3] * dy")} AS y1 FROM k
""")
def line_box_clip(customer: DataFrame) -> DataFrame:
    key, a = F.col("c_custkey"), F.col("c_acctbal") / 100
    box = (F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(6.0))
    ends = G.line_box((key % 11).cast("double"), (key % 7).cast("double"), F.cos(a), F.sin(a), *box)
    return customer.select(key.alias("id"), *(fixed(e).alias(n) for e, n in zip(ends, ("x0", "y0", "x1", "y1"))))


@query(f"""
    WITH {_V}, u AS (SELECT vec_id, p, CASE p WHEN 1 THEN e[1] WHEN 2 THEN e[2] ELSE e[3] END AS a, CASE p WHEN 1 THEN e[2] WHEN 2 THEN e[3] ELSE e[1] END AS b,
        CASE p WHEN 1 THEN e[3] WHEN 2 THEN e[1] ELSE e[2] END AS c FROM v, range(1, 4) AS t(p))
    SELECT vec_id, p::INTEGER AS plane, {_f("atan2(a, b)")} AS u, {_f("asin(greatest(-1, least(1, c / sqrt(a * a + b * b + c * c))))")} AS v,
        {_f("atan(-(sin(0.7) * a + cos(0.7) * b) / (c + 1e-12))")} AS circle FROM u
""")
def sphere_uv(embeddings: DataFrame) -> DataFrame:
    e = [F.col("e")[k] for k in range(3)]
    planes = vectors(embeddings).withColumn("plane", F.explode(F.array(*(F.lit(k) for k in (1, 2, 3)))))
    u, v = G.c3_uv(*e, F.col("plane"))
    return planes.select("vec_id", "plane", fixed(u).alias("u"), fixed(v).alias("v"), fixed(G.great_circle_v(*e, F.lit(0.7), F.col("plane"))).alias("circle"))


@query(f"""
    WITH {_GRID}, a AS (SELECT r, c, ((c + 0.5)::DOUBLE / 50 - 0.5) * 2 * {_PI} AS u, -((r % 12 + 0.5)::DOUBLE / 40 - 0.5) * {_PI} AS v FROM g)
    SELECT r, c, {_f("50 / tan(v) * sin(u) + 24.5", 3)} AS x, {_f("-50 / tan(v) * cos(u) + 19.5", 3)} AS y FROM a
""")
def floor_plane_project(part: DataFrame) -> DataFrame:
    x, y = G.floor_plane(F.col("r") % 12, F.col("c"), F.lit(50.0), 40, 50)
    return grid(part).select("r", "c", fixed(x, 3).alias("x"), fixed(y, 3).alias("y"))


@query(f"""
    WITH {_V}, p AS (SELECT vec_id, -e[1] / (e[3] - 3) AS x, -e[2] / (e[3] - 3) AS y FROM v), r AS (SELECT *, x * x + y * y AS r FROM p)
    SELECT vec_id, {_f("500 * (1 + 0.01 * r + 0.002 * r * r) * x")} AS u, {_f("500 * (1 + 0.01 * r + 0.002 * r * r) * y")} AS v FROM r
""")
def distort_project(embeddings: DataFrame) -> DataFrame:
    e = [F.col("e")[k] for k in range(3)]
    u, v = G.seen((e[0], e[1], e[2] - 3), F.lit(500.0), F.lit(0.01), F.lit(0.002))
    return vectors(embeddings).select("vec_id", fixed(u).alias("u"), fixed(v).alias("v"))


@query(f"""
    SELECT c_custkey, {_f("CASE WHEN r > 45 THEN r - 90 ELSE r END")} AS folded, {_f("1 / (1 + exp(-c_acctbal / 1000))", 6)} AS squashed, {_f("power(0.96, c_custkey % 50)", 6)} AS decayed
    FROM (SELECT *, ((c_acctbal / 10) % 90 + 90) % 90 AS r FROM customer)
""")
def angle_and_decay(customer: DataFrame) -> DataFrame:
    folded = G.fold_angle(F.col("c_acctbal") / 10)
    return customer.select("c_custkey", fixed(folded).alias("folded"), fixed(N.sigmoid(F.col("c_acctbal") / 1000), 6).alias("squashed"), fixed(F.pow(F.lit(0.96), F.col("c_custkey") % 50), 6).alias("decayed"))


_SEGS = "s AS (SELECT s_suppkey AS id, s_nationkey AS k, s_acctbal / 1000 AS x1, (s_suppkey * 7 % 100)::DOUBLE AS y1, (s_suppkey * 13 % 100)::DOUBLE AS x2, s_acctbal / 500 AS y2 FROM supplier)"


@query(f"""
    WITH {_SEGS}, p AS (
        SELECT a.id AS a, b.id AS b, a.x1 AS x1, a.y1 AS y1, a.x2 AS x2, a.y2 AS y2, b.x1 AS x3, b.y1 AS y3, b.x2 AS x4, b.y2 AS y4, abs(a.x2 - a.x1) >= abs(a.y2 - a.y1) AS al FROM s a JOIN s b ON a.k = b.k AND a.id < b.id
    ), m AS (
        SELECT *, nullif(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) * sqrt(power(x4 - x3, 2) + power(y4 - y3, 2)), 0) AS n,
            CASE WHEN al THEN (x2 - x1) * (x4 - x3) + (y2 - y1) * (-y4 + y3) ELSE (x2 - x1) * (-x4 + x3) + (y2 - y1) * (y4 - y3) END AS d FROM p
    )
    SELECT a, b, {_f("d / n", 6)} AS mirror,
        {_f("(greatest(abs(y1 - y3), abs(y2 - y4)) + 1.0) / (least(abs(x1 - x3), abs(x2 - x4)) + 0.001) * (1 - ((x2 - x1) * (x4 - x3) + (y2 - y1) * (y4 - y3)) / n) * (d / n)", 2)} AS score FROM m
""")
def separation_score(supplier: DataFrame) -> DataFrame:
    from .matching import _pairs

    both, e = _pairs(supplier)
    mirror = G.mirrored_similarity(*e)
    y_sep, x_sep = F.greatest(F.abs(e[1] - e[5]), F.abs(e[3] - e[7])), F.least(F.abs(e[0] - e[4]), F.abs(e[2] - e[6]))
    score = G.separation(x_sep, y_sep, F.lit(1.0), G.similarity(*e), mirror)
    return both.select(F.col("ida").alias("a"), F.col("idb").alias("b"), fixed(mirror, 6).alias("mirror"), fixed(score, 2).alias("score"))


@query(f"""
    WITH {_V}, d AS (
        SELECT vec_id, t.k, asin(abs(e[1] * x + e[2] * y + e[3] * z) / sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3])) AS cost
        FROM v, (VALUES (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)) AS t(k, x, y, z)
    )
    SELECT vec_id, (CASE WHEN min(cost) <= radians(10) THEN arg_min(k, cost) ELSE 4 END)::INTEGER AS vp FROM d GROUP BY vec_id
""")
def vp_assign(embeddings: DataFrame) -> DataFrame:
    arcs = vectors(embeddings).select("vec_id", *(F.col("e")[k].alias(n) for k, n in enumerate(("nx", "ny", "nz"))))
    return lines.assign(arcs, [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)], 10.0).select("vec_id", "vp")


@query(f"""
    WITH {_V}
    SELECT label, {_f("sum(w * w * x * x)", 3)} AS xx, {_f("sum(w * w * x * y)", 3)} AS xy, {_f("sum(w * w * x * z)", 3)} AS xz, {_f("sum(w * w * y * y)", 3)} AS yy, {_f("sum(w * w * y * z)", 3)} AS yz, {_f("sum(w * w * z * z)", 3)} AS zz
    FROM (SELECT label, e[1] AS x, e[2] AS y, e[3] AS z, e[4] * 10 AS w FROM v JOIN embeddings USING (vec_id)) GROUP BY label
""")
def scatter_matrix(embeddings: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    points = embeddings.select("label", *(e[k].alias(n) for k, n in enumerate("xyz")), (e[3] * 10).alias("weight"))
    return lines.scatter(points, ["label"]).select("label", *(fixed(c, 3).alias(c) for c in ("xx", "xy", "xz", "yy", "yz", "zz")))


@query(f"""
    SELECT p_brand, {_f("degrees(0.5 * atan2(2 * covar_samp(p_size, p_retailprice), var_samp(p_size) - var_samp(p_retailprice)))")} AS degrees, count(*) AS n FROM part GROUP BY p_brand
""")
def main_direction(part: DataFrame) -> DataFrame:
    points = part.select("p_brand", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return propagate.main_direction(points, ["p_brand"]).withColumn("degrees", fixed("degrees"))


_RING = "(SELECT *, row_number() OVER (PARTITION BY room ORDER BY id) AS seq FROM (SELECT p_partkey // 6 AS room, p_partkey AS id, (p_partkey * 7 % 11)::DOUBLE AS x, p_retailprice AS y FROM part))"


@query(f"""
    WITH v AS {_RING}, e AS (
        SELECT room, seq, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY room ORDER BY seq)
    ), c AS (
        SELECT DISTINCT a.room FROM e a JOIN e b ON a.room = b.room AND a.seq < b.seq
        WHERE sign((a.x2 - a.x) * (b.y - a.y) - (a.y2 - a.y) * (b.x - a.x)) * sign((a.x2 - a.x) * (b.y2 - a.y) - (a.y2 - a.y) * (b.x2 - a.x)) < 0
            AND sign((b.x2 - b.x) * (a.y - b.y) - (b.y2 - b.y) * (a.x - b.x)) * sign((b.x2 - b.x) * (a.y2 - b.y) - (b.y2 - b.y) * (a.x2 - b.x)) < 0
    )
    SELECT room, room NOT IN (SELECT room FROM c) AS simple FROM (SELECT DISTINCT room FROM v)
""")
def polygon_simple(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    corners = part.select(F.expr("p_partkey div 6").alias("room"), key.alias("seq"), (key * 7 % 11).cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return propagate.is_simple(corners, "room")


@query(f"""
    WITH d AS (SELECT l_linestatus, abs(l_quantity - l_tax * 400) AS d FROM lineitem), s AS (SELECT l_linestatus, avg(d) AS m, max(d) * 0.2 AS c FROM d GROUP BY ALL)
    SELECT l_linestatus, {_f("CASE WHEN m <= c THEN m ELSE (m * m + c * c) / (2 * c) END")} AS berhu FROM s
""")
def berhu_loss(lineitem: DataFrame) -> DataFrame:
    rows = lineitem.select("l_linestatus", F.col("l_quantity").alias("pred"), (F.col("l_tax") * 400).alias("truth"))
    return evaluate.berhu(rows, ["l_linestatus"]).select("l_linestatus", fixed("berhu").alias("berhu"))


@query(f"""
    WITH a AS (SELECT p_brand, avg(x) AS px, avg(y) AS py FROM (SELECT p_brand, p_size::DOUBLE AS x, p_retailprice AS y FROM part) GROUP BY ALL),
    b AS (SELECT p_brand, avg(p_retailprice) AS tx, avg(p_size::DOUBLE) AS ty FROM part GROUP BY ALL)
    SELECT p_partkey, {_f("p_size - px + tx", 3)} AS x, {_f("p_retailprice - py + ty", 3)} AS y FROM part JOIN a USING (p_brand) JOIN b USING (p_brand)
""")
def centre_on_truth(part: DataFrame) -> DataFrame:
    pred = part.select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    truth = part.select("p_brand", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    moved = evaluate.to_truth_centre(pred, truth, ["p_brand"])
    return moved.select("p_partkey", fixed("x", 3).alias("x"), fixed("y", 3).alias("y"))


@query("""
    WITH n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE), vec_id)::INTEGER AS place FROM embeddings) SELECT * FROM n
""")
def order_by_angle(embeddings: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    e = F.col("embedding").cast("array<double>")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.atan2(e[1], e[0]), "vec_id"))
    return embeddings.select("label", "vec_id", place.alias("place"))


@query()
def spread_labels(part: DataFrame) -> DataFrame:
    """Grids of 40 x 50 cells; one cell in ten is a seed. Order within a panorama decides, so SQL has no form of it."""
    from .rasters import panos

    cells = panos(part).select(
        "pano", F.col("row").cast("int").alias("m"), F.col("col").cast("int").alias("n"), F.col("v").alias("l"), F.col("s").cast("double").alias("a"), F.lit(0.0).alias("b"), F.when(F.col("s") % 10 == 0, F.col("s") % 3 + 1).otherwise(0).cast("int").alias("label")
    )
    return propagate.spread_labels(cells, "pano")


@query()
def robust_homography(part: DataFrame) -> DataFrame:
    """Per brand a homography from (size, price) to a noisy image of it, by seeded samples."""
    from ..operators import vision

    key = F.col("p_partkey")
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice") - 900
    u, v = G.homogeneous([1.1, 0.2, -3.0, -0.1, 0.9, 4.0, 0.001, 0.002, 1.0], x, y)
    off = F.when(key % 5 == 0, 7.0).otherwise(0.0)
    matches = part.select("p_brand", x.alias("x1"), y.alias("y1"), (u + off).alias("x2"), (v - off).alias("y2"))
    found = vision.robust_models(matches, "p_brand", "homography", 1e-3, 128)
    return found.select("p_brand", "inliers", "n", *(fixed(F.col("m")[k], 3).alias(f"h{k}") for k in range(9)))
