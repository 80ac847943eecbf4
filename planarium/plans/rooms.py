"""Queries of walls and rooms: lines with even points, their ends, main directions, arcs, layouts with a way back."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numbers import fixed
from ..operators import fitting as T
from ..operators import lines, matching, propagate, raster, signals, walls
from ..sources import files as S
from . import query
from .fitting import _KEYS, _P, points
from .matching import _V, vectors
from .rasters import _PANO, _f, panos
from .scalars import _RING


@query(f"""
    WITH {_P}, h AS (
        SELECT a.p_brand, a.p_type, a.id AS i, b.id AS j, a.x AS ax, a.y AS ay, (b.x - a.x) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS dx, (b.y - a.y) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS dy
        FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.id < b.id AND (a.x <> b.x OR a.y <> b.y)
    ), t AS (
        SELECT h.p_brand, h.p_type, i, j, abs(dx * (y - ay) - dy * (x - ax)) <= 2.0 AS near, dx * (x - ax) + dy * (y - ay) AS t FROM h JOIN p ON h.p_brand = p.p_brand AND h.p_type = p.p_type
    ), m AS (SELECT *, min(t) FILTER (near) OVER w AS lo, max(t) FILTER (near) OVER w AS hi, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY p_brand, p_type, i, j)),
    b AS (SELECT p_brand, p_type, i, j, n, least(floor((t - lo) / (hi - lo) * 10), 9) AS bin, count(*) AS c FROM m WHERE near GROUP BY ALL),
    s AS (SELECT p_brand, p_type, i, j, n, sum(c)::BIGINT AS inliers, sum(c * c)::BIGINT AS squares FROM b GROUP BY ALL),
    u AS (SELECT *, 1 - (10 * squares - inliers * inliers) / (8.1::DOUBLE * inliers * inliers) - 0.9::DOUBLE AS even FROM s),
    k AS (SELECT *, floor((1::DOUBLE * inliers / n + 1::DOUBLE * even) * 1e9 + 0.5) AS score FROM u)
    SELECT p_brand, p_type, i, j, inliers, {_f("even", 6)} AS uniformity FROM k WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY score DESC, i, j) = 1
""")
def even_line(part: DataFrame) -> DataFrame:
    """The first line of each group by inliers and how evenly they lie, of all pairs; later lines are not sought."""
    found = T.fit_lines(points(part), _KEYS, "id", "x", "y", 2.0, drawn=None, outliers=0.0, lines=1)
    return found.select(*_KEYS, "i", "j", "inliers", fixed("uniformity", 6).alias("uniformity"))


_CORNERS = "c(plan, x, y) AS (VALUES (1, 0, 0), (1, 10, 0), (1, 10, 10), (1, 0, 10), (2, 0, 0), (2, 10, 0), (2, 10, 10), (2, 5, 15), (2, 0, 10), (3, 0, 0), (3, 10, 0), (3, 10, 10), (3, -3, 10), (3, -3, 5), (3, 0, 5))"


def _plans(spark: SparkSession) -> DataFrame:
    dots = [S.floor_plan_points(spark, k, 21) for k in (1, 2)]
    return dots[0].union(dots[1]).withColumn("id", F.col("edge") * 100 + F.col("i"))


@query(f"WITH {_CORNERS}, n AS (SELECT plan, count(*) AS walls FROM c GROUP BY plan) SELECT c.plan, x::DOUBLE AS x, y::DOUBLE AS y, walls, 2 AS ends FROM c JOIN n USING (plan) WHERE c.plan < 3")
def plan_corners(spark: SparkSession) -> DataFrame:
    """Lines fitted to plans' points until a hundredth is left; their ends are the plans' corners, each of two walls.

    The plans are convex: where a line crosses another within a wall, as in the third, most points lie around that place.
    """
    dots = _plans(spark)
    fitted = T.fit_lines(dots, ["plan"], "id", "x", "y", 0.05, outliers=0.01, drawn=None)
    ends = walls.wall_ends(fitted, dots, "plan", 0.05)
    place = lambda c: fixed(c, 3) + F.lit(0.0)
    both = ends.select("plan", place("x0").alias("x"), place("y0").alias("y")).unionAll(ends.select("plan", place("x1").alias("x"), place("y1").alias("y")))
    count = ends.groupBy("plan").agg(F.count("*").alias("walls"))
    return both.groupBy("plan", "x", "y").agg(F.count("*").cast("int").alias("ends")).join(count, "plan").select("plan", "x", "y", "walls", "ends")


@query(f"WITH {_V}, d AS (SELECT DISTINCT label FROM embeddings) SELECT label, a::INTEGER AS axis, 0.0::DOUBLE AS off, true AS voted FROM d, range(3) AS t(a)")
def manhattan_frames(embeddings: DataFrame) -> DataFrame:
    """Arcs around three directions of a room turned by an angle of its own: how many degrees each found one is off."""
    turn = F.radians(F.col("label") * 7.0 + 5)
    around = F.col("vec_id") * 0.37
    a, b = F.cos(around), F.sin(around)
    kind = F.col("vec_id") % 3
    # normals orthogonal to an axis of the room, then turned with it about the vertical
    x, y, z = F.when(kind == 0, 0.0).otherwise(a), F.when(kind == 0, a).when(kind == 1, 0.0).otherwise(b), F.when(kind == 2, 0.0).otherwise(b)
    arcs = embeddings.select("label", (F.cos(turn) * x - F.sin(turn) * y).alias("nx"), (F.sin(turn) * x + F.cos(turn) * y).alias("ny"), z.alias("nz"), F.lit(1.0).alias("weight"))
    found = walls.manhattan_frames(arcs, "label")
    true = F.greatest(F.abs(F.cos(turn) * F.col("x") + F.sin(turn) * F.col("y")), F.abs(F.cos(turn) * F.col("y") - F.sin(turn) * F.col("x")), F.abs(F.col("z")))
    return found.select("label", "axis", fixed(F.degrees(F.acos(F.least(F.lit(1.0), true))), 1).alias("off"), (F.col("votes") > 0).alias("voted"))


_ARCS = "a AS (SELECT vec_id, e[1] / s AS nx, e[2] / s AS ny, e[3] / s AS nz FROM (SELECT *, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3]) AS s FROM v))"


def arcs_of(embeddings: DataFrame) -> DataFrame:
    e = [F.col("e")[k] for k in range(3)]
    size = G.norm(*e)
    unit = vectors(embeddings).select("vec_id", *((x / size).alias(n) for x, n in zip(e, ("nx", "ny", "nz"))))
    far = F.greatest(F.abs("nx"), F.abs("ny"), F.abs("nz"))
    plane = F.when(F.abs("nz") == far, 1).when(F.abs("nx") == far, 2).otherwise(3)  # the circle's longitudes are even there
    return unit.withColumn("plane", plane).withColumn("umin", F.col("vec_id") % 7 / 10.0).withColumn("umax", F.col("vec_id") % 7 / 10.0 + 0.2)


@query(f"WITH {_V} SELECT vec_id, 1.0::DOUBLE AS same, true AS nearer FROM v")
def refit_arcs(embeddings: DataFrame) -> DataFrame:
    """Arcs drawn towards a direction: by no weight they stay, by some they pass it more nearly."""
    arcs = arcs_of(embeddings).withColumns({"vx": F.lit(0.6), "vy": F.lit(0.0), "vz": F.lit(0.8)})
    off = lambda df, n: df.select("vec_id", *(F.col(f"n{c}").alias(f"{n}{c}") for c in "xyz"))
    both = off(arcs, "o").join(off(walls.refitted(arcs, ["vec_id"], 0.0), "s"), "vec_id").join(off(walls.refitted(arcs, ["vec_id"], 0.1), "d"), "vec_id")
    return both.select("vec_id", fixed(F.expr("ox * sx + oy * sy + oz * sz"), 5).alias("same"), F.expr("abs(0.6 * dx + 0.8 * dz) <= abs(0.6 * ox + 0.8 * oz) + 1e-9").alias("nearer"))


@query(f"WITH {_V}, {_ARCS} SELECT vec_id, 1::INTEGER AS n, {_f('2.0 * radians(36.0)')} AS length, 2.2::DOUBLE AS score FROM a")
def merge_arcs(embeddings: DataFrame) -> DataFrame:
    """Two arcs on each vector's circle that meet, one of them turned over: one arc from end to end, its score by length."""
    flat = vectors(embeddings).select("vec_id", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), F.lit(1).alias("plane"))
    start = F.pmod(F.col("vec_id") / 97.0, F.lit(1.0))
    one = flat.select("*", start.alias("umin"), F.pmod(start + 0.12, F.lit(1.0)).alias("umax"), F.lit(3.0).alias("length"), F.lit(3.0).alias("score"))
    two = flat.select("vec_id", "nx", "ny", (-F.col("nz")).alias("nz"), "plane", F.pmod(start + 0.1, F.lit(1.0)).alias("umin"), F.pmod(start + 0.2, F.lit(1.0)).alias("umax"), F.lit(2.0).alias("length"), F.lit(1.0).alias("score"))
    found = walls.merge_arcs(one.union(two), "vec_id")
    return found.groupBy("vec_id").agg(F.count("*").cast("int").alias("n"), fixed(F.max("length")).alias("length"), fixed(F.max("score")).alias("score"))


@query("SELECT * FROM (VALUES (0, 12::BIGINT, 12.0::DOUBLE), (1, 42, 42.0), (2, 162, 162.0), (3, 642, 642.0)) AS t(level, n, size)")
def icosahedron_levels(spark: SparkSession) -> DataFrame:
    """How many points a sphere has at each level of subdivision, all at distance 1 and none twice."""
    rows = [(k, *p) for k in range(4) for p in lines.icosahedron(k)]
    return spark.createDataFrame(rows, "level int, x double, y double, z double").groupBy("level").agg(F.countDistinct("x", "y", "z").alias("n"), fixed(F.sum(F.expr("x * x + y * y + z * z")), 6).alias("size"))


@query(f"WITH {_V}, {_ARCS} SELECT vec_id, {_f('degrees(2 * asin(least(1, abs(nz))))')} AS width, {_f('nx')} AS nx FROM a WHERE degrees(2 * asin(least(1, abs(nz)))) >= 5")
def long_arcs(embeddings: DataFrame) -> DataFrame:
    """Arcs of five degrees or more."""
    arcs = arcs_of(embeddings).withColumn("length", 2 * F.asin(F.least(F.lit(1.0), F.abs("nz"))))
    return lines.long_enough(arcs, 5.0).select("vec_id", fixed(F.degrees("length")).alias("width"), fixed("nx").alias("nx"))


@query("""
    WITH p AS (SELECT user_id, event_id, (value * 10)::BIGINT % 1024 AS x FROM events),
    b AS (SELECT *, CASE WHEN x - lag(x) OVER w < 0 THEN 1 ELSE 0 END AS back FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, x, sum(back) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS part FROM b
""".replace("(value * 10)::BIGINT", "floor(value * 10)::BIGINT"))
def seam_split(events: DataFrame) -> DataFrame:
    line = events.select("user_id", "event_id", (F.floor(F.col("value") * 10) % 1024).alias("x"))
    return walls.split_at_seam(line, ["user_id"], "event_id", "x").select("user_id", "event_id", "x", "part")


@query(f"""
    WITH w AS (SELECT c_custkey AS id, (c_custkey * 37 % 256)::DOUBLE AS u0, -(0.3 + c_custkey % 5 * 0.1)::DOUBLE AS v0, ((c_custkey * 37 + 20 + c_custkey % 60) % 256)::DOUBLE AS u1, -(0.3 + c_custkey % 7 * 0.1)::DOUBLE AS v1 FROM customer WHERE c_custkey % 10 = 0),
    n AS (SELECT *, 20 + id % 60 AS n, (u0 + 0.5) / 256 * 2 * pi() - pi() AS a0, (u1 + 0.5) / 256 * 2 * pi() - pi() AS a1 FROM w),
    e AS (SELECT *, sin(a0) / tan(v0) AS x0, cos(a0) / tan(v0) AS y0, sin(a1) / tan(v1) AS x1, cos(a1) / tan(v1) AS y1 FROM n),
    k AS (SELECT e.*, (u0::BIGINT + t.k) % 256 AS col_, ((u0::BIGINT + t.k) % 256 + 0.5) / 256 * 2 * pi() - pi() AS a FROM e, range(80) AS t(k) WHERE t.k <= n)
    SELECT id, col_, {_f("atan((sin(a) * (y1 - y0) - cos(a) * (x1 - x0)) / (x0 * (y1 - y0) - y0 * (x1 - x0)))")} AS v FROM k
""")
def traced_walls(customer: DataFrame) -> DataFrame:
    """Straight walls followed over the image's columns, some of them over the seam."""
    key = F.col("c_custkey")
    height = lambda k: -(0.3 + key % k * 0.1).cast("double")
    w = customer.where("c_custkey % 10 = 0").select(key.alias("id"), (key * 37 % 256).cast("double").alias("u0"), height(5).alias("v0"), ((key * 37 + 20 + key % 60) % 256).cast("double").alias("u1"), height(7).alias("v1"))
    return walls.traced_wall(w, 256).select("id", F.col("col").cast("long").alias("col_"), fixed("v").alias("v"))


def _boundary(spark: SparkSession, plan: int) -> DataFrame:
    """A plan's outline as boundary segments; corners belong to neither wall."""
    dots = S.floor_plan_points(spark, plan, 21).where("i > 0 and i < 20")
    return dots.select("plan", F.col("edge").alias("segment"), (F.col("edge") * 100 + F.col("i")).alias("col"), F.col("x"), F.col("y"))


@query(f"WITH {_CORNERS} SELECT plan, x::DOUBLE AS x, y::DOUBLE AS y FROM c WHERE plan <> 2")
def manhattan_rooms(spark: SparkSession) -> DataFrame:
    """The corners of rooms with walls along two axes, from their outlines."""
    both = _boundary(spark, 1).union(_boundary(spark, 3))
    place = lambda c: (fixed(c, 3) + F.lit(0.0)).alias(c)
    return walls.manhattan_walls(both, "plan").select("plan", place("x"), place("y"))


@query(f"""
    WITH {_CORNERS}, m AS (SELECT plan, x - 4.0 AS x, y - 3.0 AS y FROM c WHERE plan <> 2),
    p AS (SELECT plan, (atan2(x, y) / (2 * pi()) + 0.5) * 1024 - 0.5 AS u, (atan2(1.6, sqrt(x * x + y * y)) / pi() + 0.5) * 512 - 0.5 AS v FROM m)
    SELECT plan, (row_number() OVER (PARTITION BY plan ORDER BY u) - 1)::INTEGER AS place, {_f("u", 3)} AS u, {_f("v", 3)} AS v FROM p
""")
def room_pixels(spark: SparkSession) -> DataFrame:
    """Where a camera in the room sees its corners; rooms run round once, so the order is that of the columns."""
    from pyspark.sql import Window

    both = _boundary(spark, 1).union(_boundary(spark, 3)).withColumn("x", F.col("x") - 4).withColumn("y", F.col("y") - 3)
    seen = walls.corner_pixels(walls.manhattan_walls(both, "plan"), "plan", F.lit(1.6), 512, 1024)
    place = F.row_number().over(Window.partitionBy("plan").orderBy("u")) - 1
    return seen.select("plan", place.alias("place"), fixed("u", 3).alias("u"), fixed("v", 3).alias("v"))


@query("""
    SELECT c_nationkey, (c_custkey % 4)::INTEGER AS wall, CASE WHEN c_custkey % 2 = 0 THEN 'y' ELSE 'x' END AS axis, floor(median(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_custkey % 37 END) * 100 + 0.5) / 100 AS at_
    FROM customer GROUP BY ALL
""")
def cuboid_rooms(customer: DataFrame) -> DataFrame:
    columns = customer.select("c_nationkey", (F.col("c_custkey") % 4).cast("int").alias("segment"), (F.col("c_custkey") % 37).cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    return propagate.cuboid_walls(columns, "c_nationkey").select("c_nationkey", "wall", "axis", fixed("at", 2).alias("at_"))


@query(f"""
    WITH v AS {_RING}, e AS (
        SELECT room, seq, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY room ORDER BY seq)
    ), c AS (
        SELECT DISTINCT a.room FROM e a JOIN e b ON a.room = b.room AND a.seq < b.seq
        WHERE sign((a.x2 - a.x) * (b.y - a.y) - (a.y2 - a.y) * (b.x - a.x)) * sign((a.x2 - a.x) * (b.y2 - a.y) - (a.y2 - a.y) * (b.x2 - a.x)) < 0
            AND sign((b.x2 - b.x) * (a.y - b.y) - (b.y2 - b.y) * (a.x - b.x)) * sign((b.x2 - b.x) * (a.y2 - b.y) - (b.y2 - b.y) * (a.x2 - b.x)) < 0
    ), good AS (SELECT room FROM v WHERE room NOT IN (SELECT room FROM c) GROUP BY room HAVING count(*) >= 4),
    b AS (SELECT room, t.s, t.s * 2.0 AS x, room % 9 * 1.0 AS y FROM (SELECT DISTINCT room FROM v), range(4) AS t(s))
    SELECT room, x::DOUBLE AS x, y::DOUBLE AS y, true AS general FROM v WHERE room IN (SELECT room FROM good) UNION ALL SELECT room, x::DOUBLE, y::DOUBLE, false FROM b WHERE room NOT IN (SELECT room FROM good)
""")
def layout_fallback(part: DataFrame) -> DataFrame:
    """General layouts where they are simple polygons of four corners or more, and else a cuboid's."""
    key = F.col("p_partkey")
    general = part.select(F.expr("p_partkey div 6").alias("room"), key.cast("long").alias("seq"), (key * 7 % 11).cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(True).alias("general"))
    corner = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("seq")
    cuboid = general.select("room").distinct().select("room", corner).select("room", "seq", (F.col("seq") * 2.0).cast("double").alias("x"), (F.col("room") % 9).cast("double").alias("y"), F.lit(False).alias("general"))
    return propagate.with_fallback(general, cuboid, "room").select("room", "x", "y", "general")


@query(f"WITH {_PANO} SELECT pano, c AS col_, max(r) FILTER (s % 4 = 3) AS ceiling, min(r) FILTER (s % 4 = 1) AS floor_ FROM g GROUP BY ALL")
def class_bounds(part: DataFrame) -> DataFrame:
    cells = panos(part).select("pano", "row", "col", (F.col("s") % 4).alias("label"))
    return raster.class_bounds(cells, ["pano", "col"]).select("pano", F.col("col").alias("col_"), "ceiling", F.col("floor").alias("floor_"))


@query(f"""
    WITH {_PANO}, k AS (SELECT pano, r, c FROM g WHERE s % 4 = 3 AND r < 20 QUALIFY row_number() OVER (PARTITION BY pano ORDER BY md5('5/' || r || '/' || c), r, c) <= 64)
    SELECT k.pano, k.r AS row_, k.c AS col_, 40 - k.r AS row2 FROM k JOIN g ON g.pano = k.pano AND g.r = 40 - k.r AND g.c = k.c
""")
def stochastic_pairs(part: DataFrame) -> DataFrame:
    """Up to 64 ceiling cells of each panorama, chosen by a hash, with the cells that mirror them."""
    cells = panos(part).select("pano", "row", "col", (F.col("s") % 4).alias("label"))
    found = matching.stochastic_pairs(cells, ["pano"], "row", "col", F.col("label") == 3, 20, 64, 5)
    return found.select("pano", F.col("row").alias("row_"), F.col("col").alias("col_"), "row2")


@query("SELECT c_custkey, c_nationkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
def merged_columns(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Two results' columns side by side, none of them twice."""
    left = customer.select("c_custkey", "c_nationkey")
    return signals.with_columns_once(left, orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), ["c_custkey"])


@query("SELECT lang, doc_id, len(string_split(text, ' ')) // 3 AS n_doors, CASE WHEN source IS NULL THEN 0 ELSE 2 END AS n_windows FROM documents WHERE text IS NOT NULL")
def element_counts(documents: DataFrame) -> DataFrame:
    lists = documents.where("text is not null").select("lang", "doc_id", F.split("text", " ", -1).alias("doors"), F.when(F.col("source").isNotNull(), F.sequence(F.lit(0), F.lit(6))).alias("windows"))
    found = signals.elements_of(lists, ["lang", "doc_id"], ["doors", "windows"])
    return found.select("lang", "doc_id", F.col("n_doors").cast("long").alias("n_doors"), F.col("n_windows").cast("int").alias("n_windows"))


@query(f"""
    SELECT o_orderkey, {_f("CASE WHEN s < 40 THEN 0.001 * (0.1 + 0.9 * s / 40.0) ELSE 0.001 * power(greatest(0.0, 1 - (s - 40) / 160.0), 0.9) END", 8)} AS rate FROM (SELECT o_orderkey, o_orderkey % 230 AS s FROM orders)
""")
def learning_rates(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", fixed(signals.learning_rate(F.col("o_orderkey") % 230, 40, 200, 0.001), 8).alias("rate"))


@query(f"SELECT s_suppkey, k::INTEGER AS k, {_f('s_acctbal + (s_nationkey * 100 - s_acctbal) * (k / 6)', 3)} AS at_ FROM supplier, range(7) AS t(k)")
def even_samples(supplier: DataFrame) -> DataFrame:
    ends = supplier.select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_nationkey") * 100).cast("double").alias("high"))
    return signals.evenly_between(ends, "low", "high", 7).select("s_suppkey", "k", fixed("at", 3).alias("at_"))


@query("""
    SELECT l_returnflag, floor(coalesce(sum(l_tax) FILTER (l_linenumber % 2 = 0), 0) * 100 + 0.5) / 100 AS total FROM lineitem GROUP BY ALL
""")
def total_losses(lineitem: DataFrame) -> DataFrame:
    from ..operators.evaluate import total_loss

    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("total_"), "l_shipmode")).otherwise(F.concat(F.lit("part_total_"), "l_shipmode")) if "l_shipmode" in lineitem.columns else F.when(F.col("l_linenumber") % 2 == 0, "total").otherwise("subtotal")
    return total_loss(lineitem.select("l_returnflag", name.alias("name"), F.col("l_tax").alias("value")), ["l_returnflag"]).select("l_returnflag", fixed("total", 2).alias("total"))


@query(rf"WITH f AS (SELECT p_partkey, p_brand || '_openings_' || CASE WHEN p_size % 3 = 0 THEN 'on_' ELSE '' END || p_size || '.npy' AS file FROM part) SELECT p_partkey, file FROM f WHERE NOT contains(file, '_openings_on_')")
def without_suffix(part: DataFrame) -> DataFrame:
    """Files of openings, without those that lie on other walls."""
    name = F.concat("p_brand", F.lit("_openings_"), F.when(F.col("p_size") % 3 == 0, "on_").otherwise(""), F.col("p_size").cast("string"), F.lit(".npy"))
    return part.select("p_partkey", name.alias("file")).where(~F.contains("file", F.lit("_openings_on_")))


@query()
def labels_in_views(part: DataFrame) -> DataFrame:
    """Seeds spread within each third of a panorama by itself."""
    cells = panos(part).select(
        "pano", F.col("row").cast("int").alias("m"), F.col("col").cast("int").alias("n"), F.col("v").alias("l"), F.col("s").cast("double").alias("a"), F.lit(0.0).alias("b"), F.when(F.col("s") % 10 == 0, F.col("s") % 3 + 1).otherwise(0).cast("int").alias("label")
    )
    return propagate.spread_labels_in_views(cells, "pano", 50)
