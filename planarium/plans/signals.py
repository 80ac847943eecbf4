"""Queries of signals, samples, shares and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..operators import signals as S
from . import query
from .rasters import _PANO, _f, panos

_HOURLY = "h AS (SELECT t.event_type, p.pos::INTEGER AS pos, coalesce(n, 0)::DOUBLE AS n FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN range(24) AS p(pos) LEFT JOIN (SELECT event_type, hour(ts) AS pos, count(*) AS n FROM events GROUP BY ALL) c ON c.event_type = t.event_type AND c.pos = p.pos)"


def hours(events: DataFrame) -> DataFrame:
    """(event_type, pos, n) for all 24 hours, empty ones as 0."""
    n = events.groupBy("event_type", F.hour(F.col("ts").cast("timestamp")).alias("pos")).agg(F.count("*").alias("n"))
    every = events.select("event_type").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return every.join(n, ["event_type", "pos"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))


@query(f"""
    WITH {_HOURLY}, w AS (SELECT *, coalesce(lead(n) OVER w, first(n) OVER w) AS m FROM h WINDOW w AS (PARTITION BY event_type ORDER BY pos))
    SELECT event_type, (pos * 4 + k)::INTEGER AS pos, {_f("n + (m - n) * (k / 4)")} AS n FROM w, range(4) AS t(k)
""")
def circular_upsample(events: DataFrame) -> DataFrame:
    found = S.upsampled(hours(events), ["event_type"], "pos", "n", 24, 4)
    return found.select("event_type", F.col("pos").cast("int").alias("pos"), fixed("n").alias("n"))


@query(f"""
    WITH p AS (SELECT p_brand, p_size::DOUBLE AS x, p_retailprice AS y FROM part), m AS (SELECT p_brand, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY ALL),
    r AS (SELECT p_brand, cx, cy, max(sqrt(power(x - cx, 2) + power(y - cy, 2))) AS reach FROM p JOIN m USING (p_brand) GROUP BY ALL)
    SELECT p_brand, k::INTEGER AS k, {_f("cx + greatest(2, 2 * reach) * cos(k * 2 * pi() / 6)", 3)} AS x, {_f("cy + greatest(2, 2 * reach) * sin(k * 2 * pi() / 6)", 3)} AS y FROM r, range(6) AS t(k)
""")
def fallback_ring(part: DataFrame) -> DataFrame:
    points = part.select("p_brand", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    found = S.ring(S.centre_and_reach(points, ["p_brand"]), 6)
    return found.select("p_brand", "k", fixed("x", 3).alias("x"), fixed("y", 3).alias("y"))


@query(f"""
    WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
    SELECT c_nationkey, c_mktsegment, n, {_f("(sum(n) OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment ROWS UNBOUNDED PRECEDING))::DOUBLE / sum(n) OVER (PARTITION BY c_nationkey)", 6)} AS share FROM n
""")
def cumulative_share(customer: DataFrame) -> DataFrame:
    sizes = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return S.cumulative_share(sizes, ["c_nationkey"], [F.desc("n"), F.col("c_mktsegment")], "n").withColumn("share", fixed("share", 6))


@query("""
    WITH p AS (SELECT p_brand, p_size / 10 AS x, p_retailprice / 20 AS y FROM part), m AS (SELECT p_brand, min(x) AS mx, min(y) AS my FROM p GROUP BY ALL)
    SELECT p_brand, (floor((y - my) * 4 + 0.5) + 3)::INTEGER AS row_, (floor((x - mx) * 4 + 0.5) + 3)::INTEGER AS col_, count(*) AS n FROM p JOIN m USING (p_brand) GROUP BY ALL
""")
def rasterise_points(part: DataFrame) -> DataFrame:
    points = part.select("p_brand", (F.col("p_size") / 10).alias("x"), (F.col("p_retailprice") / 20).alias("y"))
    return S.rasterised(points, ["p_brand"], 4.0, 3).select("p_brand", F.col("row").alias("row_"), F.col("col").alias("col_"), "n")


@query("""
    WITH s AS (SELECT s_suppkey AS id, s_nationkey AS k, (s_suppkey * 7 % 100)::DOUBLE AS lo, s_acctbal / 100 AS hi FROM supplier),
    c AS (SELECT k, id, floor(lo + (hi - lo) * (j / 9))::INTEGER AS cell FROM s, range(10) AS t(j))
    SELECT k, cell, max(id) AS label FROM c GROUP BY ALL
""")
def paint_arcs(supplier: DataFrame) -> DataFrame:
    arcs = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("k_"), (F.col("s_suppkey") * 7 % 100).cast("double").alias("lo"), (F.col("s_acctbal") / 100).alias("hi"))
    cells = S.evenly_between(arcs, "lo", "hi", 10).select(F.col("k_").alias("k"), F.floor("at").cast("int").alias("cell"), "id")
    return S.painted(cells, ["k", "cell"], "id")


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size % 3 END AS label FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def superpixel_lookup(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    labels = part.where("p_size % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 3).alias("label"))
    return S.labelled(lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), labels, ["l_partkey"]).select("l_orderkey", "l_linenumber", "label")


@query(f"""
    WITH {_PANO}, q AS (SELECT pano, r * 50 + c AS id, c * 0.9 + 3.4 AS x, r * 1.05 + 0.3 AS y FROM g), n AS (SELECT pano, r, c, r * 50 + c AS sp FROM g WHERE s > 25),
    o(k, i, j) AS (VALUES (0, 0, 0), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, 1), (5, 0, -1), (6, -1, 1), (7, -1, 0), (8, -1, -1)),
    h AS (SELECT q.pano, q.id, arg_min(n.sp, o.k) AS sp FROM q CROSS JOIN o JOIN n ON n.pano = q.pano AND n.r = floor(q.y)::INT + o.i AND n.c = floor(q.x)::INT + o.j GROUP BY ALL)
    SELECT q.pano, q.id, h.sp FROM q LEFT JOIN h ON h.pano = q.pano AND h.id = q.id
""")
def projected_cell_lookup(part: DataFrame) -> DataFrame:
    cells = panos(part).withColumn("sp", F.col("row") * 50 + F.col("col"))
    points = cells.select("pano", F.col("sp").alias("id"), (F.col("col") * 0.9 + 3.4).alias("x"), (F.col("row") * 1.05 + 0.3).alias("y"))
    return S.moved_to_cells(points, cells.where("s > 25"), ["pano"]).select("pano", "id", "sp")


@query(f"""
    WITH p AS (SELECT p_brand, abs(50 / tan(-(0.2 + p_size / 100.0)::DOUBLE)) * tan((0.1 + (p_retailprice - 900) / 200)::DOUBLE) AS z FROM part),
    q AS (SELECT p_brand, quantile_cont(z, 0.25) AS lo, quantile_cont(z, 0.75) AS hi FROM p GROUP BY ALL)
    SELECT p_brand, {_f("avg(z)")} AS z1 FROM p JOIN q USING (p_brand) WHERE z BETWEEN lo AND hi GROUP BY ALL
""")
def ceiling_height(part: DataFrame) -> DataFrame:
    boundary = part.select("p_brand", (-(0.2 + F.col("p_size") / 100.0)).alias("v1"), (0.1 + (F.col("p_retailprice") - 900) / 200).alias("v0"))
    return S.ceiling_height(boundary, ["p_brand"]).select("p_brand", fixed("z1").alias("z1"))
