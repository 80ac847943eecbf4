"""Queries of joins by nearness, over embeddings, events, parts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numbers import fixed
from ..operators import matching as M
from ..operators.graphs import connected_components as components_of
from . import query

_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


def _sides(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = vectors(embeddings)
    return v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("q_id"), F.col("e").alias("q")), v.where("vec_id % 2 = 1").select(F.col("vec_id").alias("t_id"), F.col("e").alias("t"))


@query(f"""
    WITH {_V}, p AS (
        SELECT a.vec_id AS q_id, b.vec_id AS t_id, list_distance(a.e, b.e) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS k
        FROM v a JOIN v b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1
    )
    SELECT a.q_id, a.t_id, floor(a.d * 10000 + 0.5) / 10000 AS d1, floor(b.d * 10000 + 0.5) / 10000 AS d2
    FROM p a JOIN p b ON a.q_id = b.q_id AND a.k = 1 AND b.k = 2 WHERE a.d < 0.95 * b.d
""")
def knn2_ratio_match(embeddings: DataFrame) -> DataFrame:
    found = M.ratio_matches(*_sides(embeddings), 0.95)
    return found.select("q_id", "t_id", fixed("d1").alias("d1"), fixed("d2").alias("d2"))


@query(f"""
    WITH {_V}, p AS (
        SELECT a.vec_id AS q_id, b.vec_id AS t_id, list_inner_product(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1
    ), x AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, t_id) = 1),
    y AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY t_id ORDER BY score DESC, q_id) = 1)
    SELECT q_id, t_id, floor(x.score * 10000 + 0.5) / 10000 AS score FROM x JOIN y USING (q_id, t_id)
""")
def mutual_nearest(embeddings: DataFrame) -> DataFrame:
    return M.mutual_matches(*_sides(embeddings)).select("q_id", "t_id", fixed("score").alias("score"))


_GRID = "g AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, p_retailprice AS v, p_size AS s FROM part)"


def grid(part: DataFrame) -> DataFrame:
    return part.select(F.expr("p_partkey div 50").alias("r"), (F.col("p_partkey") % 50).alias("c"), F.col("p_retailprice").alias("v"), F.col("p_size").alias("s"))


@query(f"""
    WITH {_GRID}, p AS (
        SELECT a.r, a.c AS col, b.c AS i, abs(a.v - b.v) AS d FROM g a JOIN g b ON a.r = b.r AND b.c < a.c
    ), m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY r, col ORDER BY d, i) = 1)
    SELECT g.r, g.c AS col, CASE WHEN m.i IS NULL THEN g.c ELSE g.c - m.i END AS disparity FROM g LEFT JOIN m ON g.r = m.r AND g.c = m.col
""")
def row_disparity(part: DataFrame) -> DataFrame:
    g = grid(part)
    right = g.select("r", F.col("c").alias("i"), F.col("v").alias("w"))
    pairs = g.join(right, "r").where("i < c").withColumn("d", F.abs(F.col("v") - F.col("w")))
    best = M.nearest_first(pairs, ["r", "c"], "d", "i", ["i"])
    return g.join(best, ["r", "c"], "left").select("r", F.col("c").alias("col"), F.coalesce(F.col("c") - F.col("i"), F.col("c")).alias("disparity"))


@query("""
    SELECT a.event_id AS a, b.event_id AS b, floor(abs(a.value - b.value) * 10000 + 0.5) / 10000 AS gap
    FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.value - b.value) <= 0.5
""")
def band_join(events: DataFrame) -> DataFrame:
    a = events.select("user_id", F.col("event_id").alias("a"), F.col("value").alias("x"))
    b = events.select("user_id", F.col("event_id").alias("b"), F.col("value").alias("y"))
    met = M.band_join(a, b, ["user_id"], "x", "y", 0.5).where("a < b")
    return met.select("a", "b", fixed(F.abs(F.col("x") - F.col("y"))).alias("gap"))


@query(f"""
    WITH {_GRID}
    SELECT a.r, a.c, count(*) AS n, floor(avg(b.v) * 10000 + 0.5) / 10000 AS mean, min(b.s) AS least
    FROM g a JOIN g b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND NOT (a.r = b.r AND a.c = b.c) GROUP BY ALL
""")
def offset_neighbour_join(part: DataFrame) -> DataFrame:
    near = M.grid_neighbours(grid(part), [], "r", "c", ["v", "s"])
    return near.groupBy("r", "c").agg(F.count("*").alias("n"), fixed(F.avg("v_near")).alias("mean"), F.min("s_near").alias("least"))


@query(f"WITH {_GRID} SELECT a.r, a.c, a.v, b.v AS v_mirror FROM g a JOIN g b ON b.r = 40 - a.r AND a.c = b.c WHERE a.r < 20 AND b.r > 20")
def reflect_self_join(part: DataFrame) -> DataFrame:
    return M.reflected(grid(part).select("r", "c", "v"), [], "r", "c", "v", 20)


_SEG = "s AS (SELECT s_suppkey AS id, s_nationkey AS k, s_acctbal / 1000 AS x1, (s_suppkey * 7 % 100)::DOUBLE AS y1, (s_suppkey * 13 % 100)::DOUBLE AS x2, s_acctbal / 500 AS y2 FROM supplier)"


def _segments(supplier: DataFrame, tag: str) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        F.col("s_nationkey").alias("k"), key.alias(f"id{tag}"), (F.col("s_acctbal") / 1000).alias(f"x1{tag}"), (key * 7 % 100).cast("double").alias(f"y1{tag}"), (key * 13 % 100).cast("double").alias(f"x2{tag}"), (F.col("s_acctbal") / 500).alias(f"y2{tag}")
    )


def _pairs(supplier: DataFrame) -> tuple[DataFrame, list]:
    both = _segments(supplier, "a").join(_segments(supplier, "b"), "k").where("ida < idb")
    return both, [F.col(c) for c in ("x1a", "y1a", "x2a", "y2a", "x1b", "y1b", "x2b", "y2b")]


@query(f"""
    WITH {_SEG}, p AS (SELECT a.id AS a, b.id AS b, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS den,
        (b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1) AS num, a.x1, a.y1, a.x2, a.y2 FROM s a JOIN s b ON a.k = b.k AND a.id < b.id)
    SELECT a, b, floor((x1 + num / den * (x2 - x1)) * 100 + 0.5) / 100 AS x, floor((y1 + num / den * (y2 - y1)) * 100 + 0.5) / 100 AS y FROM p WHERE abs(den) >= 1e-9
""")
def segment_intersections(supplier: DataFrame) -> DataFrame:
    both, ends = _pairs(supplier)
    x, y = G.crossing(*ends)
    return both.select(F.col("ida").alias("a"), F.col("idb").alias("b"), fixed(x, 2).alias("x"), fixed(y, 2).alias("y")).where("x is not null")


@query(f"""
    WITH {_SEG}
    SELECT a.id AS a, b.id AS b, floor(((a.x2 - a.x1) * (b.x2 - b.x1) + (a.y2 - a.y1) * (b.y2 - b.y1))
        / nullif(sqrt(power(a.x2 - a.x1, 2) + power(a.y2 - a.y1, 2)) * sqrt(power(b.x2 - b.x1, 2) + power(b.y2 - b.y1, 2)), 0) * 1000000 + 0.5) / 1000000 AS alike,
        greatest(abs(a.y1 - b.y1), abs(a.y2 - b.y2)) AS y_sep, least(abs(a.x1 - b.x1), abs(a.x2 - b.x2)) AS x_sep
    FROM s a JOIN s b ON a.k = b.k AND a.id < b.id
""")
def self_theta_join(supplier: DataFrame) -> DataFrame:
    both, e = _pairs(supplier)
    y_sep = F.greatest(F.abs(e[1] - e[5]), F.abs(e[3] - e[7]))
    x_sep = F.least(F.abs(e[0] - e[4]), F.abs(e[2] - e[6]))
    return both.select(F.col("ida").alias("a"), F.col("idb").alias("b"), fixed(G.similarity(*e), 6).alias("alike"), y_sep.alias("y_sep"), x_sep.alias("x_sep"))


@query("""
    WITH e(edge, ax, ay, cx, cy) AS (VALUES (0, 0.0, 0.0, 10.0, 0.0), (1, 10.0, 0.0, 10.0, 8.0), (2, 10.0, 8.0, 0.0, 8.0), (3, 0.0, 8.0, 0.0, 0.0)),
    p AS (SELECT o_orderkey AS id, (o_custkey % 14)::DOUBLE - 2 AS px, (o_orderkey % 12)::DOUBLE - 2 AS py FROM orders),
    t AS (SELECT *, greatest(0, least(1, ((px - ax) * (cx - ax) + (py - ay) * (cy - ay)) / (power(cx - ax, 2) + power(cy - ay, 2))))::DOUBLE AS t FROM p, e),
    d AS (SELECT id, edge, ax + t * (cx - ax) AS x, ay + t * (cy - ay) AS y, sqrt(power(px - (ax + t * (cx - ax)), 2) + power(py - (ay + t * (cy - ay)), 2)) AS d FROM t)
    SELECT id, edge, floor(x * 10000 + 0.5) / 10000 AS x, floor(y * 10000 + 0.5) / 10000 AS y, floor(d * 10000 + 0.5) / 10000 AS d
    FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, edge) = 1
""")
def nearest_edge_projection(orders: DataFrame) -> DataFrame:
    from ..operators.layout import nearest_edge

    points = orders.select(F.col("o_orderkey").alias("id"), ((F.col("o_custkey") % 14).cast("double") - 2).alias("px"), ((F.col("o_orderkey") % 12).cast("double") - 2).alias("py"))
    corners = [(0.0, 0.0), (10.0, 0.0), (10.0, 8.0), (0.0, 8.0)]
    found = nearest_edge(points, corners)
    return found.select("id", "edge", fixed("x").alias("x"), fixed("y").alias("y"), fixed("d").alias("d"))


@query("""
    WITH g AS (SELECT p_brand, p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part),
    n AS (
        SELECT a.p_brand, a.p_partkey AS p, b.p_partkey AS t, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1
        QUALIFY row_number() OVER (PARTITION BY a.p_brand, a.p_partkey ORDER BY d, b.p_partkey) = 1
    ), m AS (SELECT p_brand, count(DISTINCT t) AS k FROM n WHERE d <= 1.0 GROUP BY ALL),
    c AS (SELECT p_brand, count(*) FILTER (p_partkey % 2 = 0) AS preds, count(*) FILTER (p_partkey % 2 = 1) AS gts FROM g GROUP BY ALL)
    SELECT p_brand, floor(coalesce(k, 0)::DOUBLE / preds * 1000000 + 0.5) / 1000000 AS precision_, floor(coalesce(k, 0)::DOUBLE / gts * 1000000 + 0.5) / 1000000 AS recall_,
        floor(2 * coalesce(k, 0)::DOUBLE / (preds + gts) * 1000000 + 0.5) / 1000000 AS f FROM c LEFT JOIN m USING (p_brand)
""")
def corner_prf(part: DataFrame) -> DataFrame:
    from ..operators.evaluate import corner_scores

    g = part.select(F.col("p_brand").alias("room"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    s = corner_scores(g.where("id % 2 = 0"), g.where("id % 2 = 1"), ["room"], 1.0)
    return s.select(F.col("room").alias("p_brand"), fixed("precision_", 6).alias("precision_"), fixed("recall_", 6).alias("recall_"), fixed("f", 6).alias("f"))


@query("""
    WITH RECURSIVE c AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer),
    e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id <> b.id AND abs(a.v - b.v) <= 0.5),
    r AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
    SELECT node, min(root) AS root FROM r GROUP BY node
""")
def connected_components(customer: DataFrame) -> DataFrame:
    return components_of(M.linked_within(customer, "c_custkey", "c_acctbal", 0.5))


@query(f"""
    WITH {_V}, n AS (SELECT * FROM (VALUES (0, 0.0, 1.0, 1.618033988749895), (1, 1.618033988749895, 0.0, 1.0), (2, 1.0, 1.618033988749895, 0.0),
        (3, 0.0, -1.0, 1.618033988749895), (4, 1.618033988749895, 0.0, -1.0), (5, -1.0, 1.618033988749895, 0.0)) AS t(dir, x, y, z)),
    p AS (SELECT vec_id, dir, abs(e[1] * x + e[2] * y + e[3] * z) / sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3]) / sqrt(x * x + y * y + z * z) AS d, e[4] AS w FROM v, n)
    SELECT dir, count(*) AS n, floor(sum(abs(w)) * 100 + 0.5) / 100 AS votes FROM p WHERE d < cos(radians(60)) GROUP BY ALL
""")
def arc_votes(embeddings: DataFrame) -> DataFrame:
    from ..operators.lines import votes

    g = 1.618033988749895
    e = [F.col("e")[k] for k in range(4)]
    arcs = vectors(embeddings).select(*(x.alias(n) for x, n in zip(e, ("nx", "ny", "nz"))), F.abs(e[3]).alias("weight"))
    found = votes(arcs, [(0.0, 1.0, g), (g, 0.0, 1.0), (1.0, g, 0.0), (0.0, -1.0, g), (g, 0.0, -1.0), (-1.0, g, 0.0)], 60.0)
    return found.select("dir", "n", fixed("votes", 2).alias("votes"))


@query("""
    WITH i AS (SELECT event_id AS id, user_id, value / 100 % 1 AS lo, (value / 100 + 0.4) % 1 AS hi FROM events)
    SELECT a.id AS a, count(*) AS n FROM i a JOIN i b ON a.user_id = b.user_id AND a.id < b.id WHERE
        ((CASE WHEN b.lo <= b.hi THEN a.lo BETWEEN b.lo AND b.hi ELSE a.lo >= b.lo OR a.lo <= b.hi END) OR (CASE WHEN b.lo <= b.hi THEN a.hi BETWEEN b.lo AND b.hi ELSE a.hi >= b.lo OR a.hi <= b.hi END)
        OR (CASE WHEN a.lo <= a.hi THEN b.lo BETWEEN a.lo AND a.hi ELSE b.lo >= a.lo OR b.lo <= a.hi END) OR (CASE WHEN a.lo <= a.hi THEN b.hi BETWEEN a.lo AND a.hi ELSE b.hi >= a.lo OR b.hi <= a.hi END)) GROUP BY ALL
""")
def circular_overlap(events: DataFrame) -> DataFrame:
    v = F.col("value") / 100
    i = events.select("user_id", F.col("event_id").alias("a"), (v % 1).alias("a0"), ((v + 0.4) % 1).alias("a1"))
    j = i.select("user_id", F.col("a").alias("b"), F.col("a0").alias("b0"), F.col("a1").alias("b1"))
    met = i.join(j, "user_id").where("a < b")
    return met.where(G.intervals_meet(*(F.col(c) for c in ("a0", "a1", "b0", "b1")))).groupBy("a").agg(F.count("*").alias("n"))


@query("""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    k AS (SELECT label, n, unnest(list_distinct(list_transform(range(20), lambda j: round_even(j * (n - 1)::DOUBLE / 19, 0)::BIGINT))) AS i FROM (SELECT DISTINCT label, n FROM n))
    SELECT n.label, n.vec_id FROM n JOIN k ON n.label = k.label AND n.i = k.i
""")
def even_subsample(embeddings: DataFrame) -> DataFrame:
    from ..operators.evaluate import evenly_spaced

    return evenly_spaced(embeddings.select("label", "vec_id"), ["label"], "vec_id", 20).select("label", "vec_id")


@query("""
    SELECT l_returnflag, count(*) AS n, floor(avg(abs(l_quantity - l_tax * 100)) * 10000 + 0.5) / 10000 AS mae,
        floor(sqrt(avg(power(l_quantity - l_tax * 100, 2))) * 10000 + 0.5) / 10000 AS rmse,
        floor(avg(CASE WHEN greatest(l_quantity / (l_tax * 100), l_tax * 100 / l_quantity) < 1.25 THEN 1.0 ELSE 0.0 END) * 1000000 + 0.5) / 1000000 AS delta1
    FROM lineitem WHERE l_tax > 0 GROUP BY ALL
""")
def depth_metrics(lineitem: DataFrame) -> DataFrame:
    from ..operators.evaluate import depth_errors

    pairs = lineitem.select("l_returnflag", F.col("l_quantity").alias("pred"), (F.col("l_tax") * 100).alias("truth"))
    s = depth_errors(pairs, ["l_returnflag"])
    return s.select("l_returnflag", "n", fixed("mae").alias("mae"), fixed("rmse").alias("rmse"), fixed("delta1", 6).alias("delta1"))


@query("""
    SELECT count(*) AS n, floor(avg((quality = toxic)::INT::DOUBLE) * 1000000 + 0.5) / 1000000 AS accuracy,
        floor(avg(CASE WHEN quality = 1 THEN (toxic = 0)::INT::DOUBLE END) * 1000000 + 0.5) / 1000000 AS false_negatives,
        floor(avg(CASE WHEN quality = 0 THEN (toxic = 0)::INT::DOUBLE END) * 1000000 + 0.5) / 1000000 AS true_negatives FROM labels
""")
def seg_accuracy(labels: DataFrame) -> DataFrame:
    hit = lambda c: c.cast("int").cast("double")
    q, t = F.col("quality"), F.col("toxic")
    return labels.agg(
        F.count("*").alias("n"), fixed(F.avg(hit(q == t)), 6).alias("accuracy"), fixed(F.avg(F.when(q == 1, hit(t == 0))), 6).alias("false_negatives"), fixed(F.avg(F.when(q == 0, hit(t == 0))), 6).alias("true_negatives")
    )


@query("""
    WITH d AS (SELECT l_linestatus, abs(l_quantity - l_tax * 400) AS d, l_tax / 0.1 AS p, (l_returnflag = 'R')::INT::DOUBLE AS y FROM lineitem)
    SELECT l_linestatus, floor(avg(d) * 10000 + 0.5) / 10000 AS l1, floor(avg(d * d) * 1000 + 0.5) / 1000 AS l2,
        floor(avg(CASE WHEN d < 1 THEN 0.5 * d * d ELSE d - 0.5 END) * 10000 + 0.5) / 10000 AS huber,
        floor(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))) * 10000 + 0.5) / 10000 AS bce FROM d GROUP BY ALL
""")
def losses(lineitem: DataFrame) -> DataFrame:
    from ..operators.evaluate import loss_terms

    rows = lineitem.select("l_linestatus", F.col("l_quantity").alias("pred"), (F.col("l_tax") * 400).alias("truth"), (F.col("l_tax") / 0.1).alias("p"), (F.col("l_returnflag") == "R").cast("int").cast("double").alias("y"))
    s = rows.groupBy("l_linestatus").agg(*loss_terms())
    return s.select("l_linestatus", fixed("l1").alias("l1"), fixed("l2", 3).alias("l2"), fixed("huber").alias("huber"), fixed("bce").alias("bce"))


@query("""
    WITH r AS (SELECT p_partkey AS id, p_brand, (p_partkey % 37)::DOUBLE AS x, (p_partkey % 41)::DOUBLE AS y, p_size::DOUBLE / 4 + 1 AS w, (p_retailprice - 895) / 5 AS h FROM part),
    o AS (SELECT a.p_brand, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s
        FROM r a JOIN r b ON a.p_brand = b.p_brand AND b.id = a.id + 25)
    SELECT p_brand, count(*) AS n, count(*) FILTER (i > 0) AS hits, floor(avg(CASE WHEN i > 0 THEN i / (s - i) END) * 1000000 + 0.5) / 1000000 AS mean_iou FROM o GROUP BY ALL
""")
def iou_axis_aligned(part: DataFrame) -> DataFrame:
    from ..operators.evaluate import box_overlap

    key = F.col("p_partkey")
    r = part.select(key.alias("id"), "p_brand", (key % 37).cast("double").alias("x"), (key % 41).cast("double").alias("y"), (F.col("p_size") / 4 + 1).alias("w"), ((F.col("p_retailprice") - 895) / 5).alias("h"))
    b = r.select((F.col("id") - 25).alias("id"), "p_brand", *(F.col(c).alias(f"{c}2") for c in "xywh"))
    met = r.join(b, ["id", "p_brand"]).withColumn("i", box_overlap(*(F.col(c) for c in ("x", "y", "w", "h", "x2", "y2", "w2", "h2"))))
    iou = F.when(F.col("i") > 0, F.col("i") / (F.expr("w * h + w2 * h2") - F.col("i")))
    return met.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("i") > 0).alias("hits"), fixed(F.avg(iou), 6).alias("mean_iou"))
