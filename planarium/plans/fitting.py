"""Queries of robust fitting: lines, affine maps, repeated extraction, normal equations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..operators import fitting as T
from . import query

_KEYS = ["p_brand", "p_type"]
_P = "p AS (SELECT p_brand, p_type, p_partkey AS id, p_size::DOUBLE AS x, p_retailprice - 900 AS y FROM part)"


def points(part: DataFrame, *more: Column) -> DataFrame:
    return part.select(*_KEYS, F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"), *more)


def _best(src: str, out: str) -> str:
    return f"""{out}h AS (
        SELECT a.p_brand, a.p_type, a.id AS i, b.id AS j, a.x AS ax, a.y AS ay, (b.x - a.x) / sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) AS dx, (b.y - a.y) / sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) AS dy
        FROM {src} a JOIN {src} b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.id < b.id AND (a.x <> b.x OR a.y <> b.y)
    ), {out}n AS (
        SELECT h.p_brand, h.p_type, i, j, any_value(ax) AS ax, any_value(ay) AS ay, any_value(dx) AS dx, any_value(dy) AS dy, count(*) FILTER (abs(dx * (y - ay) - dy * (x - ax)) <= 2.0) AS inliers, count(*) AS n
        FROM {out}h h JOIN {src} s ON s.p_brand = h.p_brand AND s.p_type = h.p_type GROUP BY ALL
    ), {out} AS (SELECT * FROM {out}n QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY inliers DESC, i, j) = 1)"""


@query(f"WITH {_P}, {_best('p', 'b')} SELECT p_brand, p_type, i, j, inliers, floor(inliers::DOUBLE / n * 1000000 + 0.5) / 1000000 AS share FROM b".replace("GROUP BY ALL", "GROUP BY h.p_brand, h.p_type, i, j"))
def ransac_exhaustive_line(part: DataFrame) -> DataFrame:
    return T.best_line(points(part), _KEYS, "id", "x", "y", 2.0).select(*_KEYS, "i", "j", "inliers", fixed("share", 6).alias("share"))


@query(
    f"""WITH {_P}, {_best('p', 'b')}, p2 AS (
        SELECT p.* FROM p JOIN b ON p.p_brand = b.p_brand AND p.p_type = b.p_type WHERE NOT abs(dx * (y - ay) - dy * (x - ax)) <= 2.0
    ), {_best('p2', 'c')}
    SELECT 1 AS round, p_brand, p_type, i, j, inliers FROM b UNION ALL SELECT 2, p_brand, p_type, i, j, inliers FROM c""".replace("GROUP BY ALL", "GROUP BY h.p_brand, h.p_type, i, j")
)
def fixpoint_extraction(part: DataFrame) -> DataFrame:
    """The best line, and the best of what it leaves."""
    return T.extract_lines(points(part), _KEYS, "id", "x", "y", 2.0, rounds=2).select("round", *_KEYS, "i", "j", "inliers")


@query("""
    WITH p AS (
        SELECT p_brand, p_type, p_partkey AS id, p_size::DOUBLE AS x, p_retailprice - 900 AS y, p_size * 1.1 + (p_partkey % 7) AS u, (p_retailprice - 900) * 0.9 - (p_partkey % 5) AS v FROM part
    ), h AS (
        SELECT p_brand, p_type, id, x AS x0, y AS y0, u AS u0, v AS v0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(u) OVER w AS u1, lead(v) OVER w AS v1,
            lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2, lead(u, 2) OVER w AS u2, lead(v, 2) OVER w AS v2 FROM p WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY id)
    ), d AS (SELECT *, (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) AS det FROM h WHERE x2 IS NOT NULL),
    a AS (
        SELECT p_brand, p_type, id, x0, y0, u0, v0, ((u1 - u0) * (y2 - y0) - (u2 - u0) * (y1 - y0)) / det AS a, ((x1 - x0) * (u2 - u0) - (x2 - x0) * (u1 - u0)) / det AS b,
            ((v1 - v0) * (y2 - y0) - (v2 - v0) * (y1 - y0)) / det AS c, ((x1 - x0) * (v2 - v0) - (x2 - x0) * (v1 - v0)) / det AS e FROM d WHERE abs(det) > 1e-9
    ), n AS (
        SELECT a.p_brand, a.p_type, a.id, count(*) FILTER (sqrt(power(u0 + a * (x - x0) + b * (y - y0) - u, 2) + power(v0 + c * (x - x0) + e * (y - y0) - v, 2)) > 3.0) AS outliers, count(*) AS n
        FROM a JOIN p ON a.p_brand = p.p_brand AND a.p_type = p.p_type GROUP BY a.p_brand, a.p_type, a.id
    )
    SELECT p_brand, p_type, id, outliers, n FROM n QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY outliers, id) = 1
""")
def affine_hypotheses(part: DataFrame) -> DataFrame:
    """Affine maps through three consecutive parts, judged by all parts of their group; the first of the best.

    u is a decimal, as in SQL: its differences are exact, which decides where an error is just the tolerance.
    """
    moved = points(part, F.expr("p_size * 1.1BD + p_partkey % 7").alias("u"), F.expr("(p_retailprice - 900) * 0.9D - p_partkey % 5").alias("v"))
    return T.best_affine(moved, _KEYS, "id", 3.0)


@query("""
    SELECT l_returnflag, i, j, floor(value + 0.5) AS value FROM (
        SELECT l_returnflag, unnest([0, 0, 0, 1, 1, 1, 2, 2, 2, 0, 1, 2]) AS i, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2, -1, -1, -1]) AS j,
            unnest([sum(a * a), sum(a * b), sum(a * c), sum(b * a), sum(b * b), sum(b * c), sum(c * a), sum(c * b), sum(c * c), sum(a * y), sum(b * y), sum(c * y)]) AS value
        FROM (SELECT l_returnflag, l_quantity AS a, l_discount AS b, l_tax AS c, l_extendedprice AS y FROM lineitem) GROUP BY l_returnflag)
""")
def normal_equations(lineitem: DataFrame) -> DataFrame:
    found = T.normal_equations(lineitem, ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return found.select("l_returnflag", "i", "j", fixed("value", 0).alias("value"))
