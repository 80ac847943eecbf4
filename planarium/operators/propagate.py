"""Labels on superpixel grids, wall corners, and rooms' main directions: work that goes in order within one panorama."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_labels(cells: DataFrame, key: str, least: int = 1) -> DataFrame:
    """(key, m, n, label): seeds' labels spread to unlabelled neighbours, the nearest in colour first.

    cells has the panorama's key, grid place m, n, colour l, a, b and label (0 unknown). The edge of least colour
    difference anywhere on the frontier is taken next, not the shortest path; a cell is labelled when its first edge is
    taken, and rows under `least` are never entered. Columns do not wrap. A panorama's grid is one group of some 1,500.
    """
    kind = dict(cells.dtypes)[key]

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["m", "n"])
        place = {(m, n): k for k, (m, n) in enumerate(zip(rows["m"], rows["n"]))}
        colour, label = rows[["l", "a", "b"]].to_numpy(float), rows["label"].to_numpy(int).copy()
        where = list(place)

        def open_(k: int) -> list[tuple[float, int, int]]:
            m, n = where[k]
            near = (place.get((m + i, n + j)) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and m + i >= least)
            return [(float(np.linalg.norm(colour[k] - colour[q])), k, q) for q in near if q is not None and label[q] == 0]

        heap = [e for k in np.flatnonzero(label) for e in open_(int(k))]
        heapify(heap)
        while heap:
            _, k, q = heappop(heap)
            if label[q]:
                continue
            label[q] = label[k]
            for e in open_(q):
                heappush(heap, e)
        return pd.DataFrame({key: rows[key], "m": rows["m"], "n": rows["n"], "label": label})

    return cells.select(key, "m", "n", "l", "a", "b", "label").groupBy(key).applyInPandas(step, f"{key} {kind}, m int, n int, label int")


def spread_labels_in_views(cells: DataFrame, key: str, width: int, views: int = 3, least: int = 1) -> DataFrame:
    """(key, m, n, label): spread_labels() in each of `views` equal parts of a panorama's columns by itself."""
    part = F.floor(F.col("n") * views / width).cast("int")
    own = cells.withColumn("_view", F.struct(F.col(key).alias("k"), part.alias("v")))
    names = own.select("_view").distinct().withColumn("_id", F.xxhash64("_view.k", "_view.v"))
    spread = spread_labels(own.withColumn("_id", F.xxhash64("_view.k", "_view.v")), "_id", least)
    return spread.join(names, "_id").select(F.col("_view.k").alias(key), "m", "n", "label")


def cuboid_walls(columns: DataFrame, key: str) -> DataFrame:
    """(key, wall, axis, at): four walls, y and x in turn, at the medians of the floor boundary's segments (key, segment, x, y)."""
    at = F.when(F.col("segment") % 2 == 0, F.col("y")).otherwise(F.col("x"))
    grouped = columns.where("segment between 0 and 3").groupBy(key, F.col("segment").alias("wall")).agg(F.median(at).alias("at"))
    return grouped.select(key, "wall", F.when(F.col("wall") % 2 == 0, "y").otherwise("x").alias("axis"), "at")


def main_direction(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, degrees, n): the angle of each group's longest axis, in closed form from its covariances."""
    s = points.groupBy(*keys).agg(F.covar_samp("x", "y").alias("xy"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.count("*").alias("n"))
    return s.select(*keys, F.degrees(0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).alias("degrees"), "n")


def is_simple(corners: DataFrame, key: str) -> DataFrame:
    """(key, simple): whether a polygon (key, seq, x, y) has no two sides that cross."""
    from ..functions import geometry as G
    from .sequences import cyclic_pairs

    sides = cyclic_pairs(corners.select(key, "seq", "x", "y"), [key], "seq", ["x", "y"])
    other = sides.select(key, F.col("seq").alias("seq2"), *(F.col(c).alias(f"{c}2") for c in ("x", "y", "x_next", "y_next")))
    met = sides.join(other, key).where("seq < seq2")
    a, b, c, d = (F.col("x"), F.col("y")), (F.col("x_next"), F.col("y_next")), (F.col("x2"), F.col("y2")), (F.col("x_next2"), F.col("y_next2"))
    turn = lambda p, q, r: F.signum(G.cross(q[0] - p[0], q[1] - p[1], r[0] - p[0], r[1] - p[1]))
    cross = (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
    bad = met.where(cross).select(key).distinct().withColumn("_bad", F.lit(True))
    return corners.select(key).distinct().join(bad, key, "left").select(key, F.col("_bad").isNull().alias("simple"))


def with_fallback(general: DataFrame, cuboid: DataFrame, key: str) -> DataFrame:
    """The general layout's corners where it is a simple polygon of four corners or more, else the cuboid's."""
    sizes = general.groupBy(key).agg(F.count("*").alias("_n"))
    good = is_simple(general, key).join(sizes, key).where("simple and _n >= 4").select(key)
    return general.join(good, key, "left_semi").unionByName(cuboid.join(good, key, "left_anti"))
