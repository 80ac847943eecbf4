"""Rooms as rectangles: nearest edges, corner order, hulls, least rectangles and areas of overlap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def nearest_edge(points: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """points (px, py, ...) with the nearest edge of a polygon, the place on it and the distance; the first of equals.

    The corners are a few constants, so every edge is a struct in the row: no join, no shuffle.
    """
    edges = []
    for k, (a, b) in enumerate(zip(corners, [*corners[1:], corners[0]])):
        x, y, d = G.clamped_projection(F.col("px"), F.col("py"), *(F.lit(float(v)) for v in (*a, *b)))
        edges.append(F.struct(d.alias("d"), F.lit(k).alias("edge"), x.alias("x"), y.alias("y")))
    best = points.withColumn("_e", F.array_min(F.array(*edges)))
    return best.select(*points.columns, "_e.edge", "_e.x", "_e.y", "_e.d")


def openings_on_rectangle(points: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, px, py, ...) projected to the nearest edge of their room's rectangle (keys, corners: array of x, y)."""
    joined = points.join(rects.select(*keys, "corners"), keys)
    n = F.size("corners")
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("edge"), F.col("corners")[k].alias("a"), F.col("corners")[F.pmod(k + 1, n)].alias("b")))

    def place(s):
        x, y, d = G.clamped_projection(F.col("px"), F.col("py"), s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])
        return F.struct(d.alias("d"), s["edge"].alias("edge"), x.alias("x"), y.alias("y"))

    best = joined.withColumn("_e", F.array_min(F.transform(sides, place)))
    return best.select(*points.columns, "_e.edge", "_e.x", "_e.y", "_e.d")


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counter-clockwise; fewer than three distinct points are returned as they are."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def least_rectangle(points: np.ndarray) -> tuple[np.ndarray, float]:
    """(four corners by angle about their middle, area) of the least rectangle around points: one side lies on the hull."""
    h = hull(points)
    if len(h) < 3:
        low, high = h.min(0), h.max(0)
        return np.array([low, [high[0], low[1]], high, [low[0], high[1]]]), 0.0
    side = np.roll(h, -1, 0) - h
    best = None
    for angle in np.unique(np.round(np.mod(np.arctan2(side[:, 1], side[:, 0]), math.pi / 2), 12)):
        turn = np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]])
        t = h @ turn.T
        low, high = t.min(0), t.max(0)
        area = float(np.prod(high - low))
        if best is None or area < best[1] - 1e-12:
            best = np.array([low, [high[0], low[1]], high, [low[0], high[1]]]) @ turn, area
    corners = best[0]
    middle = corners.mean(0)
    return corners[np.argsort(np.arctan2(corners[:, 1] - middle[1], corners[:, 0] - middle[0]), kind="stable")], best[1]


def least_rectangles(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, corner_ix, x, y, area): the least rectangle around each room's outline.

    A hull needs its points together. What comes here are outlines, envelopes of a room's bins, so a group is small
    however many points the room had.
    """
    kind = dict(points.dtypes)[key]

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        corners, area = least_rectangle(rows[[x, y]].to_numpy(float))
        return pd.DataFrame({key: rows[key].iloc[0], "corner_ix": range(4), "x": corners[:, 0], "y": corners[:, 1], "area": area})

    return points.select(key, x, y).groupBy(key).applyInPandas(step, f"{key} {kind}, corner_ix int, x double, y double, area double")


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a convex polygon inside another, both counter-clockwise."""
    out = subject
    for a, b in zip(window, np.roll(window, -1, 0)):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for k in range(len(out)):
            p, q, s, t = out[k - 1], out[k], side[k - 1], side[k]
            if (s < 0) != (t < 0):
                kept.append(p + (q - p) * (s / (s - t)))
            if t >= 0:
                kept.append(q)
        out = np.array(kept).reshape(-1, 2)
    return out


def area(polygon: np.ndarray) -> float:
    if len(polygon) < 3:
        return 0.0
    x, y = polygon[:, 0], polygon[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union of two convex polygons, 0 where neither has an area."""
    a, b = hull(a), hull(b)
    shared = area(clip(a, b)) if len(a) > 2 and len(b) > 2 else 0.0
    whole = area(a) + area(b) - shared
    return shared / whole if whole > 0 else 0.0
