"""Signals by image column, samples along lines and arcs, heights from boundaries, and lookups by cell."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import lerp


def upsampled(signal: DataFrame, keys: list[str], pos: str, value: str, size: int, factor: int) -> DataFrame:
    """A ring of `size` samples as one of size x factor, linear between neighbours, the last one's being the first."""
    w = Window.partitionBy(*keys).orderBy(pos)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = signal.withColumn("_next", F.coalesce(F.lead(value).over(w), F.first(value).over(whole))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return after.select(*keys, (F.col(pos) * factor + F.col("_k")).alias(pos), lerp(F.col(value), F.col("_next"), F.col("_k") / factor).alias(value))


def padded(signal: DataFrame, pos: str, size: int, by: int) -> DataFrame:
    """A ring's samples with `by` copies beyond either end, at places -by to size + by - 1."""
    left = signal.where(F.col(pos) >= size - by).withColumn(pos, F.col(pos) - size)
    return left.unionByName(signal).unionByName(signal.where(F.col(pos) < by).withColumn(pos, F.col(pos) + size))


def evenly_between(rows: DataFrame, low: str, high: str, n: int, name: str = "at") -> DataFrame:
    """rows, each n times, with n evenly spaced values from low to high."""
    t = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    return rows.select("*", t).withColumn(name, lerp(F.col(low), F.col(high), F.col("k") / max(1, n - 1)))


def centre_and_reach(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cx, cy, reach): the middle of each group's points and the distance of the farthest."""
    middle = points.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    far = points.join(middle, keys).groupBy(*keys, "cx", "cy")
    return far.agg(F.max(F.expr("sqrt(pow(x - cx, 2) + pow(y - cy, 2))")).alias("reach"))


def ring(centres: DataFrame, n: int, least: float = 2.0, times: float = 2.0) -> DataFrame:
    """centres (..., cx, cy, reach), each with n targets x, y at equal angles, at least so far and `times` the reach away."""
    radius = F.greatest(F.lit(least), times * F.col("reach"))
    out = centres.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    angle = F.col("k") * (2 * math.pi / n)
    return out.withColumn("x", F.col("cx") + radius * F.cos(angle)).withColumn("y", F.col("cy") + radius * F.sin(angle))


def cumulative_share(sizes: DataFrame, keys: list[str], order: list[Column], size: str) -> DataFrame:
    """sizes with `share`: how much of each group's total the rows so far in order explain."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("share", F.sum(size).over(w).cast("double") / F.sum(size).over(Window.partitionBy(*keys)))


def rasterised(points: DataFrame, keys: list[str], scale: float, pad: int) -> DataFrame:
    """(keys, row, col, n): how many points fall on each pixel, the least coordinates at `pad`, half away from zero."""
    ends = points.groupBy(*keys).agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    at = lambda c: (F.floor((F.col(c) - F.col(f"_{c}")) * scale + 0.5) + pad).cast("int")
    return points.join(ends, keys).groupBy(*keys, at("y").alias("row"), at("x").alias("col")).agg(F.count("*").alias("n"))


def painted(cells: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, label): of all that is painted on a cell, what comes last in order."""
    return cells.groupBy(*keys).agg(F.max(order).alias("label"))


def labelled(pixels: DataFrame, labels: DataFrame, on: list[str], default: int = 0) -> DataFrame:
    """pixels with the label of their superpixel, or the default."""
    return pixels.join(labels.select(*on, "label"), on, "left").withColumn("label", F.coalesce("label", F.lit(default)))


def moved_to_cells(points: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, id, x, y) with `sp`, the superpixel whose pixel they fall on, or the one of the last of the eight
    pixels around that has one; none outside the image."""
    around = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate([(0, 0), *((i, j) for i in (1, 0, -1) for j in (1, 0, -1) if i or j)])))
    # each pixel says its superpixel to those around it; tables of pixels are as large as points, so neither is broadcast
    told = cells.where("sp is not null").select(*keys, "row", "col", "sp", F.explode(around).alias("o"))
    told = told.groupBy(*keys, (F.col("row") - F.col("o.i")).cast("int").alias("_y"), (F.col("col") - F.col("o.j")).cast("int").alias("_x")).agg(F.min_by("sp", "o.rank").alias("sp"))
    placed = points.withColumn("_y", F.floor("y").cast("int")).withColumn("_x", F.floor("x").cast("int"))
    return placed.join(told.hint("merge"), [*keys, "_y", "_x"], "left").select(*points.columns, "sp")


def with_columns_once(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Both tables' columns by key; a column that both have, keys apart, is an error."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    if both:
        raise ValueError(f"columns given twice: {sorted(both)}")
    return left.join(right, on)


def elements_of(lists: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n_<column>...): a third of each list's length, as every element has three entries."""
    return lists.select(*keys, *(F.expr(f"coalesce(size({c}), 0) div 3").alias(f"n_{c}") for c in columns))


def ceiling_height(boundary: DataFrame, keys: list[str], floor: float = 50.0) -> DataFrame:
    """(keys, z1): the height of the ceiling above the camera, from latitudes v0 above and v1 below by column.

    Each column gives the floor's distance from its own height, and the ceiling's height at that distance; the mean of
    the middle half is taken.
    """
    from .sequences import interquartile_mean

    z = boundary.withColumn("_z", F.abs(floor / F.tan("v1")) * F.tan("v0"))
    return interquartile_mean(z, keys, "_z").select(*keys, F.col("mean").alias("z1"))


def learning_rate(step: Column, warm: int, total: int, base: float, power: float = 0.9, start: float = 0.1) -> Column:
    """Linear warm-up from a share of the base rate, then polynomial decay to 0."""
    up = base * (start + (1 - start) * step / max(1, warm))
    down = base * F.pow(F.greatest(F.lit(0.0), 1 - (step - warm) / max(1, total - warm)), F.lit(power))
    return F.when(step < warm, up).otherwise(down)
