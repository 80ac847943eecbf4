"""From a labelled point cloud to a floor plan: outline, gaps, smoothing, trimming, rectangle, openings, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import layout, sequences
from .graphs import checkpointed


def outline(points: DataFrame, key: str, step: float, gap: int, width: int, share: float) -> DataFrame:
    """(key, x, y): smoothed lower and upper envelopes of each room's points (x, y), without the farthest ones.

    A bin's x is a full step right of its middle, as digitized bins are numbered from 1. Only envelopes, one row a bin,
    pass beyond the first aggregation, however many points a room has.
    """
    low = points.groupBy(key).agg(F.min("x").alias("x0"))
    bins = sequences.envelope(points.join(low, key), [key, "x0"], "x", "y", step, F.col("x0"))
    filled = sequences.fill_gaps(bins, [key, "x0"], ["low", "high"], gap)
    for side in ("low", "high"):
        filled = sequences.moving_average(filled, [key], "bin", side, width, f"{side}_s")
    x = F.col("x0") + F.col("bin") * step + step / 2
    sides = F.explode(F.array("low_s", "high_s")).alias("y")
    border = filled.select(key, x.alias("x"), sides)
    room = Window.partitionBy(key)
    far = border.withColumn("mx", F.avg("x").over(room)).withColumn("my", F.avg("y").over(room)).withColumn("r", F.expr("sqrt(pow(x - mx, 2) + pow(y - my, 2))"))
    return sequences.trim_above_quantile(far, [key], "r", share).select(key, "x", "y")


def rectangles(points: DataFrame, key: str, **how) -> DataFrame:
    """(key, corners, w, h, area): the least rectangle around each room's outline."""
    corners = layout.least_rectangles(outline(points, key, **how), key, "x", "y")
    grouped = corners.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("corner_ix", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("corners"), F.max("area").alias("area"))
    side = lambda i, j: F.expr(f"sqrt(pow(corners[{i}].x - corners[{j}].x, 2) + pow(corners[{i}].y - corners[{j}].y, 2))")
    return grouped.select(key, "corners", side(0, 1).alias("w"), side(1, 2).alias("h"), "area")


def floor_plan(walls: DataFrame, openings: DataFrame, key: str, floor: str, rooms: DataFrame, pad: float, **how) -> DataFrame:
    """(floor, key, x, y, w, h, n_openings): rooms packed on their floor's shelves, with openings on their walls.

    walls and openings are points (key, x, y); rooms says which floor (key, floor) each room is on.
    """
    rects = checkpointed(rectangles(walls, key, **how))  # a row a room, used four times
    placed = layout.openings_on_rectangle(openings.select(key, F.col("x").alias("px"), F.col("y").alias("py")), rects, [key])
    counts = placed.groupBy(key).agg(F.countDistinct("edge", F.round("x", 3), F.round("y", 3)).alias("n_openings"))
    sized = rects.join(rooms, key)
    packed = sequences.shelf_pack(sized, [floor], [key], "w", "h", key, pad)
    out = packed.withColumnRenamed("name", key).join(sized.select(key, "w", "h"), key).join(counts, key, "left")
    return out.select(floor, key, "x", "y", "w", "h", F.coalesce("n_openings", F.lit(0)).alias("n_openings"))
