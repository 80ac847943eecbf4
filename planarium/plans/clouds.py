"""Whole chains: from points to rectangles and floor plans. What needs hulls has no SQL form; tests hold it to NumPy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..operators import layout, plan
from . import query
from .sequences import points

_HOW = {"step": 24.0, "gap": 5, "width": 5, "share": 0.95}


@query()
def min_rect(events: DataFrame) -> DataFrame:
    corners = layout.least_rectangles(plan.outline(points(events), "user_id", **_HOW), "user_id", "x", "y")
    return corners.select("user_id", "corner_ix", fixed("x").alias("x"), fixed("y").alias("y"), fixed("area", 2).alias("area"))


@query()
def iou_rotated(events: DataFrame) -> DataFrame:
    """How far the rectangle around a user's even events overlaps that around the odd ones."""
    import numpy as np
    import pandas as pd

    rows = events.select("user_id", (F.col("event_id") % 2).cast("int").alias("side"), (F.unix_seconds(F.col("ts").cast("timestamp")) / 86400.0).alias("x"), (F.col("value") / 20).alias("y"))
    ends = rows.groupBy("user_id", "side", F.floor("x").alias("bin")).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    border = ends.select("user_id", "side", F.col("bin").cast("double").alias("x"), F.explode(F.array("lo", "hi")).alias("y"))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (layout.least_rectangle(pdf.loc[pdf["side"] == k, ["x", "y"]].to_numpy(float))[0] if (pdf["side"] == k).any() else np.zeros((0, 2)) for k in (0, 1))
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "iou": [layout.overlap(a, b) if len(a) and len(b) else 0.0]})

    found = border.groupBy("user_id").applyInPandas(step, "user_id long, iou double")
    return found.select("user_id", fixed("iou").alias("iou"))


@query()
def floor_plan(events: DataFrame) -> DataFrame:
    """Users as rooms of six floors, events as wall points, errors as openings."""
    walls = points(events)
    doors = points(events.where("event_type = 'error'"))
    rooms = walls.select("user_id").distinct().withColumn("floor_id", F.col("user_id") % 6)
    found = plan.floor_plan(walls, doors, "user_id", "floor_id", rooms, 0.5, **_HOW)
    return found.select("floor_id", "user_id", *(fixed(c, 3).alias(c) for c in ("x", "y", "w", "h")), "n_openings")
