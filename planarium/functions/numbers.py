"""Rounding that two engines agree on, and small arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column | str, digits: int = 4) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits: half up, with the same steps in every engine."""
    scale = float(10**digits)
    return F.floor((F.col(x) if isinstance(x, str) else x).cast("double") * scale + 0.5).cast("double") / scale


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b as a double, or `empty` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a.cast("double") / b)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
