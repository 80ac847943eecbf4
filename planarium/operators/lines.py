"""Great-circle arcs: votes for directions, assignment to vanishing directions, refits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def votes(arcs: DataFrame, directions: list[tuple[float, float, float]], within: float) -> DataFrame:
    """(dir, n, votes): arcs (nx, ny, nz, weight) whose circle passes within so many degrees of the pole's equator.

    The candidate directions are constants in the row; one aggregation with map-side combine sums their votes.
    """
    size = F.sqrt(F.expr("nx * nx + ny * ny + nz * nz"))
    bound = math.cos(math.radians(within))
    rows = []
    for k, (x, y, z) in enumerate(directions):
        d = F.abs(F.col("nx") * x + F.col("ny") * y + F.col("nz") * z) / size / math.sqrt(x * x + y * y + z * z)
        rows.append(F.struct(F.lit(k).alias("dir"), (d < bound).alias("hit")))
    exploded = arcs.select("weight", F.explode(F.array(*rows)).alias("r")).where("r.hit")
    return exploded.groupBy("r.dir").agg(F.count("*").alias("n"), F.sum("weight").alias("votes"))


def icosahedron(levels: int = 0) -> list[tuple[float, float, float]]:
    """Unit vectors of an icosahedron whose faces are halved so many times, each once."""
    g = (1 + math.sqrt(5)) / 2
    corners = [p for a in (-1, 1) for b in (-g, g) for p in ((0, a, b), (a, b, 0), (b, 0, a))]
    unit = lambda p: tuple(c / math.sqrt(sum(x * x for x in p)) for c in p)
    near = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q)) < 4.1
    faces = [(p, q, r) for i, p in enumerate(corners) for j, q in enumerate(corners[:i]) for r in corners[:j] if near(p, q) and near(q, r) and near(p, r)]
    faces = [tuple(map(unit, f)) for f in faces]
    for _ in range(levels):
        split = []
        for a, b, c in faces:
            ab, bc, ca = (unit(tuple((x + y) / 2 for x, y in zip(p, q))) for p, q in ((a, b), (b, c), (c, a)))
            split += [(a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)]
        faces = split
    return sorted({tuple(round(x, 12) for x in p) for f in faces for p in f})


def assign(arcs: DataFrame, directions: list[tuple[float, float, float]], tolerance: float) -> DataFrame:
    """arcs with `vp`, the direction (from 1) that an arc's circle passes nearest to, or one past the last if none is near."""
    size = F.sqrt(F.expr("nx * nx + ny * ny + nz * nz"))
    costs = F.array(*(F.struct(F.asin(F.abs(F.col("nx") * x + F.col("ny") * y + F.col("nz") * z) / size).alias("cost"), F.lit(k + 1).alias("vp")) for k, (x, y, z) in enumerate(directions)))
    best = arcs.withColumn("_b", F.array_min(costs))
    vp = F.when(F.col("_b.cost") <= math.radians(tolerance), F.col("_b.vp")).otherwise(len(directions) + 1)
    return best.withColumn("vp", vp).drop("_b")


def scatter(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xx, xy, xz, yy, yz, zz): weighted sums of products of points (x, y, z, weight)."""
    w = F.col("weight")
    axes = ("x", "y", "z")
    return points.groupBy(*keys).agg(*(F.sum(w * w * F.col(a) * F.col(b)).alias(a + b) for i, a in enumerate(axes) for b in axes[i:]))


def long_enough(arcs: DataFrame, degrees: float = 5.0) -> DataFrame:
    """The arcs whose length (radians) is at least so many degrees."""
    return arcs.where(F.degrees("length") >= degrees)
