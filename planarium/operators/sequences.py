"""Operators on ordered sequences, all by windows over a key, so that sequences run side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def envelope(points: DataFrame, keys: list[str], x: str, y: str, step: float, low: Column) -> DataFrame:
    """(keys, bin, low, high): least and greatest y of each bin, numbered from 1 as by digitizing."""
    bin_ = (F.floor((F.col(x) - low) / step) + 1).cast("long")
    return points.groupBy(*keys, bin_.alias("bin")).agg(F.min(y).alias("low"), F.max(y).alias("high"))


def fill_gaps(bins: DataFrame, keys: list[str], values: list[str], most: int) -> DataFrame:
    """bins with the missing ones of gaps up to `most` long between two bins, on the line between their values.

    Only the bins next to a gap are looked at: the rows of a gap come from a sequence, not from a grid of all bins.
    """
    w = Window.partitionBy(*keys).orderBy("bin")
    ahead = bins.withColumn("to", F.lead("bin").over(w)).withColumns({f"{v}_to": F.lead(v).over(w) for v in values})
    gap = F.col("to") - F.col("bin") - 1
    filled = ahead.where((gap >= 1) & (gap <= most)).withColumn("at", F.explode(F.sequence(F.col("bin") + 1, F.col("to") - 1)))
    t = (F.col("at") - F.col("bin")).cast("double") / (F.col("to") - F.col("bin"))
    lines = [(F.col(v) + (F.col(f"{v}_to") - F.col(v)) * t).alias(v) for v in values]
    return bins.select(*keys, "bin", *values).unionByName(filled.select(*keys, F.col("at").alias("bin"), *lines))


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, width: int, name: str = "smooth") -> DataFrame:
    """Centred mean over an odd width, with the first and last values repeated past the ends."""
    half = width // 2
    w = Window.partitionBy(*keys).orderBy(order)
    around, whole = w.rowsBetween(-half, half), Window.partitionBy(*keys)
    at, n = F.row_number().over(w), F.count("*").over(whole)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left, right = F.greatest(F.lit(0), half + 1 - at), F.greatest(F.lit(0), at + half - n)
    total = F.sum(value).over(around) + left * F.first(value).over(every) + right * F.last(value).over(every)
    return df.withColumn(name, total / width)


def circular_peaks(df: DataFrame, keys: list[str], pos: str, value: str, size: int, radius: int, least: float = 0.0) -> DataFrame:
    """Rows that are the greatest within `radius` places on a ring of `size` places, and above `least`.

    The seam is closed by copies of the places near it, shifted by the size.
    """
    near = [df.withColumn("ring", F.col(pos))]
    near.append(df.where(F.col(pos) < radius).withColumn("ring", F.col(pos) + size))
    near.append(df.where(F.col(pos) >= size - radius).withColumn("ring", F.col(pos) - size))
    ring = near[0].unionByName(near[1]).unionByName(near[2])
    w = Window.partitionBy(*keys).orderBy("ring").rangeBetween(-radius, radius)
    top = ring.withColumn("top", F.max(value).over(w))
    return top.where(F.col("ring").between(0, size - 1) & (F.col(value) == F.col("top")) & (F.col(value) > least)).drop("ring", "top")


def top_peaks(peaks: DataFrame, keys: list[str], pos: str, value: str, n: int) -> DataFrame:
    """The n highest peaks of each sequence, in order of place."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), pos))
    kept = peaks.withColumn("by_height", rank).where(F.col("by_height") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).drop("by_height")


def segments(df: DataFrame, keys: list[str], order: list[str], flag: Column, name: str = "segment") -> DataFrame:
    """Segment numbers that rise at flags; the last segment of a ring is its first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    found = df.withColumn(name, F.sum(F.when(flag, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(name).over(Window.partitionBy(*keys))
    return found.withColumn(name, F.when(F.col(name) == last, 0).otherwise(F.col(name)))


def islands(df: DataFrame, keys: list[str], order: str, tolerance: float, tie: str) -> DataFrame:
    """df with the number of each row's island: a new one starts where the step is larger than the tolerance."""
    w = Window.partitionBy(*keys).orderBy(order, tie)
    step = F.col(order) - F.lag(order).over(w)
    return df.withColumn("island", F.sum(F.when(step > tolerance, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def best_split(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, split, score): where the two sides' means differ most, each weighed by the smaller side; first wins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    n, at = F.count("*").over(whole), F.row_number().over(w)
    before = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.select(*keys, at.alias("at"), n.alias("n"), before.alias("before"), F.sum(value).over(whole).alias("total")).where("at < n")
    score = F.abs(F.col("before") / F.col("at") - (F.col("total") - F.col("before")) / (F.col("n") - F.col("at")))
    rows = rows.withColumn("score", F.floor(score * F.least("at", F.col("n") - F.col("at")) * 10000 + 0.5) / 10000)
    return rows.groupBy(*keys).agg(F.max_by("at", F.struct("score", -F.col("at"))).alias("split"), F.max("score").alias("score"))


def consensus(df: DataFrame, keys: list[str], value: str, tolerance: float, share: float = 0.4) -> DataFrame:
    """(keys, median, votes, n, agreed): the most values within the tolerance of each other, and whether they are enough.

    A range frame counts, for each value, those from it up to the tolerance above it: no self-join.
    """
    frame = f"partition by {', '.join(keys)} order by {value} range between current row and {float(tolerance)}D following"
    counted = df.withColumn("votes", F.expr(f"count(*) over ({frame})"))
    grouped = counted.groupBy(*keys).agg(F.median(value).alias("median"), F.max("votes").alias("votes"), F.count("*").alias("n"))
    return grouped.withColumn("agreed", F.col("votes") >= share * F.col("n"))


def cyclic_pairs(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each row with the next one's columns (named *_next), the last with the first's."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({f"{c}_next": F.coalesce(F.lead(c).over(w), F.first(c).over(first)) for c in columns})


def shelf_pack(rooms: DataFrame, keys: list[str], order: list[str], width: str, height: str, name: str, pad: float = 0.0) -> DataFrame:
    """(keys, name, x, y): rooms on shelves as wide as the root of their total area, in order.

    Where a shelf ends depends on where the last one did, so each key's rooms are folded over in order, inside the JVM.
    """
    item = F.struct(*order, F.col(width).cast("double").alias("w"), F.col(height).cast("double").alias("h"), F.col(name).alias("name"))
    grouped = rooms.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("rooms"), F.sqrt(F.sum(F.col(width).cast("double") * F.col(height))).alias("target"))
    start = "named_struct('x', 0D, 'y', 0D, 'row', 0D, 'out', array())"
    kind = dict(rooms.dtypes)[name]
    start = f"named_struct('x', 0D, 'y', 0D, 'row', 0D, 'out', cast(array() as array<struct<name:{kind},x:double,y:double>>))"
    fold = f"""aggregate(rooms, {start}, (s, r) -> if(s.x > 0 and s.x + r.w > target,
        named_struct('x', r.w + {pad}D, 'y', s.y + s.row + {pad}D, 'row', r.h, 'out', concat(s.out, array(named_struct('name', r.name, 'x', 0D, 'y', s.y + s.row + {pad}D)))),
        named_struct('x', s.x + r.w + {pad}D, 'y', s.y, 'row', greatest(s.row, r.h), 'out', concat(s.out, array(named_struct('name', r.name, 'x', s.x, 'y', s.y))))), s -> s.out)"""
    return grouped.select(*keys, F.explode(F.expr(fold)).alias("r")).select(*keys, "r.name", "r.x", "r.y")


def interquartile_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, n): the mean of the values from the lower to the upper quartile."""
    ends = df.groupBy(*keys).agg(F.percentile(value, [0.25, 0.75]).alias("q"))
    inside = df.join(ends, keys).where(F.col(value).between(F.col("q")[0], F.col("q")[1]))
    return inside.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def trim_above_quantile(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The rows at or below their key's quantile, with the quantile as `bound`."""
    ends = df.groupBy(*keys).agg(F.percentile(value, share).alias("bound"))
    return df.join(ends, keys).where(F.col(value) <= F.col("bound"))
