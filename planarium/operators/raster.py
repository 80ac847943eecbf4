"""Pixel grids as long tables: views, resampling, neighbours, superpixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(row, col) of every pixel, made in parallel."""
    return spark.range(height * width).select(F.expr(f"cast(id div {width} as int)").alias("row"), F.expr(f"cast(id % {width} as int)").alias("col"))


def cloud(depth: DataFrame, height: int, width: int, crop: int = 80, stride: int = 2, top: float = 1.5) -> DataFrame:
    """depth (row, col, d, ...) as points x, y, z: rows cropped at both ends, every `stride`-th pixel, below the ceiling."""
    kept = depth.where(f"row >= {crop} and row < {height - crop} and (row - {crop}) % {stride} = 0 and col % {stride} = 0")
    ray = G.c1_ray(F.col("row"), F.col("col"), height, width)
    return kept.withColumns({n: r * F.col("d") for n, r in zip("xyz", ray)}).where(F.col("z") < top)


def resized(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resizing of images (row, col, ...): every target pixel takes the source pixel under its index."""
    (h, w), (h2, w2) = source, target
    rows = pixels.sparkSession.range(h2 * w2).select(F.expr(f"cast(id div {w2} as int)").alias("row2"), F.expr(f"cast(id % {w2} as int)").alias("col2"))
    rows = rows.withColumn("row", F.floor(F.col("row2") * h / h2).cast("int")).withColumn("col", F.floor(F.col("col2") * w / w2).cast("int"))
    others = [c for c in pixels.columns if c not in ("row", "col")]
    return pixels.join(rows, ["row", "col"]).select(*others, F.col("row2").alias("row"), F.col("col2").alias("col"))


def bilinear(samples: DataFrame, pixels: DataFrame, keys: list[str], value: str, height: int, width: int, wrap: bool = False) -> DataFrame:
    """samples (keys, id, sx, sy) with the image's value there: four corner lookups by key, weighted; 0 outside the image.

    With wrap the image is a ring: columns go on over the seam, and rows stop at the first and last.
    """
    if wrap:
        samples = samples.withColumn("sx", F.pmod("sx", F.lit(float(width)))).withColumn("sy", F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), F.col("sy"))))
    inside = samples.where((F.col("sx") >= 0) & (F.col("sx") < width) & (F.col("sy") >= 0) & (F.col("sy") < height))
    x0, y0 = F.floor("sx").cast("int"), F.floor("sy").cast("int")
    fx, fy = F.col("sx") - x0, F.col("sy") - y0
    beside = lambda dx: F.pmod(x0 + dx, F.lit(width)) if wrap else F.least(x0 + dx, F.lit(width - 1))
    corner = lambda dx, dy, w: F.struct(beside(dx).alias("col"), F.least(y0 + dy, F.lit(height - 1)).alias("row"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy))
    wanted = inside.select(*keys, "id", F.explode(corners).alias("c")).select(*keys, "id", "c.row", "c.col", "c.w")
    found = wanted.join(pixels.select(*keys, "row", "col", F.col(value).cast("double").alias("_v")), [*keys, "row", "col"]).groupBy(*keys, "id").agg(F.sum(F.col("w") * F.col("_v")).alias(value))
    return samples.select(*keys, "id").join(found, [*keys, "id"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def _asked(images: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """(keys, id, row, col) of every pixel of an image so large for each image's keys."""
    place = F.explode(F.sequence(F.lit(0), F.lit(height * width - 1))).alias("id")
    return images.select(*keys).distinct().select(*keys, place).withColumns({"row": F.expr(f"id div {width}"), "col": F.expr(f"id % {width}")})


def _taken(asked: DataFrame, at: tuple[Column, Column], pixels: DataFrame, keys: list[str], value: str, height: int, width: int, wrap: bool) -> DataFrame:
    """(keys, row, col, value): each asked pixel with the image's value at (sx, sy)."""
    samples = asked.withColumn("sx", at[0]).withColumn("sy", at[1])
    found = bilinear(samples.select(*keys, "id", "sx", "sy"), pixels, keys, value, height, width, wrap)
    return asked.join(found, [*keys, "id"]).select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), value)


def perspective_view(panoramas: DataFrame, keys: list[str], value: str, height: int, width: int, size: tuple[int, int], fov: float, yaw: Column, pitch: Column) -> DataFrame:
    """(keys, row, col, value): a view of size (height, width) in each panorama (keys, row, col, value), turned by yaw and pitch.

    yaw and pitch are in degrees, and may use the keys: crops of a tangent plane are views of their own keys.
    """
    asked = _asked(panoramas, keys, *size)
    ray = G.perspective_ray(F.col("col"), F.col("row"), size[1], size[0], fov, yaw, pitch)
    return _taken(asked, G.c2_pixel(*ray, height, width), panoramas, keys, value, height, width, True)


def rotated_panorama(panoramas: DataFrame, keys: list[str], value: str, height: int, width: int, turn: list[float]) -> DataFrame:
    """(keys, row, col, value): each panorama as seen after a turn, nine numbers by rows that take new directions to old ones."""
    ray = G.c2_ray(F.col("col") + 0.5, F.col("row") + 0.5, height, width)
    old = tuple(turn[3 * k] * ray[0] + turn[3 * k + 1] * ray[1] + turn[3 * k + 2] * ray[2] for k in range(3))
    u, v = G.c2_pixel(*old, height, width)
    return _taken(_asked(panoramas, keys, height, width), (u - 0.5, v - 0.5), panoramas, keys, value, height, width, True)


def stretched_panorama(panoramas: DataFrame, keys: list[str], value: str, height: int, width: int, kx: float, ky: float) -> DataFrame:
    """(keys, row, col, value): each panorama of its room stretched by kx and ky along the floor's axes."""
    ray = G.c2_ray(F.col("col") + 0.5, F.col("row") + 0.5, height, width)
    u, v = G.c2_pixel(ray[0] / kx, ray[1], ray[2] / ky, height, width)
    return _taken(_asked(panoramas, keys, height, width), (u - 0.5, v - 0.5), panoramas, keys, value, height, width, True)


def warped(images: DataFrame, keys: list[str], value: str, height: int, width: int, back: list[float]) -> DataFrame:
    """(keys, row, col, value): each image through a homography, given by the nine numbers of its inverse; 0 from outside."""
    asked = _asked(images, keys, height, width)
    return _taken(asked, G.homogeneous(back, F.col("col").cast("double"), F.col("row").cast("double")), images, keys, value, height, width, False)


def class_bounds(cells: DataFrame, keys: list[str], ceiling: int = 3, floor: int = 1) -> DataFrame:
    """(keys, ceiling, floor): the lowest row of ceiling and the highest of floor in each column; null without any."""
    return cells.groupBy(*keys).agg(F.max(F.when(F.col("label") == ceiling, F.col("row"))).alias("ceiling"), F.min(F.when(F.col("label") == floor, F.col("row"))).alias("floor"))


def borders(labels: DataFrame, row: str, col: str, label: str) -> DataFrame:
    """labels with `border`: whether the 3 x 3 pixels around hold more than one label."""
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = labels.select(row, col, label).withColumn("o", F.explode(offsets)).select((F.col(row) + F.col("o.i")).alias(row), (F.col(col) + F.col("o.j")).alias(col), label)
    around = spread.groupBy(row, col).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    return labels.join(around, [row, col]).withColumn("border", F.col("_lo") != F.col("_hi")).drop("_lo", "_hi")


def label_by_threshold(scores: list[Column], least: float = 0.5) -> Column:
    """1 + the place of the greatest score if it is above the threshold, else 0; the first of equals."""
    every = F.array(*scores)
    return F.when(F.array_max(every) > least, F.array_position(every, F.array_max(every))).otherwise(0).cast("int")


def enforced(label: Column, row: Column, ceiling: Column, floor: Column) -> Column:
    """Unknown cells by height: above the ceiling's end a ceiling, below the floor's start a floor, between them wall.

    Labels are 0 unknown, 1 floor, 2 wall, 3 ceiling.
    """
    return F.when(label != 0, label).when((row > ceiling) & (row < floor), 2).when(row <= ceiling, 3).when(row >= floor, 1).otherwise(0)


def slic(pixels: DataFrame, keys: list[str], width: int, step: int, rounds: int, weight: float) -> DataFrame:
    """(keys, row, col, sp, dist) of superpixels of each image: seeds on a grid, then rounds of assignment and of mean centres.

    pixels has the image's keys, row, col and the colours l, a, b. A pixel meets only centres within `step` of it in rows and columns, by
    an equality join on cells of that size. As the distance kept is the best ever, a pixel moves only if strictly
    closer than it ever was; ties go to the smaller id.
    """
    from .graphs import checkpointed

    here = [*keys, "row", "col"]
    seeds = pixels.where(f"(row - {step // 2}) % {step} = 0 and (col - {step // 2}) % {step} = 0 and row >= {step // 2} and col >= {step // 2}")
    centres = seeds.select(*keys, (F.expr(f"(row div {step}) * {(width + step - 1) // step + 1} + col div {step}") + 1).alias("sp"), *(F.col(c).cast("double").alias(f"c_{c}") for c in ("l", "a", "b", "row", "col")))
    state = pixels.select(*here, "l", "a", "b", F.lit(0).cast("long").alias("sp"), F.lit(float("inf")).alias("dist"))
    cell = lambda r, c: (F.floor(r / step).cast("int"), F.floor(c / step).cast("int"))
    for _ in range(rounds):
        around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        ci, cj = cell(F.col("c_row"), F.col("c_col"))
        near = centres.withColumn("o", F.explode(around)).withColumn("ci", ci + F.col("o.i")).withColumn("cj", cj + F.col("o.j")).drop("o").withColumnRenamed("sp", "new")
        pi, pj = cell(F.col("row"), F.col("col"))
        met = state.withColumn("ci", pi).withColumn("cj", pj).join(near, [*keys, "ci", "cj"]).where(f"abs(row - c_row) <= {step} and abs(col - c_col) <= {step}")
        d = F.sqrt(F.expr("pow(l - c_l, 2) + pow(a - c_a, 2) + pow(b - c_b, 2)") + F.expr("pow(row - c_row, 2) + pow(col - c_col, 2)") * (weight / step) ** 2)
        best = met.withColumn("d", F.floor(d * 1e6 + 0.5) / 1e6).groupBy(*here).agg(F.min(F.struct("d", "new")).alias("m"))
        state = state.join(best, here, "left").withColumn("_go", F.col("m.d") < F.col("dist"))
        state = state.withColumn("sp", F.when(F.col("_go"), F.col("m.new")).otherwise(F.col("sp"))).withColumn("dist", F.when(F.col("_go"), F.col("m.d")).otherwise(F.col("dist"))).drop("m", "_go")
        state = checkpointed(state)
        centres = state.where("sp > 0").groupBy(*keys, "sp").agg(*(F.avg(c).alias(f"c_{c}") for c in ("l", "a", "b", "row", "col")))
    return state.select(*here, "sp", "dist")


def cosine_series(weights: DataFrame, keys: list[str], k: str, w: str, size: int) -> DataFrame:
    """(keys, i, value): sum over k of w cos(k (i + 1/2) pi / size) for i below the size. The series is made in each row,
    so that nothing but its terms' sums is shuffled."""
    rows = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i")
    terms = weights.select(*keys, k, w, rows)
    return terms.groupBy(*keys, "i").agg(F.sum(F.col(w) * F.cos(F.col(k) * (F.col("i") + 0.5) / size * G.PI)).alias("value"))
