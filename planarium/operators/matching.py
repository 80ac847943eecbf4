"""Joins by nearness: descriptors, bands, corners and grid neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def blocked(left: DataFrame, right: DataFrame, block: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rows: int = 2048) -> DataFrame:
    """block(part of left, part of right) for every pair of parts of at most about `rows` rows: a search by brute force.

    Parts are dealt by a hash of the first column. Neither side is broadcast, and no task holds more than a part of each.
    """
    n, m = (max(1, math.ceil(df.count() / rows)) for df in (left, right))
    own = lambda df, k: F.pmod(F.xxhash64(df.columns[0]), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = left.withColumn("_i", own(left, n)).withColumn("_j", every(m))
    b = right.withColumn("_j", own(right, m)).withColumn("_i", every(n))
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInArrow(block, schema)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _nearest_two(left: pa.Table, right: pa.Table) -> pa.Table:
    """(q_id, t_id, d) of the two right rows nearest to each left row by squared distance, ties to smaller ids."""
    ids, other, near = [], [], []
    if left.num_rows and right.num_rows:
        right = right.sort_by("t_id")
        q, t, names = _matrix(left, "q"), _matrix(right, "t"), right.column("t_id").to_numpy()
        for k, one in zip(left.column("q_id").to_pylist(), q):
            d = ((t - one) ** 2).sum(1)
            best = np.argsort(d, kind="stable")[:2]
            ids += [k] * len(best)
            other += names[best].tolist()
            near += d[best].tolist()
    return pa.table([pa.array(ids, pa.int64()), pa.array(other, pa.int64()), pa.array(near, pa.float64())], ["q_id", "t_id", "d"])


def ratio_matches(queries: DataFrame, targets: DataFrame, ratio: float = 0.75) -> DataFrame:
    """(q_id, t_id, d1, d2): nearest targets by Euclidean distance that beat the second nearest by the ratio; ties to smaller ids.

    Each block keeps two candidates a query; only those are shuffled for the final rank.
    """
    found = blocked(queries.select("q_id", "q"), targets.select("t_id", "t"), _nearest_two, "q_id long, t_id long, d double")
    ranked = found.groupBy("q_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "t_id"))), 1, 2).alias("m")).where(F.size("m") == 2)
    d1, d2 = F.sqrt(F.col("m")[0]["d"]), F.sqrt(F.col("m")[1]["d"])
    return ranked.where(d1 < ratio * d2).select("q_id", F.col("m")[0]["t_id"].alias("t_id"), d1.alias("d1"), d2.alias("d2"))


def _best_products(left: pa.Table, right: pa.Table) -> pa.Table:
    """(q_id, t_id, score) of each row's best partner in the block, both ways, ties to smaller ids."""
    rows: set = set()
    if left.num_rows and right.num_rows:
        left, right = left.sort_by("q_id"), right.sort_by("t_id")
        a, b = left.column("q_id").to_numpy(), right.column("t_id").to_numpy()
        score = _matrix(left, "q") @ _matrix(right, "t").T
        to, fro = score.argmax(1), score.argmax(0)
        rows = {(int(a[i]), int(b[j]), float(score[i, j])) for i, j in [*enumerate(to), *((i, j) for j, i in enumerate(fro))]}
    out = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["q_id", "t_id", "score"])


def mutual_matches(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(q_id, t_id, score): pairs that are each other's best by inner product."""
    found = blocked(queries.select("q_id", "q"), targets.select("t_id", "t"), _best_products, "q_id long, t_id long, score double")
    return mutual(found, "q_id", "t_id", "score")


def mutual(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """(a, b, score): pairs that are each other's best, ties to smaller ids."""
    to = pairs.groupBy(a).agg(F.max(F.struct(F.col(score), (-F.col(b)).alias("o"))).alias("m")).select(a, (-F.col("m.o")).alias(b), F.col(f"m.{score}").alias(score))
    fro = pairs.groupBy(b).agg(F.max(F.struct(F.col(score), (-F.col(a)).alias("o"))).alias("m")).select(b, (-F.col("m.o")).alias(a))
    return to.join(fro, [a, b])


def band_join(left: DataFrame, right: DataFrame, keys: list[str], l_value: str, r_value: str, width: float) -> DataFrame:
    """Rows of equal keys whose values are at most `width` apart.

    Values are put in cells of the band's width; a row meets the rows of its own and the two next cells, and nothing
    else, so that the join is an equality join. Columns of the two sides must differ but for the keys.
    """
    a = left.withColumn("_cell", F.floor(F.col(l_value) / width))
    b = right.withColumn("_cell", F.explode(F.array(*(F.floor(F.col(r_value) / width) + k for k in (-1, 0, 1)))))
    return a.join(b, [*keys, "_cell"]).where(F.abs(F.col(l_value) - F.col(r_value)) <= width).drop("_cell")


def linked_within(points: DataFrame, tag: str, value: str, width: float) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs whose values are at most `width` apart, no more than rows.

    Values in one cell of the width are all that near: each links to the cell's least tag. Two neighbouring cells link
    if the greatest value of one and the least of the next do, which are the nearest that they have.
    """
    placed = points.select(tag, value, F.floor(F.col(value) / width).alias("_cell"))
    cells = placed.groupBy("_cell").agg(F.min(tag).alias("b"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    own = placed.join(cells, "_cell").where(F.col(tag) != F.col("b")).select(F.col(tag).alias("a"), "b")
    after = cells.select((F.col("_cell") - 1).alias("_cell"), F.col("b").alias("a"), F.col("_low").alias("_next"))
    return own.union(cells.join(after, "_cell").where(F.col("_next") - F.col("_high") <= width).select("a", "b"))


def stochastic_pairs(grid: DataFrame, keys: list[str], row: str, col: str, chosen: Column, horizon: int, n: int, seed: int = 0) -> DataFrame:
    """(keys, row, col, row2): up to n of each key's chosen cells above the horizon, by a hash, with their mirror rows below."""
    place = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(row).cast("string"), F.col(col).cast("string")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", row, col))
    above = grid.where(chosen & (F.col(row) < horizon)).select(*keys, row, col, place.alias("_h")).withColumn("_k", rank).where(F.col("_k") <= n)
    below = grid.where(F.col(row) > horizon).select(*keys, (2 * horizon - F.col(row)).alias(row), col)
    return above.join(below, [*keys, row, col], "left_semi").select(*keys, row, col, (2 * horizon - F.col(row)).alias(f"{row}2"))


def grid_neighbours(grid: DataFrame, keys: list[str], row: str, col: str, values: list[str]) -> DataFrame:
    """Each cell with its eight neighbours' values (named *_near): offsets exploded, then an equality join."""
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    near = grid.select(*keys, F.col(row).alias("r0"), F.col(col).alias("c0"), *(F.col(v).alias(f"{v}_near") for v in values)).withColumn("o", F.explode(offsets))
    near = near.select(*keys, (F.col("r0") + F.col("o.i")).alias(row), (F.col("c0") + F.col("o.j")).alias(col), *(f"{v}_near" for v in values))
    return grid.join(near, [*keys, row, col])


def reflected(grid: DataFrame, keys: list[str], row: str, col: str, value: str, horizon: int) -> DataFrame:
    """Cells above the horizon with the value of their mirror image below it (named *_mirror)."""
    below = grid.where(F.col(row) > horizon).select(*keys, (2 * horizon - F.col(row)).alias(row), col, F.col(value).alias(f"{value}_mirror"))
    return grid.where(F.col(row) < horizon).join(below, [*keys, row, col])


def nearest_first(pairs: DataFrame, keys: list[str], distance: str, order: str, columns: list[str]) -> DataFrame:
    """Of each key's pairs the nearest, the first in order of equals."""
    best = F.min_by(F.struct(*columns, distance), F.struct(distance, order))
    return pairs.groupBy(*keys).agg(best.alias("b")).select(*keys, *(f"b.{c}" for c in columns), f"b.{distance}")
