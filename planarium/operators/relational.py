"""Catalogue operators: grouping with conditions, division, defaults, nested indexes, totals, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_with_many(df: DataFrame, keys: list[str], more_than: int = 1) -> DataFrame:
    """(keys, n) of groups of more than so many rows: one map-side-combined aggregation."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def all_members_have_many(df: DataFrame, outer: list[str], inner: list[str], more_than: int = 1) -> DataFrame:
    """Relational division: (outer, members, complete), complete where every inner group has more than so many rows."""
    sizes = df.groupBy(*outer, *inner).agg(F.count("*").alias("n"))
    return sizes.groupBy(*outer).agg(F.count("*").alias("members"), F.bool_and(F.col("n") > more_than).alias("complete"))


def totals(df: DataFrame, *keys: str) -> DataFrame:
    """Counts at every level of a hierarchy of keys, with how many keys are rolled up."""
    levels = sum((F.grouping(k).cast("long") for k in keys), F.lit(0).cast("long"))
    return df.rollup(*keys).agg(F.count("*").alias("n"), levels.alias("level"))


def with_default(left: DataFrame, right: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join where columns of the right fall back to defaults."""
    joined = left.join(right, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def split_by_presence(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a partner, rows to warn of)."""
    return left.join(right, on, "left_semi"), left.join(right, on, "left_anti")


def must_be_empty(df: DataFrame, message: str) -> DataFrame:
    """df, any row of which raises an error when it is read. (A filter that raised could be pushed below a join.)"""
    first, kind = df.columns[0], df.schema[0].dataType
    return df.withColumn(first, F.coalesce(F.raise_error(F.lit(message)).cast(kind), F.col(first)))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps at most k rows a task and group before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def joined_names(df: DataFrame, keys: list[str], name: str, sep: str = ";") -> DataFrame:
    """(keys, names): the sorted names of each group in one string."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(name)), sep).alias("names"))


def number_distinct(df: DataFrame, value: Column, name: str = "group_id") -> DataFrame:
    """(value, name): each distinct value's rank, from 1.

    Values are sorted over ranges in parallel; a range's rows are numbered where they lie, and the counts of the ranges
    before it, one row a range, are added. No task holds all values.
    """
    from .graphs import checkpointed

    values = df.select(value.alias("value")).distinct()
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = values.repartitionByRange(spread, "value").sortWithinPartitions("value").withColumn("_id", F.monotonically_increasing_id())
    placed = checkpointed(ordered).withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_range").select("value", (F.col("_before") + F.col("_at") + 1).cast("int").alias(name))


def scene_index(panos: DataFrame) -> DataFrame:
    """One JSON document: scenes with their floors, rooms and sorted files, and the totals."""

    def nested(key: str, value: str) -> Column:
        """A map from sorted keys; the values, being maps themselves, have no order of their own."""
        by_key = lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)), by_key))

    rooms = panos.groupBy("scene_id", "floor_id", "room_id").agg(F.array_sort(F.collect_list("file")).alias("files"))
    floors = rooms.groupBy("scene_id", "floor_id").agg(nested("room_id", "files").alias("rooms"))
    scenes = floors.groupBy("scene_id").agg(F.count("*").alias("n"), nested("floor_id", "rooms").alias("floors"))
    whole = scenes.agg(
        F.count("*").alias("total_scenes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_included_floors"),
        nested("scene_id", "floors").alias("scenes"),
    )
    return whole.select(F.to_json(F.struct("total_scenes", "total_included_floors", "scenes")).alias("json"))
