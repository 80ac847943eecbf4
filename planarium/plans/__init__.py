"""Named queries over the driver's tables, each with an equivalent DuckDB statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import importable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Callable], Callable]:
    """Register fn(table, ...) under its name; its parameters name the tables that it reads, the session or their folder."""

    def register(fn: Callable) -> Callable:
        names = fn.__code__.co_varnames[: fn.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            given = {"spark": spark, "folder": sf_dir}
            return fn(*(given[n] if n in given else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names))

        QUERIES[fn.__name__] = run
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import catalogue, clouds, files, fitting, matching, rasters, rooms, scalars, sequences, signals, views  # noqa: F401  each registers its queries

    return QUERIES, ORACLES
