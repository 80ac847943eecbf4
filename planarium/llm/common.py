"""What the operators share: where intermediate tables go, and how Python workers find this package."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable as prepare
from ..session import shared_root

__all__ = ["arrow", "discard", "eased", "give_back", "grouped", "prepare", "read", "released", "shared_path", "shared_root", "sized", "written"]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/planarium/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here and no executor's loss can undo it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables from written() that everything lazy has done with."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """df, to be broadcast if it has at most so many rows, which should be a few longs; beyond, joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def give_back() -> None:
    """Hand what this worker has freed back to the system: idle workers live on, beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has this call
        ctypes.CDLL(None).malloc_trim(0)


def released(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """step, after which the worker gives back its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def eased(step: Callable[..., pa.Table], *tables: pa.Table) -> pa.Table:
    """step(*tables), the rows of one group, after which the worker gives back its memory."""
    try:
        return step(*tables)
    finally:
        give_back()


def arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(released(step), schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: int, whole: bool = True) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, which are the first columns and hold no nulls; runs may span batches.

    With whole unset a run comes batch by batch, and is never held as a whole.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for a, b in pairwise([0, *cuts.tolist(), len(batch)]):
            own = tuple(c[a] for c in columns)
            if held and (own != last or not whole):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
