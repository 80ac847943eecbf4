"""SimHash near-duplicates, found by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within `radius` bits of each other agree in one segment up to
radius // segments bits, so each fingerprint is filed under its own segment values and asks under every value of the
Hamming ball around them; what meets is verified over all 64 bits. Only distinct fingerprints are filed, and each
task reduces its verified links to a forest, so a dense group of copies costs rows in proportion to its size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, prepare, shared_root, written
from ..operators.graphs import connected_components as components

SEED = 42
#: Fingerprints filed under one segment value that a task takes; a fuller one is split over a grid of tasks.
BUCKET = 2048
#: Rows that a task holds, and pairs that it compares at once.
TASK_ROWS, PAIRS = 1_000_000, 200_000
#: Rows of hot segment values that may be broadcast (16 bytes each); beyond, they are joined by a shuffle.
HOT_ROWS = 100_000


def simhash(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint, unsigned. Null and empty texts and texts of white space have fingerprint 0."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(found) < words:
        values = np.array([hashed(b" ".join(found), SEED)], np.uint64)
    else:
        joined = b" ".join(found)
        ends = list(itertools.accumulate([len(w) + 1 for w in found]))
        starts = [0, *ends]
        values = np.array([hashed(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        bits = np.unpackbits(values[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of docs; fp is the fingerprint as a signed long."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            values = np.array([simhash(texts[i].as_py(), words) for i in range(len(texts))], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), step, "doc_id long, fp long")


def _segments(parts: int) -> list[tuple[int, int]]:
    cuts = [64 * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def _file(classes: DataFrame, node: str, fp: str, parts: int, ball: int) -> DataFrame:
    """(key, node, fp, filed): a row under each segment value, and one for each larger value in the ball around it.

    Of two values that differ, only the smaller asks for the larger: each pair meets once.
    """
    names = list(dict.fromkeys([node, fp]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _segments(parts)
        masks = [np.array([sum(1 << b for b in flip) for n in range(ball + 1) for flip in itertools.combinations(range(width), n)], np.uint64) for _, width in segments]
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                columns = {name: part.column(name).to_numpy(zero_copy_only=False) for name in names}
                for k, (low, width) in enumerate(segments):
                    value = (columns[fp].view(np.uint64) >> np.uint64(low)) & np.uint64((1 << width) - 1)
                    asked = value[:, None] ^ masks[k][None, :]
                    rows, cols = np.nonzero(asked >= value[:, None])
                    mixed = (asked[rows, cols] * np.uint64(parts) + np.uint64(k)).view(np.int64)
                    yield pa.record_batch([pa.array(mixed), *(pa.array(columns[name][rows]) for name in names), pa.array(cols == 0)], ["key", *names, "filed"])

    return arrow(classes.select(*names), step, "key long, " + ", ".join(f"{name} long" for name in names) + ", filed boolean")


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of n nodes, over the links given."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        if not len(left):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root[root], root):
            root = root[root]
    return root


def _meet(node: str, fp: str, radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    key, salt, name, filed = (table.column(c).to_numpy() for c in ("key", "salt", node, "filed"))
    order = np.lexsort((name, ~filed, salt, key))
    key, salt, filed = key[order], salt[order], filed[order]
    bits = table.column(fp).to_numpy()[order].view(np.uint64)
    names, number = np.unique(name[order], return_inverse=True)
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
    size = np.diff(np.r_[start, len(key)])
    tabled = np.add.reduceat(filed.astype(np.int64), start)
    first, last = np.repeat(start, size), np.repeat(start + tabled, size)
    first = np.where(filed, np.arange(len(key)) + 1, first)  # a filed row meets those filed after it
    many = np.maximum(last - first, 0)
    rows = np.flatnonzero(many)
    root, upto, at = np.arange(len(names)), np.cumsum(many[rows]), 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        own = rows[at:to]
        left = np.repeat(own, many[own])
        right = np.arange(len(left)) - np.repeat(np.cumsum(many[own]) - many[own], many[own]) + np.repeat(first[own], many[own])
        near = np.bitwise_count(bits[left] ^ bits[right]) <= radius
        root = forest(root[number[left[near]]], root[number[right[near]]], len(names))[root]
        at = to
    moved = np.flatnonzero(root != np.arange(len(root)))
    yield pa.record_batch([pa.array(names[moved]), pa.array(names[root[moved]])], ["a", "b"])


def links(classes: DataFrame, radius: int = 3, parts: int = 2, node: str = "fp", fp: str = "fp") -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of rows `radius` or fewer bits apart.

    classes has a long `node`, which names a row, and a long `fp`, its fingerprint. Rows of one node count as one. The
    balls of radius // parts bits around segments find every pair. No rows give no edges.
    """
    spark = prepare(classes.sparkSession)
    rows = _file(classes, node, fp, parts, radius // parts)
    counted = written(_file(classes, node, fp, parts, 0).groupBy("key").count().where(F.col("count") > BUCKET), "hot-segments")
    if (hot := counted.count()) and hot <= HOT_ROWS:
        counted = F.broadcast(counted)
    carried = list(dict.fromkeys([node, fp]))
    if hot:
        grid = F.ceil(F.col("count") / BUCKET).cast("int")
        own = F.pmod(F.xxhash64(node), F.coalesce(grid, F.lit(1))).cast("int")
        rows = rows.join(counted, "key", "left").withColumn("grid", F.coalesce(grid, F.lit(1))).withColumn("own", F.coalesce(own, F.lit(0)))
        every = F.sequence(F.lit(0), F.col("grid") - 1)
        # in a hot value's grid, a column holds a part of those filed and a row a part of those asking
        filed = rows.where("filed").select("key", *carried, "filed", F.explode(every).alias("line"), F.col("own").alias("col"), "grid")
        asking = rows.where("not filed or grid > 1").select("key", *carried, F.lit(False).alias("filed"), F.col("own").alias("line"), F.explode(every).alias("col"), "grid")
        rows = filed.union(asking).select("key", *carried, "filed", (F.col("line") * F.col("grid") + F.col("col")).cast("long").alias("salt"))
    else:
        rows = rows.withColumn("salt", F.lit(0).cast("long"))
    wide = sum(1 + sum(math.comb(w, n) for n in range(1, radius // parts + 1)) // 2 for _, w in _segments(parts))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(classes.count() * wide / TASK_ROWS))
    return arrow(rows.repartition(tasks, "key", "salt"), lambda batches: _meet(node, fp, radius, batches), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, parts: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs with columns doc_id and text.

    component_id is the smallest doc_id reachable over links of `radius` or fewer differing bits. Null and empty texts
    have fingerprint 0 and link like any other. Rows that repeat a doc_id come back as often as they came. A row whose
    doc_id is null comes back with its fingerprint and links nothing; its component_id is null. Other columns of docs
    are not read. No rows give no rows.
    """
    shared_root(prepare(docs.sparkSession))
    found = written(fingerprints(docs, words), "fingerprints")
    classes = written(found.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(links(classes, radius, parts)).withColumnRenamed("node", "fp")
    near = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = near.groupBy("root").agg(F.min("least").alias("component_id"))
    named = near.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
