"""Exact top-k by inner product, from KD-trees over shards of the vectors.

Median splits fitted on a bounded sample deal all vectors into cells, and a cell's vectors lie in shards of bounded size.
A tree halves its shard at medians down to leaves; every leaf, and every cell, has the tight box around its vectors. No
vector in a box can score above the box's bound for a query. Each query first meets one shard of the cell with the
highest bound, and takes the k-th score found there along to those cells only whose bound reaches it. In a shard it opens
leaves from the highest bound down and stops where the bound falls under its k-th score; many queries do so side by side,
each its own next leaf in every turn. A shard's vectors are held while its queries stream by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, grouped, prepare, written

#: Vectors to a shard, queries to a block of a shard's, vectors to a leaf, queries side by side.
SHARD, BLOCK, LEAF, ABREAST = 16_384, 262_144, 512, 1024
#: Cells at most, and numbers in the sample that they are fitted on.
CELLS, SAMPLE = 256, 4_000_000


def _halves(vectors: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(axis, lower half, upper half) of rows by the median of the widest axis; None where all are equal."""
    own = vectors[rows]
    if not own.shape[1]:
        return None
    spread = own.max(0) - own.min(0)
    axis = int(np.argmax(spread))
    if not spread[axis]:
        return None
    order, half = np.argsort(own[:, axis], kind="stable"), len(rows) // 2
    return axis, rows[order[:half]], rows[order[half:]]


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box, the highest inner product that the box allows."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Splits:
    """Median splits of a sample: nodes (axis, value, left, right), or (-1, 0, cell, 0) for a cell."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.cells = 0
        self._build(sample, np.arange(len(sample)), cells)

    def _build(self, sample: np.ndarray, rows: np.ndarray, cells: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0, self.cells, 0))
        cut = _halves(sample, rows) if cells > 1 and len(rows) > 1 else None
        if cut is None:
            self.cells += 1
            return at
        axis, lower, upper = cut
        left = self._build(sample, lower, cells // 2)
        self.nodes[at] = (axis, int(sample[upper, axis].min()), left, self._build(sample, upper, cells - cells // 2))
        return at

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector: below a node's value to the left."""
        out, todo = np.zeros(len(vectors), np.int32), [(0, np.arange(len(vectors)))]
        while todo:
            at, rows = todo.pop()
            axis, value, left, right = self.nodes[at]
            if axis < 0:
                out[rows] = left
            else:
                below = vectors[rows, axis] < value
                todo += [(left, rows[below]), (right, rows[~below])]
        return out


class Tree:
    """The leaves of a KD-tree over a shard, with their tight boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int | None = None):
        self.rows: list[np.ndarray] = []
        todo = [np.arange(len(ids))]
        while todo:
            rows = todo.pop()
            cut = _halves(vectors, rows) if len(rows) > (leaf or LEAF) else None
            if cut is None:
                self.rows.append(rows)
            else:
                todo += [cut[2], cut[1]]
        self.ids, self.vectors = [ids[r] for r in self.rows], [vectors[r] for r in self.rows]
        self.low, self.high = (np.stack([f(v, 0) for v in self.vectors]) for f in (np.min, np.max))

    def search(self, queries: np.ndarray, names: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, id, score) of each query's best k whose scores are at least its floor, ties to smaller ids, and how
        many leaves were opened. The vectors whose id is the query's own name take no part."""
        bounds, floors = _bounds(queries, self.low, self.high), floors.copy()
        turn = np.argsort(-bounds, 1, kind="stable")
        who, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, queries.dtype)
        live, opened = np.arange(len(queries)), 0
        for n in range(len(self.rows)):
            leaf = turn[live, n]
            go = bounds[live, leaf] >= floors[live]  # the next leaves' bounds are no higher
            live, leaf = live[go], leaf[go]
            if not len(live):
                break
            opened += len(live)
            order = np.argsort(leaf, kind="stable")
            parts = [(who, ids, scores)]
            for own in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                at, asked = leaf[own[0]], live[own]
                found = queries[asked] @ self.vectors[at].T
                if found.dtype == object:
                    found = np.clip(found, -(1 << 63), (1 << 63) - 1)
                row, col = np.nonzero((found >= floors[asked][:, None]) & (self.ids[at][None, :] != names[asked][:, None]))
                parts.append((asked[row], self.ids[at][col], found[row, col]))
            if sum(len(p[0]) for p in parts[1:]):
                who, ids, scores = (np.concatenate(x) for x in zip(*parts))
                best = np.lexsort((ids, -scores, who))
                who, ids, scores = who[best], ids[best], scores[best]
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
                last = np.flatnonzero(rank == k - 1)
                floors[who[last]] = scores[last]
                who, ids, scores = who[rank < k], ids[rank < k], scores[rank < k]
        return who, ids, scores, opened


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally many numbers."""
    flat = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in column.chunks)])
    return flat.reshape(len(column), -1 if len(column) and len(flat) else 0)


def _most(vectors: np.ndarray) -> int:
    return max(abs(int(vectors.min())), abs(int(vectors.max()))) if vectors.size else 0


def _search(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, shard, block, asks, id, floor, v), ordered so, a shard's vectors before its queries."""
    held: tuple | None = None
    for table in grouped(batches, 4, whole=False):
        keys = tuple(table.column(c)[0].as_py() for c in ("dim", "shard", "block", "asks"))
        vectors, ids = _matrix(table.column("v")), table.column("id").to_numpy()
        if not keys[3]:
            if held is not None and held[0] == keys:
                vectors, ids = np.concatenate([held[1], vectors]), np.r_[held[2], ids]
            held = (keys, vectors, ids, {})
            continue
        if held is None or held[0][:3] != keys[:3]:
            continue
        # doubles hold every product and sum, or Python's integers have to
        most, widest = _most(held[1]), _most(vectors)
        kind = np.float64 if 2 * most * widest * max(1, vectors.shape[1]) < 1 << 53 else object
        if kind not in held[3]:
            held[3][kind] = Tree(held[2], held[1].astype(kind))
        floors = table.column("floor").to_numpy().astype(kind)
        for at in range(0, len(ids), ABREAST):
            names = ids[at : at + ABREAST]
            who, found, scores, _ = held[3][kind].search(vectors[at : at + ABREAST].astype(kind), names, k, floors[at : at + ABREAST])
            yield pa.record_batch([pa.array(names[who]), pa.array(found), pa.array([int(s) for s in scores], pa.int64())], ["query_id", "vec_id", "score"])


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) for each length of the batch's vectors."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, _matrix(pa.chunked_array([batch.column("v").take(pa.array(rows))]))


def _dealt(clean: DataFrame, sizes: dict[int, int]) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """clean with the cell of each vector, and the cells' boxes by length. sizes: the vectors of each length beyond SHARD."""
    spark, splits = clean.sparkSession, {}
    for dim, count in sizes.items():
        rows = max(2, SAMPLE // max(1, dim * len(sizes)))
        sample = clean.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id", "v").limit(rows).select("v").toArrow()
        splits[dim] = Splits(_matrix(sample.column("v")), min(CELLS, -(-count // SHARD), max(1, rows // 16)))
    sent = spark.sparkContext.broadcast(splits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(len(batch), np.int32)
            for dim, rows, vectors in _by_dim(batch):
                if dim in sent.value:
                    cell[rows] = sent.value[dim].place(vectors)
            yield pa.record_batch([batch.column(c) for c in ("id", "v", "dim")] + [pa.array(cell)], ["id", "v", "dim", "cell"])

    dealt = written(arrow(clean.select("id", "v", "dim"), place, "id long, v array<long>, dim int, cell int"), "celled-vectors")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[tuple, np.ndarray] = {}
        high: dict[tuple, np.ndarray] = {}
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for dim, rows, vectors in _by_dim(batch):
                for cell in np.unique(cells[rows]).tolist():
                    own, key = vectors[cells[rows] == cell], (dim, cell)
                    low[key] = np.minimum(low.get(key, own[0]), own.min(0))
                    high[key] = np.maximum(high.get(key, own[0]), own.max(0))
        for (dim, cell), x in low.items():
            yield pa.record_batch([pa.array([dim] * dim, pa.int32()), pa.array([cell] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(x), pa.array(high[dim, cell])], ["dim", "cell", "axis", "low", "high"])

    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if sizes:
        mine = dealt.where(F.col("dim").isin(list(sizes)))
        table = arrow(mine, boxes, "dim int, cell int, axis int, low long, high long").groupBy("dim", "cell", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
        for dim, own in table.groupby("dim"):
            low, high = (np.zeros((splits[dim].cells, dim), np.int64) for _ in range(2))
            # a cell without vectors has an empty box at nought, and no shard to send a query to
            low[own["cell"], own["axis"]], high[own["cell"], own["axis"]] = own["low"], own["high"]
            found[int(dim)] = low, high
    return dealt, found


def _reached(boxes: dict[int, tuple[np.ndarray, np.ndarray]], home: bool):
    """(id, v, floor, dim, home, cell) of queries: for each the cell with the highest bound, or all whose bound reaches its floor."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), ABREAST):
                batch = whole.slice(low, ABREAST)
                every, cells = [], []
                for dim, rows, vectors in _by_dim(batch):
                    row, cell = np.arange(len(rows)), np.zeros(len(rows), np.int64)
                    if dim in boxes.value:
                        low_, high = boxes.value[dim]
                        bounds = _bounds(vectors.astype(float), low_.astype(float), high.astype(float))
                        if home:
                            cell = bounds.argmax(1)
                        else:
                            exact = 2 * max(_most(low_), _most(high)) * _most(vectors) * dim < 1 << 53
                            floors = np.where(exact, batch.column("floor").to_numpy()[rows].astype(float), -np.inf)
                            row, cell = np.nonzero(bounds >= floors[:, None])
                    every.append(rows[row])
                    cells.append(cell)
                every, cells = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (every, cells))
                part = batch.take(pa.array(every))
                yield pa.record_batch([*part.columns, pa.array(cells.astype(np.int32))], [*part.schema.names, "cell"])

    return step


_ASKED = "id long, v array<long>, floor long, dim int, home long, cell int"


def _none():
    """A floor that every score reaches."""
    return F.lit(-(1 << 63)).cast("long")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every`, its k highest scores among all other rows.

    vectors has vec_id and embedding; a component x counts as floor(scale * x). Ties go to the smaller vec_id. Vectors
    that are null or hold null or infinite or undefined components, and rows without a vec_id, take no part. Vectors of
    different lengths have no score; those without components score 0. A query with fewer than k partners gets all.
    Rows that repeat a vec_id are all candidates of other queries, and one query: the least vector among them. A score
    beyond a long counts as the nearest long. Other columns are not read; no rows give no rows.
    """
    spark = prepare(vectors.sparkSession)
    clean = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    clean = clean.where("id is not null and x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    clean = clean.select("id", F.transform("x", lambda c: F.floor(c * float(scale)).cast("long")).alias("v")).withColumn("dim", F.size("v"))
    clean = written(clean, "vectors")
    # each such length has over SHARD vectors; shorter tables need no cells
    sizes = {r["dim"]: r["count"] for r in clean.groupBy("dim").count().where(F.col("count") > SHARD).collect()}
    dealt, boxes = _dealt(clean, sizes)
    queries = written(clean.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "vector-queries")
    shards = written(dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards")), "shards")
    place = F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")
    name = (F.col("cell") + F.lit(CELLS).cast("long") * F.col("part")).alias("shard")
    stored = dealt.join(shards, ["dim", "cell"]).withColumn("part", place).select("dim", "cell", "shards", name, "id", "v")
    sent = spark.sparkContext.broadcast(boxes)
    columns = ("dim", "shard", "block", "asks", "id", "floor", "v")

    def met(asked: DataFrame, name_: str) -> DataFrame:
        """What queries (dim, shard, id, floor, v) find; a shard that more than BLOCK of them ask is held in several tasks."""
        blocks = asked.groupBy("dim", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        mine = stored.join(blocks, ["dim", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        mine = mine.withColumn("asks", F.lit(0)).withColumn("floor", _none())
        asked = asked.join(blocks, ["dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")).withColumn("asks", F.lit(1))
        both = mine.select(*columns).union(asked.select(*columns))
        both = both.repartition("dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "asks", "id")
        return written(arrow(both, lambda batches: _search(k, batches), "query_id long, vec_id long, score long"), name_)

    asked_columns = ("id", "v", "floor", "dim", "home")
    home = arrow(queries.withColumn("floor", _none()).withColumn("home", F.lit(None).cast("long")).select(*asked_columns), _reached(sent, True), _ASKED)
    home = written(home.join(shards, ["dim", "cell"], "left").withColumn("part", place).select("id", "v", "floor", "dim", name), "home-queries")
    near = met(home.where("shard is not null"), "home-shards")
    floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asked = home.drop("floor").join(floors, F.col("id") == F.col("query_id"), "left")
    asked = asked.select("id", "v", F.coalesce("floor", _none()).alias("floor"), "dim", F.col("shard").alias("home"))
    away = arrow(asked, _reached(sent, False), _ASKED).join(shards, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    away = away.withColumn("shard", name).where("home is null or shard <> home").select("id", "v", "floor", "dim", "shard")
    every_one = near.union(met(written(away, "away-queries"), "away-shards"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every_one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
