"""Near-duplicates of the pipeline: five-word shingles at a Jaccard similarity of 0.8 or more.

Documents with equal sets of shingles are one class. Candidates come two ways. Fingerprints, SimHash of 64 bits over the
set, link where they differ in RADIUS bits or fewer; multi-index hashing over four segments with balls of one bit finds
every such pair. But two sets of similarity J differ in a share acos(2 J / (1 + J)) / pi of their bits, 10 of 64 at 0.8,
and no small ball reaches so far: fingerprints alone can't give the result that is asked for. So MinHashes of ROWS
functions make a band besides, and sets that agree in one of BANDS bands are candidates: a pair at 0.8 has none with a
chance of (1 - 0.8 ** 5) ** 24, 7 in 100,000.

No candidate counts before it is verified on the sets themselves. Candidates form groups. A small group is held in one
task, which compares its sets until no link is open. A large one is dealt into blocks: first every set meets a few pivots,
which joins most of a dense group; then the sets that are not in the group's largest part meet every other set, block by
block. So every pair in a group whose two sets no other links have joined is compared, whatever the group's size, and no
task holds more than two blocks.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graphs import connected_components
from .common import arrow, discard, grouped, prepare, sized, written
from .simhash import BUCKET, SEED, forest, links

#: Words to a shingle, segments of a fingerprint, differing bits of 64.
WORDS, PARTS, RADIUS = 5, 4, 7
#: The similarity from which documents are near-duplicates; bands of MinHashes, and functions to a band.
LEAST, BANDS, ROWS = 0.8, 24, 5
#: Shingles and sets of a group that is held whole, shingles to a block, sets that all others of a large group meet first.
WHOLE, MEMBERS, BLOCK, PIVOTS = 400_000, 1000, 400_000, 32
#: Parts that the sets of a common band are dealt into.
PIECES = 64
_FLIP, _TIMES = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of the text, lower-cased in ASCII, by their hashes in order; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = list(itertools.accumulate([len(w) + 1 for w in found]))
    last = ends[words - 1 :] or ends[-1:]
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a : b - 1], SEED) for a, b in zip([0, *ends], last)], np.uint64))


def fingerprint(values: np.ndarray) -> int:
    """64 bits over distinct shingles as a signed long: a bit is set if it is in over half of them; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 255):
        block = np.unpackbits(values[at : at + 255, None].view(np.uint8), axis=1, bitorder="little")
        ones += block.sum(0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.int64)[0])


def bands(values: np.ndarray) -> np.ndarray:
    """A key for each band of the shingles' MinHashes; none without shingles."""
    if not len(values):
        return np.zeros(0, np.int64)
    values = values ^ (values >> np.uint64(32))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1024):
        mixed = (values[at : at + 1024, None] ^ _FLIP) * _TIMES
        np.minimum(least, ((mixed ^ (mixed >> np.uint64(29))) * _TIMES).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def linked(names: np.ndarray, sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """For each set the smallest name reachable over pairs of a Jaccard similarity of `least` or more; equal names link."""
    order = np.argsort(names, kind="stable")
    size = np.array([len(x) for x in sets], np.int64)[order]
    values, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    names, root = names[order], np.full(len(order), -1)
    start = np.cumsum(size) - size
    left, held = np.arange(len(order)), np.zeros(len(values), np.int64)
    while len(left):
        first, left = left[0], left[1:]
        root[first], queue = first, [first]
        flat_left, size_left = flat[start[first] + size[first] :], size[left]
        while queue and len(left):
            one = queue.pop()
            own = flat[start[one] : start[one] + size[one]]
            held[own] = 1
            upto = np.r_[0, held[flat_left].cumsum()]
            held[own] = 0
            ends = size_left.cumsum()
            both = upto[ends] - upto[ends - size_left]
            hit = (both >= least * (size[one] + size_left - both) - 1e-9) | (names[left] == names[one])
            if hit.any():
                root[left[hit]] = first
                queue += left[hit].tolist()
                flat_left = flat_left[np.repeat(~hit, size_left)]
                left, size_left = left[~hit], size_left[~hit]
        start, flat = np.zeros(len(order), np.int64), flat_left
        start[left] = size_left.cumsum() - size_left
    out = np.zeros(len(order), names.dtype)
    out[order] = names[root]
    return out


def between(left: list[np.ndarray], right: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """For each set of left, then of right, the first set reachable over pairs, one from each side, of `least` or more."""
    size = np.array([len(x) for x in right], np.int64)
    values, flat = np.unique(np.concatenate(right), return_inverse=True)
    start, held = np.cumsum(size) - size, np.zeros(len(values), np.int32)
    a, b = [], []
    for k, one in enumerate(left):
        own = np.minimum(np.searchsorted(values, one), len(values) - 1)
        own = own[values[own] == one]
        held[own] = 1
        both = np.add.reduceat(held[flat], start)
        held[own] = 0
        hit = np.flatnonzero(both >= least * (len(one) + size - both) - 1e-9)
        a.append(np.full(len(hit), k))
        b.append(hit + len(left))
    return forest(np.concatenate(a), np.concatenate(b), len(left) + len(right))


def _sets(table: pa.Table, words: int) -> list[np.ndarray]:
    return [shingles(x.as_py(), words) for x in table.column("text")]


def _edges(names: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(names != roots)
    return pa.record_batch([pa.array(names[moved]), pa.array(roots[moved])], ["a", "b"])


def _whole(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, node, text), ordered by root: the links within each root's rows, as a forest."""
    for table in grouped(batches, 1):
        names = table.column("node").to_numpy()
        yield _edges(names, linked(names, _sets(table, words)))


def _blocks(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, line, col, asks, node, text), ordered so: the links between those that ask and the others, as a forest."""
    for table in grouped(batches, 3):
        names, asks, sets = table.column("node").to_numpy(), table.column("asks").to_numpy(), _sets(table, words)
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        if len(left) and len(right):
            order = np.r_[left, right]
            found = between([sets[k] for k in left], [sets[k] for k in right])
            yield _edges(names[order], names[order][found])


def _meet(asking: DataFrame, others: DataFrame, words: int) -> DataFrame:
    """Edges between sets of asking and of others that lie in one block (root, line, col)."""
    columns = ("root", "line", "col", "asks", "node", "text")
    both = asking.withColumn("asks", F.lit(True)).select(*columns).union(others.withColumn("asks", F.lit(False)).select(*columns))
    both = both.repartition("root", "line", "col").sortWithinPartitions("root", "line", "col")
    return arrow(both, lambda batches: _blocks(words, batches), "a long, b long")


def _verified_large(large: DataFrame, words: int) -> list[DataFrame]:
    """Edges whose components are those of all verified links within large groups: (root, node, n, total, members, text)."""
    wide = F.ceil(F.col("total") / BLOCK).cast("int")
    dealt = large.withColumn("cols", wide).withColumn("col", F.pmod(F.xxhash64("node"), F.col("cols")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("cols") - 1))
    pivots = dealt.where(F.pmod(F.xxhash64("node", F.lit(7)), F.col("members")) < PIVOTS).withColumn("col", every).withColumn("line", F.lit(0))
    first = written(_meet(pivots, dealt.withColumn("line", F.lit(0)), words), "pivot-links")
    parts = written(connected_components(first).withColumnRenamed("root", "part"), "pivot-parts")
    named = large.select("root", "node", "n").join(sized(parts), "node", "left").withColumn("part", F.coalesce("part", "node"))
    most = named.groupBy("root", "part").agg(F.count("*").alias("size")).groupBy("root").agg(F.max_by("part", F.struct("size", "part")).alias("most"))
    # each of these groups is large, so they are few
    apart = written(named.join(sized(written(most, "largest-parts")), "root").where("part <> most").select("root", "node", "n"), "sets-apart")
    lines = sized(written(apart.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("lines")), "lines"))
    asking = dealt.join(sized(apart.select("node")), "node", "left_semi").join(lines, "root")
    asking = asking.withColumn("line", F.pmod(F.xxhash64("node", F.lit(1)), F.col("lines")).cast("int")).withColumn("col", every)
    others = dealt.join(lines, "root").withColumn("line", F.explode(F.sequence(F.lit(0), F.col("lines") - 1)))
    return [first, written(_meet(asking, others, words), "block-links")]


def _agreed(filed: DataFrame) -> DataFrame:
    """Edges (a, b) from the nodes of each key of filed (key, node) to its least, those of a common key part by part."""
    common = written(filed.groupBy("key").count().where(F.col("count") > BUCKET).select("key", F.lit(True).alias("hot")), "common-bands")
    dealt = filed.join(sized(common), "key", "left")
    dealt = dealt.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(PIECES))).otherwise(0).cast("int"))
    first = dealt.withColumn("m", F.min("node").over(Window.partitionBy("key", "part")))
    again = first.where("hot and node = m").select("key", "node").withColumn("m", F.min("node").over(Window.partitionBy("key")))
    return first.select("node", "m").union(again.select("node", "m")).where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, ident, text, whole) for the rows of docs that have a doc_id; ident is a hash of all other columns."""
    others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c.lower() not in ("doc_id", "text")]
    text = F.col("text").cast("string")
    rest = [F.to_json(F.struct(*others))] if others else []
    return docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text.isNull(), text, *rest).alias("ident"),
        text.alias("text"),
        F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("whole"),
    )


def _labelled(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """(doc_id, ident, root), written, for the rows of docs that have a doc_id; root names the group of near-duplicates."""
    prepare(docs.sparkSession)
    rows = _keyed(docs)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), words) for text in batch.column(2)]
            prints = np.array([(fingerprint(x), *np.frombuffer(xxhash.xxh3_64_digest(x.tobytes()), np.int64), len(x)) for x in sets], np.int64).reshape(-1, 3)
            keys = [bands(x) for x in sets]
            ends = np.r_[0, np.cumsum([len(x) for x in keys])]
            filed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(prints[:, k]) for k in range(3)), filed], ["doc_id", "ident", "fp", "node", "n", "bands"])

    schema = "doc_id long, ident long, fp long, node long, n long, bands array<long>"
    found = written(arrow(rows.select("doc_id", "ident", "text"), step, schema).withColumn("row", F.monotonically_increasing_id()), "shingles")
    classes = found.where("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), F.min("n").alias("n"))
    classes = written(classes, "shingle-classes")
    filed = found.select("row", "node", "bands").join(sized(classes.select("row")), "row", "left_semi").select(F.explode("bands").alias("key"), "node")
    candidates = written(connected_components(links(classes, radius, PARTS, "node", "fp").union(_agreed(filed))), "candidates")
    members = candidates.join(classes, "node")
    sizes = members.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    large = sized(written(sizes.where((F.col("total") > WHOLE) | (F.col("members") > MEMBERS)), "large-groups"))
    chosen = found.select("row", "doc_id", "ident").join(sized(members.select("row", "root", "node", "n")), "row")
    chosen = written(chosen.join(large, "root", "left").select("doc_id", "ident", "root", "node", "n", "total", "members"), "candidate-groups")
    texts = rows.select("doc_id", "ident", "text").join(sized(chosen), ["doc_id", "ident"])
    held = texts.where("total is null").select("root", "node", "text").repartition("root").sortWithinPartitions("root")
    edges = [written(arrow(held, lambda batches: _whole(words, batches), "a long, b long"), "group-links")]
    if not chosen.where("total is not null").isEmpty():
        big = written(texts.where("total is not null"), "large-texts")
        edges += _verified_large(big, words)
        discard(big)
    roots = written(connected_components(functools.reduce(DataFrame.union, edges)), "verified")
    named = found.select("doc_id", "ident", "node").join(sized(roots), "node", "left").select("doc_id", "ident", F.coalesce("root", "node").alias("root"))
    named = written(named, "near-groups")
    discard(found, classes, candidates, chosen, roots, *edges)
    return named


def groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, component_id) for the rows of docs that have a doc_id; component_id is the smallest doc_id of the group.

    docs has doc_id and text. Null and empty texts are near-duplicates of each other and of nothing else; a text of fewer
    than `words` words is one shingle. Rows that repeat come back as often as they came, and rows of one doc_id with
    unlike texts are rows like any others. No rows give no rows. Sets are named by 64 bits.
    """
    found = _labelled(docs, words, radius)
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Of each group one row, all columns: that with the smallest doc_id, and of those the one with the least hash of its
    other columns. Of rows equal in all columns one stays; rows without a doc_id all stay, in no group. Two rows of one
    doc_id that are no near-duplicates both stay. docs has doc_id, text and any other columns; no rows give no rows.
    """
    keys = ["doc_id", "ident"]
    found = _labelled(docs, words, radius)
    first = found.groupBy("root").agg(F.min(F.struct(*keys)).alias("first"), F.count("*").alias("size")).where("size > 1").select("root", "first")
    gone = found.join(sized(written(first, "first-rows")), "root").where(F.struct(*keys) != F.col("first")).select(*keys).distinct()
    gone = written(gone, "rows-that-go")
    repeated = written(found.groupBy(*keys).count().where("count > 1").select(*keys), "repeated")
    discard(found)
    kept = _keyed(docs).select(*keys, "whole").join(sized(gone), keys, "left_anti")
    if not repeated.isEmpty():
        again = sized(repeated)
        kept = kept.join(again, keys, "left_anti").union(kept.join(again, keys, "left_semi").dropDuplicates(keys))
    kept = kept.select(*(F.col(f"whole.c{k}").alias(c) for k, c in enumerate(docs.columns)))
    return kept.union(docs.where("doc_id is null"))
