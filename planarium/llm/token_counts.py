"""Token counts without tokens: byte-pair merging over a linked list, with a heap of adjacent pairs.

The lowest-ranked adjacent pair is popped and merged again and again. The count is the number of initial symbols
(a character that is no piece counts as its UTF-8 bytes) minus the number of merges; no identifier is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, prepare
from .pieces import load, marked, runs

#: Runs whose counts a worker remembers, and the longest run that it remembers.
REMEMBERED, LONGEST = 400_000, 64


def merges(run: str, ranks: dict[str, int]) -> int:
    """How many merges the run's characters allow, lowest rank first and leftmost among equals."""
    part = list(run)
    n = len(part)
    rank = ranks.get
    heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := rank(part[i] + part[i + 1])) is not None]
    if not heap:
        return 0
    heapify(heap)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    done = 0
    while heap:
        _, a, b, size = heappop(heap)
        x, y = part[a], part[b]
        if not x or not y or len(x) + len(y) != size:
            continue  # an end of this pair has been merged since
        x += y
        part[a], part[b] = x, ""
        done += 1
        after[a] = c = after[b]
        if c < n:
            before[c] = a
            if (r := rank(x + part[c])) is not None:
                heappush(heap, (r, a, c, len(x) + len(part[c])))
        if (p := before[a]) >= 0 and (r := rank(part[p] + x)) is not None:
            heappush(heap, (r, p, a, len(part[p]) + len(x)))
    return done


def tokens(run: str, ranks: dict[str, int]) -> int:
    symbols = len(run)
    for c in set(run):
        if c not in ranks:
            symbols += (len(c.encode()) - 1) * run.count(c)
    return symbols - merges(run, ranks)


class Counts(dict):
    """Remembers the count of each run."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, run: str) -> int:
        n = tokens(marked(run), self.ranks)
        if len(run) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[run] = n
        return n

    def of(self, text: str | None) -> int:
        return sum(map(self.__getitem__, runs(text or "")))


def count_tokens(docs: DataFrame, limit: int = 4096, model: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs with columns doc_id and text.

    Counts are those of the library without added tokens, over whole texts. A null text counts as an empty one: no
    bytes and no tokens. Rows that repeat come back as often as they came; a null doc_id stays null; other columns
    are not read; no rows give no rows. `model` is a file that the driver reads; executors get its pieces by broadcast.
    """
    spark = prepare(docs.sparkSession)
    ranks = spark.sparkContext.broadcast(load(model).ranks)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(ranks.value)
        for batch in batches:
            texts = batch.column(1)
            n = np.fromiter((counts.of(texts[i].as_py()) for i in range(len(texts))), np.int64, len(texts))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return arrow(docs.select(F.col("doc_id").cast("long"), text, F.octet_length(text).cast("long")), step, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
