"""Benchmark passages in training texts, copied, edited or paraphrased.

Words are the lower-cased runs of word characters, and each character of a script without spaces is a word. Every n-gram
of an item is a seed, however common it is: a seed in a document proposes a place for the whole item, and seeds that put
the item's start at nearly one place share a window. The window is so wide that no alignment through one of its seeds
that reaches half of a perfect score leaves it: such an alignment skips at most as many words as the item has. A window
is dropped only if its words cannot reach the score that is asked for: an item's word that is not there costs a mismatch
or a gap, so the best run over the item's words, MATCH for each that is there and the smaller loss for each that is not,
bounds every alignment. Smith-Waterman alignment of the item with the words of the other windows gives the score.
Alignments run side by side in numpy; each depends on its own item and window alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, prepare, released

#: Words to a seed; scores of alignment; share of an item's best score from which a document holds it.
SEED, MATCH, OTHER, GAP, LEAST = 3, 2, -1, -1, 0.5
#: Characters of benchmark text that are compiled and broadcast at once; a larger benchmark is taken in parts.
PART = 32 << 20
#: Cells of alignments that run side by side.
CELLS = 400_000
#: Scripts without spaces: Thai, Lao, Burmese and Khmer letters, kana, Chinese characters.
_UNSPACED = "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ec6\u1000-\u103f\u1780-\u17d3\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORDS = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


class Items:
    """A part of the benchmark: its words by number from 1, its items, and their n-grams in order of a joint key."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n = n
        self.names, texts = [], []
        for name, text in sorted({(k, t) for k, t in rows if k is not None}):
            if len(found := words_of(text)) >= n:
                self.names.append(name)
                texts.append(found)
        self.numbers: dict[str, int] = {}
        self.words = [np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in t], np.int64) for t in texts]
        self.wide = len(self.numbers) + 1
        if self.wide**n >= 1 << 63:
            raise ValueError("seeds of so many words do not fit in a key")
        keys = [self.keys(w) for w in self.words]
        empty = [np.zeros(0, np.int64)]
        self.grams, gram_of = np.unique(np.concatenate(keys + empty), return_inverse=True)
        order = np.argsort(gram_of, kind="stable")
        self.item_of = np.repeat(np.arange(len(keys)), [len(k) for k in keys]).astype(np.int64)[order]
        self.place_of = np.concatenate([np.arange(len(k)) for k in keys] + empty).astype(np.int64)[order]
        self.first = np.searchsorted(gram_of[order], np.arange(len(self.grams) + 1))

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        """The key of each n-gram, 0 where a word is in no item."""
        size = max(0, len(numbers) - self.n + 1)
        key, known = np.zeros(size, np.int64), np.ones(size, bool)
        for j in range(self.n):
            part = numbers[j : j + size]
            key = key * self.wide + part
            known &= part > 0
        return np.where(known, key, 0)

    def find(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the text's words by number, 0 for others; places of n-grams of items; which of them)."""
        words = words_of(text)
        numbers = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
        keys = self.keys(numbers)
        at = np.flatnonzero(keys)
        gram = np.searchsorted(self.grams, keys[at])
        gram[gram == len(self.grams)] = 0
        hit = self.grams[gram] == keys[at] if len(self.grams) else np.zeros(0, bool)
        return numbers, at[hit], gram[hit]


def align(items: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best local score, where it starts, where it ends) of each row's item in each row's window of words.

    items is padded with -1, windows with -2, which match nothing. Of equal scores the one that ends first is taken,
    and of those the one that starts first.
    """
    rows, wide = windows.shape
    k = np.int64(wide + 1)  # a cell is its score times k, plus how early it starts
    start = (k - 1 - np.arange(wide))[None, :]
    slope = (-GAP * k * np.arange(wide))[None, :]
    last = np.zeros((rows, wide), np.int64)
    best, end = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in range(items.shape[1]):
        same = windows == items[:, i : i + 1]
        step = np.where(same, MATCH, OTHER) * k
        diagonal = np.zeros_like(last)
        diagonal[:, 1:] = last[:, :-1]
        new = np.where(diagonal >= k, diagonal + step, np.where(same, step + start, 0))
        new = np.maximum(new, last + GAP * k)
        new = np.maximum(new, 0)
        new = np.maximum.accumulate(new + slope, 1) - slope
        new[new < k] = 0
        new[i >= sizes] = 0
        at = new.argmax(1)
        top = new[np.arange(rows), at]
        better = (top // k > best // k) | ((top // k == best // k) & (best > 0) & ((at < end) | ((at == end) & (top > best))))
        best, end = np.where(better, top, best), np.where(better, at, end)
        last = new
    return best // k, np.where(best > 0, k - 1 - best % k, 0), end


def _bound(items: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """No local alignment of a row's item with its window scores more: the best run of its words, by whether they are there."""
    rows = np.arange(len(items))[:, None]
    wide = int(max(items.max(initial=0), windows.max(initial=0))) + 3
    there = np.isin(items + rows * wide + 2, windows + rows * wide + 2)
    gain = np.where(there, MATCH, max(OTHER, GAP))
    gain[np.arange(items.shape[1])[None, :] >= sizes[:, None]] = 0
    upto = np.concatenate([np.zeros((len(items), 1), np.int64), gain.cumsum(1)], 1)
    return (upto - np.minimum.accumulate(upto, 1)).max(1)


def _score(items: Items, texts: list[str | None], least: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, start, end) of the best place of each item in each text, where its score is `least` or more."""
    jobs: list[tuple[int, int, int]] = []  # text, item, start of its window
    words = []
    for k, text in enumerate(texts):
        numbers, at, gram = items.find(text or "")
        words.append(numbers if len(at) else None)
        if not len(at):
            continue
        low, many = items.first[gram], items.first[gram + 1] - items.first[gram]
        seed = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, start = items.item_of[seed], np.repeat(at, many) - items.place_of[seed]
        order = np.lexsort((start, item))
        held, since = -1, 0
        for j, s in zip(item[order].tolist(), start[order].tolist()):
            if j != held or s - since > len(items.words[j]) // 4:
                jobs.append((k, j, s))
                held, since = j, s
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    size = np.array([len(items.words[j]) for _, j, _ in jobs], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        n = int(size[order[at]])
        own = order[at : at + max(1, CELLS // (4 * n))]
        own = own[size[own] <= max(16, 2 * n)]
        at += len(own)
        top = int(size[own].max())
        # an item's seeds start from s to s + n // 4; half a perfect score leaves room for n words that are not the item's
        left_side, windows = np.full((len(own), top), -1, np.int64), np.full((len(own), 3 * top + top // 4), -2, np.int64)
        begin = []
        for r, job in enumerate(own.tolist()):
            k, j, s = jobs[job]
            n = int(size[job])
            low = max(0, s - n)
            part = words[k][low : s + 2 * n + n // 4]
            left_side[r, :n] = items.words[j]
            windows[r, : len(part)] = part
            begin.append(low)
        begin = np.array(begin)
        may = _bound(left_side, size[own], windows) >= least * MATCH * size[own]
        own, begin, left_side, windows = own[may], begin[may], left_side[may], windows[may]
        found, first, last = align(left_side, size[own], windows)
        for r, job in enumerate(own.tolist()):
            k, j, _ = jobs[job]
            new = (float(found[r]) / (MATCH * int(size[job])), int(begin[r] + first[r]), int(begin[r] + last[r]) + 1)
            old = out.get((k, j))
            if old is None or (-new[0], new[2], new[1]) < (-old[0], old[2], old[1]):
                out[k, j] = new
    return [(k, j, *v) for (k, j), v in sorted(out.items()) if v[0] >= least]


def _parts(docs: DataFrame, benchmark: DataFrame, n: int) -> Iterator[Items]:
    """The benchmark, part by part."""
    prepare(docs.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    parts = max(1, math.ceil((rows.agg(F.sum(F.length("text"))).first()[0] or 0) / PART))
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else rows
        yield Items([tuple(r) for r in own.collect()], n)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, n: int = SEED) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): each document and item whose alignment reaches `least`.

    docs has doc_id and text, benchmark item_id and text. score is the alignment's score over that of a perfect copy;
    the words from start_word to before end_word are those of the best place, the one that ends first of equals. Which
    documents share a batch makes no difference. Windows are whole for `least` from half on. Null and empty texts hold
    nothing; null items, null item_ids and items of fewer than n words are not sought: a shorter n seeks those too, at
    the risk of finding a word or two in any text. An item_id with several texts is as many items. A row that repeats is
    found as often as it comes; a null doc_id stays null; other columns are not read. Empty tables give no rows.
    """
    spark, out = docs.sparkSession, None
    for items in _parts(docs, benchmark, n):
        sent = spark.sparkContext.broadcast(items)

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for whole in batches:
                for at in range(0, len(whole), 256):
                    batch = whole.slice(at, 256)
                    ids = batch.column(0).to_pylist()
                    found = _score(items, batch.column(1).to_pylist(), least)
                    columns = ([ids[r[0]] for r in found], [items.names[r[1]] for r in found], [round(r[2], 6) for r in found], [r[3] for r in found], [r[4] for r in found])
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds)], ["doc_id", "item_id", "score", "start_word", "end_word"])

        rows = arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), step, "doc_id long, item_id long, score double, start_word long, end_word long")
        out = rows if out is None else out.union(rows)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, n: int = SEED) -> DataFrame:
    """The rows of docs, all columns, in which find_leaks() finds no item: rows with null or empty texts stay, as does
    every row where the benchmark is empty; rows that repeat stay as often as they came.
    """
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for items in _parts(docs, benchmark, n):
        sent = spark.sparkContext.broadcast(items)

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low in range(0, len(whole), 256):
                    batch = whole.slice(low, 256)
                    keep = np.ones(len(batch), bool)
                    keep[[r[0] for r in _score(sent.value, batch.column(at).to_pylist(), least)]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(released(step), docs.schema)
    return docs
