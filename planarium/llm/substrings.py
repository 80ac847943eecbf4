"""Repeated passages between documents, removed word by word.

Documents lie in buckets of bounded size. Of every window of `window` words an anchor is taken, the least hash of the
phrases in it, so that equal windows have equal anchors and neighbouring windows mostly share one. What travels between
the rounds is one entry for each bucket and hash, however often a passage recurs in the bucket:

1. anchors meet in shards; those of two or more documents go back to their buckets;
2. the windows at such anchors meet in shards; of those that two or more documents hold, the bucket with the first
   document learns which buckets have to remove them;
3. the first document's bucket cuts the passages that these windows make up and sends their words to those buckets;
4. each bucket compiles automata (Aho-Corasick over words) from the rarest phrases of the passages that it got, and all its
   documents stream through them. Around every phrase found, document and passage are compared word by word.

So hashes only propose: what is removed stands, word for word, in the first document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import compress, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, eased, prepare, released

#: UTF-8 bytes of text to a bucket, and as much again in entries to a shard.
BUCKET_BYTES = 8 << 20
#: Words of passages to an automaton (at most 64 ** 3), words to a stretch of a passage, words compared at once, words
#: searched at once.
PATTERN_WORDS, STRETCH, CELLS, SPAN = 250_000, 64, 1 << 19, 1 << 17
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _rolled(hashes: np.ndarray, n: int, by: np.uint64) -> np.ndarray:
    """A hash of each n consecutive words."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * by + hashes[j : j + size]
    return _mix(out)


class Windows:
    """The windows of a bucket's documents: which document, at which of the bucket's words, with which anchor."""

    def __init__(self, texts: pa.ChunkedArray, ids: pa.ChunkedArray, window: int, keep: bool = False):
        hashed = xxhash.xxh64_intdigest
        parts, self.words, self.sizes = [], [], []
        for k, text in enumerate(texts):
            words = (text.as_py() or "").encode().split()
            self.sizes.append(len(words))
            parts.append(np.fromiter(map(hashed, words), np.uint64, len(words)))
            if keep:
                self.words.append(words)
        self.window = window
        self.hashes = np.concatenate([*parts, np.zeros(0, np.uint64)])
        sizes = np.array(self.sizes, np.int64)
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        known = np.array([x.is_valid for x in ids], bool)
        self.docs = np.array([x.as_py() if x.is_valid else 0 for x in ids], np.int64)
        left = np.repeat(ends, sizes) - np.arange(len(self.hashes))  # words from here to the document's end
        good = (left >= window) & np.repeat(known, sizes)
        self.at = np.flatnonzero(good)
        self.of = np.repeat(self.docs, sizes)[self.at]

    def anchors(self, phrase: int) -> np.ndarray:
        phrases = _rolled(self.hashes, phrase, _A)
        size = max(0, len(self.hashes) - self.window + 1)
        least = phrases[:size].copy()
        for j in range(1, self.window - phrase + 1):
            np.minimum(least, phrases[j : j + size], out=least)
        return least[self.at]

    def names(self, chosen: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits that name each window together."""
        at = self.at[chosen]
        return _rolled(self.hashes, self.window, _B)[at], (_rolled(self.hashes, self.window, _C)[at] >> np.uint64(32)).astype(np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """Eight-byte integers with equal bytes side by side, so that small ones cost little when compressed."""
    return np.ascontiguousarray(values.astype(np.int64, copy=False).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(np.int64)


def _spans(columns: list[np.ndarray], docs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct rows of columns, each with its smallest and largest doc_id."""
    order = np.lexsort((docs, *reversed(columns)))
    columns, docs = [c[order] for c in columns], docs[order]
    new = np.ones(len(docs), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(docs)] - 1 if len(start) else start
    return [c[start] for c in columns], docs[start], docs[end]


_ENTRIES = "shard int, bucket int, name binary, check binary, least binary, reach binary"
_REPLIES = "bucket int, name binary, check binary, least binary, target binary"
_PASSAGES = "bucket int, least binary, words binary"


def _entries(bucket: int, shards: int, names: list[np.ndarray], least: np.ndarray, most: np.ndarray) -> pa.Table:
    shard = (names[0] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    rows: dict[str, list] = {k: [] for k in ("shard", "bucket", "name", "check", "least", "reach")}
    for s in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[s] : cuts[s + 1]]
        rows["shard"].append(int(s))
        rows["bucket"].append(bucket)
        rows["name"].append(names[0][own].tobytes())
        rows["check"].append(names[1][own].tobytes() if len(names) > 1 else b"")
        rows["least"].append(_planes(least[own]))
        rows["reach"].append(_planes(most[own] - least[own]))
    return pa.table(
        [pa.array(rows["shard"], pa.int32()), pa.array(rows["bucket"], pa.int32()), *(pa.array(rows[k], pa.binary()) for k in ("name", "check", "least", "reach"))],
        ["shard", "bucket", "name", "check", "least", "reach"],
    )


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each shard its entries in order of their names, then of doc_ids: (start of each name, name, check, least, most, bucket)."""
    shards: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            shards.setdefault(row.pop("shard"), []).append(row)
    for rows in shards.values():
        name = np.concatenate([np.frombuffer(r["name"], np.uint64) for r in rows])
        check = np.concatenate([np.frombuffer(r["check"], np.uint32) for r in rows])
        least = np.concatenate([_unplanes(r["least"]) for r in rows])
        most = least + np.concatenate([_unplanes(r["reach"]) for r in rows])
        bucket = np.repeat(np.array([r["bucket"] for r in rows], np.int32), [len(r["name"]) // 8 for r in rows])
        if not len(check):
            check = np.zeros(len(name), np.uint32)
        order = np.lexsort((bucket, least, check, name))
        name, check, least, most, bucket = (x[order] for x in (name, check, least, most, bucket))
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (check[1:] != check[:-1])
        yield np.flatnonzero(new), name, check, least, most, bucket


def _replies(to: np.ndarray, name: np.ndarray, *rest: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of _REPLIES, one for each bucket of `to`; rest is check, least and target, or nothing."""
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        told = [x[own].tobytes() for x in rest] or [b""] * 3
        yield pa.record_batch([pa.array([int(to[own[0]])], pa.int32()), *(pa.array([x], pa.binary()) for x in (name[own].tobytes(), *told))], ["bucket", "name", "check", "least", "target"])


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket those of its anchors that two or more documents hold."""
    for start, name, _, least, most, bucket in _shards(batches):
        size = np.diff(np.r_[start, len(name)])
        first, last = (np.repeat(f.reduceat(x, start), size) for f, x in ((np.minimum, least), (np.maximum, most)))
        kept = np.flatnonzero(first < last)
        yield from _replies(bucket[kept], name[kept])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the bucket with the first document of a window: the window and each bucket that has to remove it."""
    for start, name, check, least, most, bucket in _shards(batches):
        size = np.diff(np.r_[start, len(name)])
        first, home = np.repeat(least[start], size), np.repeat(bucket[start], size)
        kept = np.flatnonzero(most > first)
        yield from _replies(home[kept], name[kept], check[kept], first[kept], bucket[kept])


def _joined(replies: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in replies.column(column)), kind)


def _found(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each value is in the sorted array, or -1."""
    if not len(among):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[at] == values, at, -1)


def _passages(found: Windows, replies: pa.Table) -> pa.Table:
    """The words of the confirmed windows that this bucket's documents are the first to hold, a row for each bucket in need.

    Each window is sent once, from its first place in the document. A run of neighbouring windows that the same buckets
    need is a passage; it goes in stretches of STRETCH words that overlap by a window less a word.
    """
    name, check, least, target = (_joined(replies, c, k) for c, k in (("name", np.uint64), ("check", np.uint32), ("least", np.int64), ("target", np.int32)))
    order = np.lexsort((target, check, name))
    name, check, least, target = (x[order] for x in (name, check, least, target))
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (check[1:] != check[:-1])
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(name)]
    asking = np.add.reduceat(_mix(target.astype(np.uint64) + _A), start) if len(start) else np.zeros(0, np.uint64)
    a, b = found.names()
    at = _found(a, name[start])
    hit = np.flatnonzero(at >= 0)
    at = at[hit]
    while (wrong := np.flatnonzero(check[start[at]] != b[hit])).size:  # equal names with another check lie side by side
        more = at[wrong] + 1
        open_ = (more < len(start)) & (name[start[np.minimum(more, len(start) - 1)]] == a[hit[wrong]])
        at[wrong[open_]] += 1
        keep = np.ones(len(hit), bool)
        keep[wrong[~open_]] = False
        hit, at = hit[keep], at[keep]
    own = found.of[hit] == least[start[at]]
    at, one = np.unique(at[own], return_index=True)
    place = found.at[hit[own][one]]
    order = np.argsort(place)
    at, place = at[order], place[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(place) != 1) | (asking[at[1:]] != asking[at[:-1]])
    runs = np.flatnonzero(new)
    window, wide = found.window, max(STRETCH, found.window)
    docs = np.searchsorted(found.starts, place[runs], "right") - 1
    first_docs, said, needed = [], [], []
    for k, low, n, doc in zip(at[runs].tolist(), place[runs].tolist(), np.diff(np.r_[runs, len(at)]).tolist(), docs.tolist()):
        words, low = found.words[doc], low - int(found.starts[doc])
        for first in range(low, low + n, wide - window + 1):
            first_docs.append(int(found.docs[doc]))
            said.append(b" ".join(words[first : min(first + wide, low + n + window - 1)]))
            needed.append(target[start[k] : end[k]])
    to = np.concatenate([np.zeros(0, np.int32), *needed])
    which = np.repeat(np.arange(len(said)), [len(x) for x in needed])
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    rows = [(int(to[own[0]]), _planes(np.array(first_docs, np.int64)[which[own]]), b"\n".join([said[k] for k in which[own].tolist()])) for own in np.split(order, cuts)] if len(order) else []
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "least", "words"])


def _spelled(codes: np.ndarray) -> str:
    """Three characters a word, each one of 64 of its own, as an automaton's nodes look their branches up one by one."""
    parts = np.empty((len(codes), 3), "<u2")
    for k, low in enumerate((0x100, 0x200, 0x300)):
        parts[:, k] = low + (codes >> 6 * k & 63)
    parts[codes < 0] = 1
    return parts.tobytes().decode("utf-16-le")


def covered(words: Iterable[list[bytes]], docs: np.ndarray, passages: Iterable[tuple[list[bytes], int]], window: int, phrase: int) -> list[np.ndarray]:
    """For each document, which of its words lie in a window that also stands in a passage whose doc_id is smaller.

    Every window of a passage holds a phrase that is a pattern of the automaton: of those that the passages repeat least
    one that neighbouring windows share.
    Words become numbers as they come, and documents are searched by spans of SPAN words, so memory doesn't grow with
    the number of phrases that are found.
    """
    codes: dict[bytes, int] = {}
    parts, passage_sizes, firsts = [np.zeros(0, np.int32)], [], []
    for own, first in passages:
        parts.append(np.fromiter((codes.setdefault(w, len(codes)) for w in own), np.int32, len(own)))
        passage_sizes.append(len(own))
        firsts.append(first)
    said = np.concatenate(parts)
    parts, lengths = [np.zeros(0, np.int32)], []
    for own in words:
        parts.append(np.fromiter(map(codes.get, own, repeat(-1)), np.int32, len(own)))
        lengths.append(len(own))
    every = np.concatenate(parts)
    kinds = len(codes)
    del parts, codes
    sizes = np.array(lengths, np.int64)
    ends = np.cumsum(sizes)
    marks = np.zeros(len(every) + 1, np.int32)
    upto = np.cumsum(passage_sizes, dtype=np.int64)
    low = 0
    while low < len(firsts) and len(every):
        before = int(upto[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(upto, before + PATTERN_WORDS, "right")))
        flat = said[before : int(upto[high - 1])]
        known = np.unique(flat)
        number = np.full(kinds + 1, -1, np.int32)  # the last one is for words that no passage has
        number[known] = np.arange(len(known), dtype=np.int32)
        _mark(marks, every, number, ends, sizes, docs, number[flat], np.array(passage_sizes[low:high], np.int64), np.array(firsts[low:high], np.int64), window, phrase)
        low = high
    gone = np.cumsum(marks[:-1]) > 0
    return np.split(gone, ends[:-1]) if len(lengths) else []


def _mark(marks: np.ndarray, every: np.ndarray, number: np.ndarray, ends: np.ndarray, sizes: np.ndarray, docs: np.ndarray, flat: np.ndarray, size: np.ndarray, least: np.ndarray, window: int, phrase: int) -> None:
    """Add 1 to marks where a window begins that a passage has too, and take 1 where it has ended; one automaton's passages."""
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(len(flat))  # words from here to the passage's end
    _, kind, many = np.unique(_rolled(_mix(flat.astype(np.uint64) + _A), phrase, _B), return_inverse=True, return_counts=True)
    common = 2 * np.r_[many[kind], np.full(len(flat) - len(kind), len(flat))]
    common[:: window - phrase + 1] -= 1  # every window holds one of these places, which goes before others as rare
    at = np.flatnonzero(left >= window)
    rarest = np.stack([common[at + j] for j in range(window - phrase + 1)]).argmin(0)
    seeds = np.unique(at + rarest)
    spelled = _spelled(flat)
    patterns: dict[str, int] = {}
    which = np.array([patterns.setdefault(spelled[3 * k : 3 * (k + phrase)], len(patterns)) for k in seeds.tolist()], np.int64)
    del spelled
    automaton = ahocorasick.Automaton()
    for pattern, k in patterns.items():
        automaton.add_word(pattern, k)
    automaton.make_automaton()
    times = np.bincount(which, minlength=len(patterns))
    del patterns
    first = np.cumsum(times) - times
    places = seeds[np.argsort(which, kind="stable")]
    for low in range(0, len(every), SPAN):
        lead = max(0, low - phrase + 1)  # a phrase that ends in this span may begin before it
        found = np.array(list(automaton.iter(_spelled(number[every[lead : low + SPAN]]))), np.int64).reshape(-1, 2)
        hit, kind = found[:, 0] // 3 - phrase + 1 + lead, found[:, 1]
        upto = np.cumsum(times[kind])
        cuts = np.searchsorted(upto, np.arange(CELLS // STRETCH, upto[-1] if len(upto) else 0, CELLS // STRETCH))
        for block in np.split(np.arange(len(hit)), np.unique(cuts)):
            n = times[kind[block]]
            seed = places[np.repeat(first[kind[block]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            own = np.searchsorted(start, seed, "right") - 1
            doc = np.searchsorted(ends, np.repeat(hit[block], n), "right")
            begin = np.repeat(hit[block], n) - (seed - start[own])  # where the whole passage would start
            good = least[own] < docs[doc]
            if not good.any():
                continue
            begin, own, doc = np.unique(np.stack([begin[good], own[good], doc[good]]), axis=1)
            step = max(1, CELLS // int(size[own].max()))
            for k in range(0, len(own), step):
                _compare(marks, every, number, ends, sizes, flat, start, size, begin[k : k + step], own[k : k + step], doc[k : k + step], window)


def _compare(marks: np.ndarray, every: np.ndarray, number: np.ndarray, ends: np.ndarray, sizes: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray, begin: np.ndarray, own: np.ndarray, doc: np.ndarray, window: int) -> None:
    """Word by word: the passage `own` laid over the document `doc`, its first word at the place `begin`."""
    wide = np.arange(int(size[own].max()))[None, :]
    there = begin[:, None] + wide
    same = (wide < size[own][:, None]) & (there >= (ends - sizes)[doc][:, None]) & (there < ends[doc][:, None])
    same &= number[every[np.clip(there, 0, len(every) - 1)]] == flat[np.minimum(start[own][:, None] + wide, len(flat) - 1)]
    upto = np.concatenate([np.zeros((len(own), 1), np.int32), same.cumsum(1, dtype=np.int32)], 1)
    row, col = np.nonzero(upto[:, window:] - upto[:, :-window] == window)
    np.add.at(marks, begin[row] + col, 1)
    np.add.at(marks, begin[row] + col + window, -1)


def _cut(text: str, words: list[bytes], gone: np.ndarray) -> tuple[str, str]:
    """The text without the words that go and the white space before them, and the hash of the words that stay."""
    if not gone.any():
        return text, hashlib.sha256(b" ".join(words)).hexdigest()
    stay = b" ".join(compress(words, (~gone).tolist()))
    data = text.encode()
    held = np.frombuffer(data, np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = (held == 0x20) | ((held >= 0x09) & (held <= 0x0D))
    ends = np.flatnonzero(space[1:] & ~space[:-1])  # of each word
    turns = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()  # words where a run that goes begins or has ended
    out, at = [], 0
    for low, high in zip(turns[::2], turns[1::2]):
        out.append(data[at : ends[low - 1] if low else 0])
        at = ends[high - 1]
    out.append(data[at:])
    return b"".join(out).lstrip().decode(), hashlib.sha256(stay).hexdigest()


def remove_repeats(docs: DataFrame, window: int = 13, phrase: int = 7, names: tuple[str, str, str] = ("n_words", "n_removed", "kept_sha256")) -> DataFrame:
    """All columns of docs (doc_id, text and any others) and n_words, n_removed, kept_sha256, one row for each row.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the texts as they came. text is what stays, with the white space between kept neighbours as it was;
    a text that loses nothing is unchanged. kept_sha256 is that of the kept words joined by single spaces. A null or
    empty text has no words and comes back as it was, with the hash of nothing. Rows of one doc_id never remove each
    other's words. A row with a null doc_id is unchanged and removes nothing. A column of docs that has one of the new
    columns' `names` is replaced; other names keep it. No rows give no rows.
    """
    spark = prepare(docs.sparkSession)
    taken = {"doc_id", "text", *(n.lower() for n in names)}
    others = [c for c in docs.columns if c.lower() not in taken]
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_BYTES))
    rest = [F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others))).alias("rest")] if others else []
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest]
    # rows of one doc_id, if their texts differ, lie in several buckets
    bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(count)).cast("int").alias("bucket")
    base = docs.where("doc_id is not null").select(bucket, *columns).repartition(count, "bucket")

    def first(table: pa.Table) -> pa.Table:
        found = Windows(table.column("text"), table.column("doc_id"), window)
        anchors = found.anchors(phrase)
        new = np.ones(len(anchors), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (found.of[1:] != found.of[:-1])
        entries, least, most = _spans([anchors[new]], found.of[new])
        return _entries(table.column("bucket")[0].as_py(), count, entries, least, most)

    def second(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return _entries(0, count, [np.zeros(0, np.uint64)], np.zeros(0, np.int64), np.zeros(0, np.int64))
        found = Windows(table.column("text"), table.column("doc_id"), window)
        chosen = _found(found.anchors(phrase), np.sort(_joined(replies, "name", np.uint64))) >= 0
        entries, least, most = _spans(list(found.names(chosen)), found.of[chosen])
        return _entries(table.column("bucket")[0].as_py(), count, entries, least, most)

    def third(table: pa.Table, replies: pa.Table) -> pa.Table:
        wanted = pa.array(np.unique(_joined(replies, "least", np.int64)) if replies.num_rows else np.zeros(0, np.int64))
        table = table.filter(pc.is_in(table.column("doc_id"), wanted))
        found = Windows(table.column("text"), table.column("doc_id"), window, keep=True)
        return _passages(found, replies) if replies.num_rows else pa.table([pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary())], ["bucket", "least", "words"])

    def split(table: pa.Table) -> Iterator[list[bytes]]:
        return ((text.as_py() or "").encode().split() for text in table.column("text"))

    def finished(table: pa.Table, gone: Iterable[np.ndarray | None]) -> dict[str, pa.Array]:
        kept, digest, sizes = [], [], []
        for text, own, g in zip(table.column("text"), split(table), gone):
            value, g = text.as_py(), np.zeros(len(own), bool) if g is None else g
            cut, h = _cut(value or "", own, g)
            kept.append(None if value is None else cut)
            digest.append(h)
            sizes.append((len(own), int(g.sum())))
        out = {"doc_id": table.column("doc_id"), "text": pa.array(kept, pa.string())}
        if "rest" in table.column_names:
            out["rest"] = table.column("rest")
        return out | {"words": pa.array([n for n, _ in sizes], pa.int64()), "removed": pa.array([n for _, n in sizes], pa.int64()), "digest": pa.array(digest, pa.string())}

    def fourth(table: pa.Table, passages: pa.Table) -> pa.Table:
        sent = (
            (said.split(b" "), doc)
            for text, least in zip(passages.column("words"), passages.column("least"))
            for said, doc in zip(text.as_py().split(b"\n"), _unplanes(least.as_py()).tolist())
        )
        return pa.table(finished(table, covered(split(table), table.column("doc_id").to_numpy(), sent, window, phrase)))

    def unnamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pa.table(finished(pa.Table.from_batches([batch]), repeat(None))).to_batches()

    def met(entries: DataFrame, step) -> DataFrame:
        return entries.repartition(count, "shard").mapInArrow(released(step), _REPLIES).groupBy("bucket")

    shared = met(base.groupBy("bucket").applyInArrow(lambda table: eased(first, table), _ENTRIES), _recurring)
    windows = met(base.groupBy("bucket").cogroup(shared).applyInArrow(lambda table, replies: eased(second, table, replies), _ENTRIES), _confirmed)
    sent = base.groupBy("bucket").cogroup(windows).applyInArrow(lambda table, replies: eased(third, table, replies), _PASSAGES)
    schema = T.StructType([f for f in base.schema.fields if f.name != "bucket"])
    schema = schema.add("words", "long").add("removed", "long").add("digest", "string")
    out = base.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(lambda table, passages: eased(fourth, table, passages), schema)
    out = out.union(arrow(docs.where("doc_id is null").select(*columns), unnamed, schema))
    back = {c: F.col(f"rest.c{k}").alias(c) for k, c in enumerate(others)}
    made = [F.col(c).alias(n) for c, n in zip(("words", "removed", "digest"), names)]
    return out.select(*(back.get(c, F.col(c).alias(c)) for c in docs.columns if c in back or c.lower() in ("doc_id", "text")), *made)
