"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

Each run of text has an agenda of adjacent pairs that may merge, the lowest rank first and the leftmost among equals. A
pair whose turn it is is skipped if a hash of (seed, document, the run's place in it, left end, length) falls under the
rate, so every occurrence of a word is cut afresh, one seed always gives the same tokens, and another seed others. What a
worker remembers of a run does not depend on the hash: its characters' ids, the merges of its agenda without dropout, and
the tokens that they give. An occurrence that skips none of these merges has those tokens. The agendas of all others
advance side by side in numpy, one turn of each at a time. The space mark itself, if a text holds it, is spelled in
bytes: decoding gives back every text exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, prepare
from .pieces import MARK, Pieces, load, marked, runs

#: Runs that a worker remembers; the longest run whose agenda advances beside others; how many do at once; runs to a block.
REMEMBERED, LONGEST, ABREAST, BLOCK = 100_000, 32, 8192, 1 << 17
_NEVER = np.int32(2**31 - 1)
#: Stands in for a mark that the text itself holds; no text can hold it.
_OWN = "\ud800"


def cut(run: str, ranks: dict[str, int], rate: float, key: int) -> list[str]:
    """The run's pieces after merging with dropout; characters that are no piece stay single."""
    part = list(run)
    n = len(part)
    rank = ranks.get
    heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := rank(part[i] + part[i + 1])) is not None]
    if not heap:
        return part
    heapify(heap)
    under = int(rate * (1 << 32))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while heap:
        _, a, b, size = heappop(heap)
        x, y = part[a], part[b]
        if not x or not y or len(x) + len(y) != size:
            continue
        if under:
            h = (key ^ (a << 7) ^ size) * 0x9E3779B1 & 0xFFFFFFFF
            if ((h ^ h >> 15) * 0x85EBCA77 & 0xFFFFFFFF) < under:
                continue
        x += y
        part[a], part[b] = x, ""
        after[a] = c = after[b]
        if c < n:
            before[c] = a
            if (r := rank(x + part[c])) is not None:
                heappush(heap, (r, a, c, len(x) + len(part[c])))
        if (p := before[a]) >= 0 and (r := rank(part[p] + x)) is not None:
            heappush(heap, (r, p, a, len(part[p]) + len(x)))
    return [x for x in part if x]


class Pairs:
    """Which piece two pieces side by side merge to, and its rank: a hash table probed for many pairs at once."""

    def __init__(self, pieces: Pieces):
        self.wide = pieces.size
        rank = np.full(pieces.size, _NEVER, np.int32)
        left, right, merged = [], [], []
        for piece, k in pieces.ids.items():
            rank[k] = pieces.ranks[piece]
            for cut_ in range(1, len(piece)):
                a, b = pieces.ids.get(piece[:cut_]), pieces.ids.get(piece[cut_:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(k)
        self.rank = np.append(rank, _NEVER)
        keys = np.array(left, np.int64) * self.wide + np.array(right, np.int64)
        self.mask = (1 << (len(keys) * 8).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.merged = np.full(self.mask + 1, self.wide, np.int32)  # the last rank: never
        at, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            free = self.keys[at[todo]] < 0
            slot, one = np.unique(at[todo[free]], return_index=True)
            put = todo[free][one]
            self.keys[slot], self.merged[slot] = keys[put], np.array(merged, np.int32)[put]
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(36)).astype(np.int64) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged piece's id, or the number of pieces where there is none."""
        key = left.astype(np.int64) * self.wide + right
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.merged[at], np.int32(self.wide))
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            hit = self.keys[at[open_]] == key[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (self.keys[at[open_]] >= 0)]
        return out


def _skips(keys: np.ndarray, merges: np.ndarray, rate: float) -> np.ndarray:
    """Which merges, by left end << 7 ^ length, the runs with these keys skip."""
    h = (keys ^ merges) * np.uint32(0x9E3779B1)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) < np.uint32(int(rate * (1 << 32)) if rate < 1 else (1 << 32) - 1)


def advance(symbols: np.ndarray, keys: np.ndarray, pairs: Pairs, rate: float, told: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, how many of them each row has) for rows of equally many symbols; the same merges as cut().

    told, if given, gets (rows, merges) of each turn.
    """
    rows, n = symbols.shape
    sym = np.concatenate([symbols, np.full((rows, 2), pairs.wide, np.int32)], 1).astype(np.int32)
    after = np.tile(np.minimum(np.arange(1, n + 3), n + 1).astype(np.int16), (rows, 1))
    before = np.tile(np.arange(-1, n + 1, dtype=np.int16), (rows, 1))
    into = np.full((rows, n + 2), pairs.wide, np.int32)
    into[:, : n - 1] = pairs.find(sym[:, : n - 1].ravel(), sym[:, 1:n].ravel()).reshape(rows, n - 1)
    rank = pairs.rank[into]
    alive = np.zeros((rows, n + 2), bool)
    alive[:, :n] = True
    live = np.arange(rows)
    while len(live):
        a = rank[live].argmin(1)
        go = rank[live, a] < _NEVER
        live, a = live[go], a[go]
        b = after[live, a]
        c = after[live, b].astype(np.int64)
        merges = (a.astype(np.uint32) << np.uint32(7)) ^ (c - a).astype(np.uint32)
        if told is not None:
            told.append((live, merges))
        skip = _skips(keys[live], merges, rate)
        rank[live[skip], a[skip]] = _NEVER
        r, a, b, c = live[~skip], a[~skip], b[~skip], c[~skip]
        sym[r, a] = into[r, a]
        alive[r, b] = False
        rank[r, b] = _NEVER
        after[r, a] = c
        before[r, c] = a
        p = before[r, a]
        for at, left, right, good in ((a, a, c, c < n), (p, p, a, p >= 0)):
            own, at, left, right = r[good], at[good], left[good], right[good]
            merged = pairs.find(sym[own, left], sym[own, right])
            into[own, at] = merged
            rank[own, at] = pairs.rank[merged]
        if len(end := np.flatnonzero(c >= n)):
            rank[r[end], a[end]] = _NEVER
    alive = alive[:, :n]
    return sym[:, :n][alive], alive.sum(1)


class Runs(dict):
    """The number of each run; a new one gets the next and waits to be spelled."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, run: str) -> int:
        self[run] = k = len(self)
        self.waiting.append(run)
        return k


class _Lists:
    """Many short lists of numbers, one after another in one array."""

    def __init__(self, kind: type, n: int = 0):
        self.flat, self.start, self.size = np.zeros(0, kind), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def grow(self, n: int) -> None:
        self.start, self.size = (np.r_[x, np.zeros(n - len(x), np.int64)] for x in (self.start, self.size))

    def put(self, at: np.ndarray, size: np.ndarray, values: np.ndarray) -> None:
        self.size[at] = size
        self.start[at] = np.cumsum(size) - size + len(self.flat)
        self.flat = np.concatenate([self.flat, values.astype(self.flat.dtype, copy=False)])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of these lists one after another, how many each has)."""
        size = self.size[at]
        upto = np.cumsum(size)
        places = np.arange(int(upto[-1]) if len(at) else 0) + np.repeat(self.start[at] - (upto - size), size)
        return self.flat[places], size


class Encoder:
    """Encodes batches of texts and remembers runs."""

    def __init__(self, pieces: Pieces, rate: float, seed: int):
        self.pieces, self.rate, self.seed, self.pairs = pieces, rate, seed, Pairs(pieces)
        self._forget()

    def _forget(self) -> None:
        self.known, self.names = Runs(), []
        self.symbols, self.strange, self.merges, self.tokens = _Lists(np.int32), _Lists(np.uint32), _Lists(np.uint32), _Lists(np.int32)
        self.alone, self.seen, self.traced = (np.zeros(0, bool) for _ in range(3))

    def _alone(self, run: str, key: int) -> list[int]:
        out = []
        for x in cut(run, self.pieces.ranks, self.rate, key):
            if (k := self.pieces.ids.get(x)) is not None:
                out.append(k)
            else:
                out += [self.pieces.byte_ids[c] for c in (MARK if x == _OWN else x).encode()]
        return out

    def _spell(self) -> None:
        """The characters' ids of the runs that wait, with one past all for a character that is no piece."""
        new, ids = [marked(r) for r in self.known.waiting], self.pieces.ids
        self.known.waiting.clear()
        size, text = np.array([len(r) for r in new], np.int64), "".join(new)
        flat = np.array(list(map(ids.get, text, repeat(self.pairs.wide))), np.int32)
        strange = flat == self.pairs.wide
        at, n = np.arange(len(self.names), len(self.names) + len(new)), len(self.names) + len(new)
        for lists in (self.symbols, self.strange, self.merges, self.tokens):
            lists.grow(n)
        self.symbols.put(at, size, flat)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.strange.put(at, np.add.reduceat(strange, np.cumsum(size) - size, dtype=np.int64), code[strange])
        self.names += new
        self.alone = np.r_[self.alone, size > LONGEST]
        self.seen, self.traced = (np.r_[x, np.zeros(len(new), bool)] for x in (self.seen, self.traced))

    def _advance(self, runs_: np.ndarray, keys: np.ndarray, rate: float, told: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, sizes) of runs with keys, those of one length side by side."""
        length = self.symbols.size[runs_]
        order = np.argsort(length, kind="stable")
        size, parts = np.zeros(len(runs_), np.int64), []
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            for at in range(0, len(group), ABREAST):
                own = group[at : at + ABREAST]
                symbols = self.symbols.take(runs_[own])[0].reshape(len(own), -1)
                turns: list = []
                found, size[own] = advance(symbols, keys[own], self.pairs, rate, turns if told is not None else None)
                parts.append(found)
                if told is not None:
                    told += [(own[r], m) for r, m in turns]
        placed = _Lists(np.int32, len(runs_))
        placed.put(order, size[order], np.concatenate([np.zeros(0, np.int32), *parts]))
        found = placed.take(np.arange(len(runs_)))[0]
        at = np.flatnonzero(found == self.pairs.wide)  # characters that are no piece never merge: spell them in bytes
        if not len(at):
            return found, size
        code, which = np.unique(self.strange.take(runs_)[0], return_inverse=True)
        spelled = [[self.pieces.byte_ids[c] for c in (MARK if chr(x) == _OWN else chr(x)).encode()] for x in code.tolist()]
        many = np.array([len(x) for x in spelled])[which]
        times = np.ones(len(found), np.int64)
        times[at] = many
        row = np.repeat(np.arange(len(runs_)), size)[at]
        out = np.repeat(found, times)
        out[np.repeat(np.isin(np.arange(len(found)), at, assume_unique=True), times)] = [t for w in which.tolist() for t in spelled[w]]
        return out, size + np.bincount(row, many - 1, len(runs_)).astype(np.int64)

    def _trace(self, new: np.ndarray) -> None:
        """Remember the merges without dropout of these runs, and the tokens that they give."""
        told: list = []
        found, size = self._advance(new, np.zeros(len(new), np.uint32), 0, told)
        self.tokens.put(new, size, found)
        row = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in told)])
        order = np.argsort(row, kind="stable")
        self.merges.put(new, np.bincount(row, minlength=len(new)), np.concatenate([np.zeros(0, np.uint32), *(m for _, m in told)])[order])
        self.traced[new] = True

    def block(self, index: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, sizes) of occurrences of known runs, each with its own key."""
        if self.known.waiting:
            self._spell()
        times = np.bincount(index, minlength=len(self.names))
        if len(new := np.flatnonzero(~self.traced & ~self.alone & (times + self.seen >= 2) & (times > 0))):
            self._trace(new)
        self.seen |= times > 0
        plain = np.flatnonzero(self.traced[index])
        merges, many = self.merges.take(index[plain])
        skipped = np.zeros(len(index), bool)
        skipped[np.repeat(plain, many)[_skips(np.repeat(keys[plain], many), merges, self.rate)]] = True
        plain = plain[~skipped[plain]]
        alone = np.flatnonzero(self.alone[index])
        rest = np.flatnonzero(skipped | ~(self.traced | self.alone)[index])
        out = _Lists(np.int32, len(index))
        found, size = self.tokens.take(index[plain])
        out.put(plain, size, found)
        found, size = self._advance(index[rest], keys[rest], self.rate)
        out.put(rest, size, found)
        told = [self._alone(self.names[k], key) for k, key in zip(index[alone].tolist(), keys[alone].tolist())]
        out.put(alone, np.array([len(x) for x in told], np.int64), np.array([t for x in told for t in x], np.int32))
        return out.take(np.arange(len(index)))

    def batch(self, texts: list[str], docs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, where each text's end)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        index: list[int] = []
        many, bases = [], []
        for text, doc in zip(texts, docs):
            before = len(index)
            index += map(self.known.__getitem__, runs(text.replace(MARK, _OWN) if MARK in text else text))
            many.append(len(index) - before)
            bases.append(xxhash.xxh32_intdigest(b"%d/%d" % (self.seed, doc)))
        every, ends = np.array(index, np.int64), np.cumsum(many, dtype=np.int64)
        place = np.arange(len(every)) - np.repeat(ends - many, many)
        keys = _mixed(np.repeat(np.array(bases, np.uint32), many) + place.astype(np.uint32) * np.uint32(0x9E3779B9))
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(every), BLOCK):
            found, size = self.block(every[at : at + BLOCK], keys[at : at + BLOCK])
            parts.append(found)
            sizes.append(size)
        return np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(sizes))][ends]

    def text(self, text: str, doc: int) -> bytes:
        """One text's token ids as little-endian 32-bit integers."""
        return self.batch([text], [doc])[0].tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


class Decoder:
    def __init__(self, pieces: Pieces):
        spelled = pieces.spelled()
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)[:-1]]
        self.pool = np.frombuffer(b"".join(spelled), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        """The text whose tokens these are: the pieces' bytes in order, without the space put before the text."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ids) else 0
        at = np.arange(total) + np.repeat(self.start[ids] - (ends - size), size)
        return self.pool[at[1:]].tobytes().decode("utf-8")


def encode(docs: DataFrame, rate: float = 0.1, seed: int = 17, model: str | None = None) -> DataFrame:
    """(doc_id, token_ids, n_tokens) for every row of docs with columns doc_id and text; see the module for how.

    A null or empty text has no tokens. Rows that repeat get the same tokens each time; a null doc_id stays null and
    is cut as document 0 would be. Texts are whole, however long. Other columns are not read; no rows give no rows.
    """
    spark = prepare(docs.sparkSession)
    pieces = spark.sparkContext.broadcast(load(model))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces.value, rate, seed)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                docs, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
                found, ends = encoder.batch(texts, [x or 0 for x in docs.to_pylist()])
                ends = np.r_[0, ends]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))
                yield pa.record_batch([docs, ids, pa.array(np.diff(ends), pa.int64())], ["doc_id", "token_ids", "n_tokens"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), step, "doc_id long, token_ids array<int>, n_tokens long")


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) for every row of tokens with columns doc_id and token_ids; null or no tokens give an empty text.

    Rows that repeat come back as often as they came; a null doc_id stays null; other columns are not read; no rows give
    no rows. Ids that are no ids of the model, and ids whose bytes are no UTF-8, are an error: encode() gives none.
    """
    spark = prepare(tokens.sparkSession)
    pieces = spark.sparkContext.broadcast(load(model))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces.value)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                ids = batch.column(1)
                texts = [decoder.text(ids[i].values.to_numpy() if ids[i].is_valid else np.zeros(0, np.int32)) for i in range(len(batch))]
                yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow(tokens.select(F.col("doc_id").cast("long"), F.col("token_ids").cast("array<int>")), step, "doc_id long, text string")


def round_trip(docs: DataFrame, rate: float = 0.1, seed: int = 17, model: str | None = None) -> DataFrame:
    """(doc_id, token_ids, n_tokens, text_sha256, lossless): encode(), the SHA-256 of what its tokens decode to, and
    whether that is the text (null: the empty text).

    Both directions run over the same batch, so texts are read once and nothing is shuffled. Rows, nulls and repeats are
    as with encode().
    """
    spark = prepare(docs.sparkSession)
    pieces = spark.sparkContext.broadcast(load(model))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        encoder, decoder = Encoder(pieces.value, rate, seed), Decoder(pieces.value)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                docs, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
                found, ends = encoder.batch(texts, [x or 0 for x in docs.to_pylist()])
                ends = np.r_[0, ends]
                back = [decoder.text(found[a:b]) for a, b in zip(ends, ends[1:])]
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in back]
                same = [x == y for x, y in zip(back, texts)]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))
                yield pa.record_batch([docs, ids, pa.array(np.diff(ends), pa.int64()), pa.array(digests, pa.string()), pa.array(same)], ["doc_id", "token_ids", "n_tokens", "text_sha256", "lossless"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), step, "doc_id long, token_ids array<int>, n_tokens long, text_sha256 string, lossless boolean")
