"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

A text's words are its runs of letters (numerals are none, whatever their script), lower-cased, each behind the space
mark; a run of over 31 letters counts as several. For every language each piece of the vocabulary has a probability, and a word's likelihood is the sum, over
all ways to cut it into pieces, of the product of their probabilities: a forward algorithm adds them up. Training is
one expectation step under equal piece probabilities: by a forward and a backward pass each piece gets the share of
cuts that hold it. Both run over the distinct words of a batch at once, words of one length side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, prepare
from .pieces import MARK, load

#: Letters to a word, words that a worker remembers, words side by side, share of probability spread over all pieces.
LONGEST, REMEMBERED, ABREAST, SPREAD = 31, 200_000, 8192, 1e-3
#: Languages side by side; numbers in a worker's table of words by language; what a share of a piece is counted in.
TOGETHER, CELLS, GRAIN = 16, 4_000_000, 2**-24
#: What a character that is no piece counts in every language.
UNKNOWN = 1e-7
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    found = _LETTERS.findall((text or "").lower())
    if found and not "".join(found).isalpha():  # \w holds numerals that are no decimal digits
        found = "".join([c if c.isalpha() else " " for c in " ".join(found)]).split()
    if found and max(map(len, found)) > LONGEST:
        found = [w[k : k + LONGEST] for w in found for k in range(0, len(w), LONGEST)]
    return found


class Lattice:
    """Finds the vocabulary's pieces at all places of many words at once."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)  # index of characters that are no piece; one more stands for nothing at all
        codes = [np.array([ord(c) for c in p], np.uint64) for p in pieces]
        self.tables = []
        for n in range(1, max(map(len, codes)) + 1):
            at = np.array([k for k, c in enumerate(codes) if len(c) == n], np.int64)
            hashed = np.zeros(len(at), np.uint64)
            for j in range(n):
                hashed = hashed * _BASE + np.array([codes[k][j] + np.uint64(1) for k in at], np.uint64)
            order = np.argsort(hashed)
            self.tables.append((hashed[order], at[order]))

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, list[np.ndarray]]]:
        """(indexes of words of one length, the length with the mark, for each piece length the pieces from each place)."""
        length = np.array([len(w) for w in words], np.int64)
        order = np.argsort(length, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            for at in range(0, len(own), ABREAST):
                rows = own[at : at + ABREAST]
                n = int(length[rows[0]]) + 1 if len(rows) else 0
                if not n:
                    continue
                text = "".join([MARK + words[k] for k in rows])
                code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n).astype(np.uint64) + np.uint64(1)
                prefix = np.zeros((len(rows), n + 1), np.uint64)
                for j in range(n):
                    prefix[:, j + 1] = prefix[:, j] * _BASE + code[:, j]
                found, power = [], np.uint64(1)
                for m, (hashed, names) in enumerate(self.tables[:n], 1):
                    with np.errstate(over="ignore"):
                        power = power * _BASE
                    part = prefix[:, m:] - prefix[:, : n - m + 1] * power
                    if len(hashed):
                        at_ = np.minimum(np.searchsorted(hashed, part), len(hashed) - 1)
                        piece = np.where(hashed[at_] == part, names[at_], self.size if m == 1 else self.size + 1)
                    else:
                        piece = np.full(part.shape, self.size if m == 1 else self.size + 1)
                    found.append(piece)
                yield rows, n, found

    def likelihoods(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        """For each word and language, the logarithm of the sum over all its cuts. probability: by piece and language."""
        out = np.zeros((len(words), probability.shape[1]))
        for rows, n, found in self.groups(words):
            for low in range(0, probability.shape[1], TOGETHER):
                own = np.ascontiguousarray(probability[:, low : low + TOGETHER])
                forward = np.zeros((n + 1, len(rows), own.shape[1]))
                forward[0] = 1
                for j in range(1, n + 1):
                    for m in range(1, min(j, len(found)) + 1):
                        forward[j] += forward[j - m] * own[found[m - 1][:, j - m]]
                out[rows, low : low + TOGETHER] = np.log(forward[n])
        return out

    def shares(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """By piece and column of times, how often the piece is expected when words occur that often.

        A word's own share is rounded to grains, so sums over words are exact whatever they are dealt by.
        """
        out = np.zeros((self.size + 2, times.shape[1]))
        weight = np.full(self.size + 2, 1 / self.size)
        weight[-1] = 0
        for rows, n, found in self.groups(words):
            forward, backward = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
            forward[0] = backward[n] = 1
            for j in range(1, n + 1):
                for m in range(1, min(j, len(found)) + 1):
                    forward[j] += forward[j - m] * weight[found[m - 1][:, j - m]]
            for i in range(n - 1, -1, -1):
                for m in range(1, min(n - i, len(found)) + 1):
                    backward[i] += backward[i + m] * weight[found[m - 1][:, i]]
            for m, piece in enumerate(found, 1):
                share = np.rint((forward[: n - m + 1] * backward[m:] / forward[n]).T * weight[piece] / GRAIN) * GRAIN
                good = share > 0
                for c in range(times.shape[1]):
                    out[:, c] += np.bincount(piece[good], (share * times[rows, c : c + 1])[good], self.size + 2)
        return out


def vocabulary(model: str | None = None) -> list[str]:
    """Pieces of lower-case letters, with or without the mark, and the mark."""
    return [p for p in load(model).ids if p == MARK or (p.removeprefix(MARK).isalpha() and p == p.lower())]


def learn(docs: DataFrame, model: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability by piece and language, from all rows of docs (text, lang).

    Tasks emit sums by language and piece, in whole grains so that their order makes no difference, and the driver gets
    at most languages x vocabulary of them. Rows without a text or lang, and texts without a letter, teach nothing;
    without rows no language is learnt. Rows that repeat teach as often as they come; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    pieces = spark.sparkContext.broadcast(vocabulary(model))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, sums = Lattice(pieces.value), {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, found in sums.items():
                found = np.rint(found / GRAIN).astype(np.int64)
                at = np.flatnonzero(found)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at])], ["lang", "piece", "n"])
            sums.clear()

        for batch in batches:
            for low in range(0, len(batch), 2000):
                part = batch.slice(low, 2000)
                index: dict[str, int] = {}
                seen: dict[str, list] = {}
                for text, lang in zip(part.column(0), part.column(1)):
                    own = [index.setdefault(w, len(index)) for w in words_of(text.as_py())]
                    seen.setdefault(lang.as_py(), []).append(np.array(own, np.int64))
                times = np.stack([np.bincount(np.concatenate(x), minlength=len(index)) for x in seen.values()], 1)
                for lang, found in zip(seen, lattice.shares(list(index), times).T):
                    sums[lang] = sums.get(lang, 0) + found
                if len(sums) > 64:
                    yield from told()
        yield from told()

    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    table = arrow(rows, step, "lang string, piece int, n long").groupBy("lang", "piece").agg((F.sum("n") * GRAIN).alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    n = len(pieces.value)
    out = np.zeros((n + 2, len(langs)))
    for k, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        out[own["piece"].to_numpy(), k] = own["n"].to_numpy()
    out[n:] = 0
    total = out.sum(0)
    out = (1 - SPREAD) * out / np.where(total > 0, total, 1) + SPREAD / n
    out[n], out[n + 1] = UNKNOWN, 0
    return langs, out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], pieces: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs with columns doc_id and text, from its whole text alone.

    score is the language's share of likelihood among those learnt, all thought equally likely before. A null text and
    a text without a letter are `und` with score 0, as is everything where nothing was learnt. Ties go to the language
    first in order. Other columns are not read; no rows give no rows.
    """
    spark = prepare(docs.sparkSession)
    known = spark.sparkContext.broadcast((vocabulary(pieces), *model))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, langs, probability = known.value
        lattice, index, table = Lattice(names), {}, np.zeros((0, len(langs)))
        for batch in batches:
            out: list[tuple[str, float]] = []
            for low in range(0, len(batch), 2000):
                if len(index) > min(REMEMBERED, CELLS // max(1, len(langs))):
                    index, table = {}, table[:0]
                old, rows = len(index), []
                for text in batch.column(1).slice(low, 2000):
                    rows.append(np.array([index.setdefault(w, len(index)) for w in words_of(text.as_py())] if langs else [], np.int64))
                if len(index) > old:
                    table = np.concatenate([table, lattice.likelihoods(list(index)[old:], probability)])
                for own in rows:
                    if not len(own):
                        out.append(("und", 0.0))
                        continue
                    score = table[own].sum(0)
                    best = int(score.argmax())
                    out.append((langs[best], round(float(1 / np.exp(score - score[best]).sum()), 6)))
            yield pa.record_batch([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), step, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as an empty text, and so is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0
