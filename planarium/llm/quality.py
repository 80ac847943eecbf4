"""Quality by ordinal cumulative-link regression on graded ratings.

A document has one latent score, the sum of weights shared by all grades over its hashed features; ordered thresholds
cut the score into grades: P(grade <= k) = sigmoid(threshold_k - score). Features are the distinct words of the whole
text, lower-cased, and the text's shape (shares of capitals, marks, digits, distinct words and so on, in bins). Grades
are 0 for toxic texts, 1 for poor ones and 2 for good ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, prepare, released

#: Hashed features as a power of two; words whose features a worker remembers.
BITS, REMEMBERED = 20, 300_000
#: Rated rows that training takes at most: those with the least hashes of their ids.
SAMPLE = 20_000
#: Probability of the best grade from which a document is kept.
LEAST = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")
_SHAPES = 16  # bins to a measure of shape


class Features(dict):
    """The features of each word: its own, and those of its beginnings."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        names = {word, *(word[:n] + "-" for n in (4, 5) if len(word) > n)}
        found = tuple(xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) >> (32 - BITS) for x in names)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """Distinct features of a text: its words' and its shape's, the latter past all words'."""
        words = _LETTERS.findall(text.lower())
        distinct = set(words)
        found = set().union(*map(self.__getitem__, distinct))
        own = np.sort(np.fromiter(found, np.int64, len(found)))
        size, tokens = max(1, len(text)), text.split()
        lines = [x for x in text.split("\n") if x.strip()]
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        latin = raw[raw < 128].astype(np.uint8)
        kinds = np.bincount(latin, minlength=128)
        letters = sum(map(len, words))
        measures = (
            letters / size,
            kinds[65:91].sum() / max(1, letters),
            kinds[48:58].sum() / size,
            (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / size,
            len(distinct) / max(1, len(words)) ** 0.9,
            len(set(lines)) / max(1, len(lines)),
            letters / max(1, len(words)) / 16,
            len(words) / max(1, 2 * len(tokens)),
            np.log2(1 + len(words)) / 20,
            kinds[[33, 35, 36, 37, 38, 42, 124]].sum() / max(1, len(tokens)),
        )
        shape = [(1 << BITS) + k * _SHAPES + int(min(_SHAPES - 1, max(0, m * _SHAPES))) for k, m in enumerate(measures)]
        return np.r_[own, shape]


SIZE = (1 << BITS) + 10 * _SHAPES


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, by feature
    thresholds: np.ndarray  # ascending

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, epochs: int = 12, blocks: int = 2000, rate: float = 0.15, seen: int = 3, shrink: float = 2e-4) -> Model:
    """Minimise the ordinal negative log-likelihood by adaptive gradient steps over shuffled blocks of rows.

    A word can only count against a text: its weight is at most 0 and shrinks towards it, so that good texts of any
    length score alike and a word that marks bad texts outweighs any number of others. The shape's weights are free.
    Features of fewer than `seen` rows have no weight. There are `epochs` passes, and more until `blocks` steps are done.
    """
    times = np.zeros(SIZE, np.int32)
    for row in rows:  # a row's features are distinct
        times[row] += 1
    often = times >= seen
    weights, sums = np.zeros(SIZE), np.full(SIZE, 1e-2)
    counts = np.bincount(grades, minlength=levels)
    below = np.cumsum(counts)[:-1] / counts.sum()
    theta = np.maximum.accumulate(np.log((below + 0.02) / (1.02 - below)) + np.arange(levels - 1) * 0.5)
    theta_sums = np.full(levels - 1, 1e-2)
    rng = np.random.default_rng(0)
    for _ in range(max(epochs, -(-blocks * 64 // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            cols = np.concatenate([rows[k] for k in own])
            row = np.repeat(np.arange(len(own)), [len(rows[k]) for k in own])
            keep = often[cols]
            cols, row = cols[keep], row[keep]
            score = np.bincount(row, weights[cols], len(own))
            g = grades[own]
            edges = np.r_[-60.0, theta, 60.0]
            high, low = _sigmoid(edges[g + 1] - score), _sigmoid(edges[g] - score)
            p = np.maximum(high - low, 1e-9)
            dh, dl = high * (1 - high), low * (1 - low)
            # of -log(high - low): by the score, and by the thresholds above and below the grade
            by_score = (dh - dl) / p
            touched, index = np.unique(cols, return_inverse=True)
            step = np.bincount(index, by_score[row], len(touched)) / len(own)
            sums[touched] += step**2
            pace = rate / np.sqrt(sums[touched])
            moved = weights[touched] - pace * step
            weights[touched] = np.where(touched < 1 << BITS, np.minimum(0, moved + pace * shrink), moved)
            by_theta = np.zeros(levels + 1)
            np.add.at(by_theta, g + 1, -dh / p)
            np.add.at(by_theta, g, dl / p)
            step = by_theta[1:-1] / len(own)
            theta_sums += step**2
            theta = np.sort(theta - rate * step / np.sqrt(theta_sums))
    return Model(np.where(often, weights, 0).astype(np.float32), theta)


def _slices(column: pa.Array) -> Iterator[memoryview]:
    """The values of a binary column without copies."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1]
    whole = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        yield whole[a:b]


def grade(quality, toxic):
    """The graded rating of a label: 0 toxic, 1 poor, 2 good; null where either column is null."""
    return F.when(toxic != 0, 0).when((quality == 0) & toxic.isNotNull(), 1).when(quality.isNotNull() & toxic.isNotNull(), 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on labelled documents: docs (doc_id, text), labels (doc_id, quality, toxic); None where none is labelled.

    The documented bound: at most `sample` of them, those with the least hashes of their ids. Labels with a null
    quality or toxic, and null texts, teach nothing; a document that is labelled twice takes part twice.
    """
    prepare(docs.sparkSession)
    rated = labels.select(F.col("doc_id").cast("long"), grade(F.col("quality"), F.col("toxic")).alias("grade")).where("grade is not null and doc_id is not null")
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(rated), "doc_id")  # at most `sample` rows

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.of(batch.column(1)[k].as_py()).astype(np.int32) for k in range(len(batch))]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "grade", "features"])

    table = arrow(rows.select("doc_id", "text", "grade"), step, "doc_id long, grade int, features binary").toArrow()
    if not table.num_rows:
        return None
    order = np.lexsort((table.column("grade").to_numpy(), table.column("doc_id").to_numpy()))
    # the rows stay views of the table: about 2 kB each
    views = [np.frombuffer(x, np.int32) for c in table.column("features").chunks for x in _slices(c)]
    return fit([views[k] for k in order], table.column("grade").to_numpy()[order].astype(np.int64), 3)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, expected_grade, p_good, p_clean) for every row of docs with columns doc_id and text.

    p_clean and p_good are the tail probabilities of grades 1 or more and 2 or more; expected_grade is their sum. A null
    text counts as an empty one. Without a model (no labels) everything has grade 2. Rows that repeat come back as often
    as they came; a null doc_id stays null; other columns are not read; no rows give no rows.
    """
    spark = prepare(docs.sparkSession)
    known = spark.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = known.value, Features()
        for batch in batches:
            if model is None:
                tails = np.ones((len(batch), 2))
            else:
                texts = batch.column(1)
                tails = model.tails(np.array([float(model.weights[features.of(texts[k].as_py() or "")].sum()) for k in range(len(batch))], np.float64))
            yield pa.record_batch([batch.column(0), *(pa.array(np.round(x, 6)) for x in (tails.sum(1), tails[:, 1], tails[:, 0]))], ["doc_id", "expected_grade", "p_good", "p_clean"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), step, "doc_id long, expected_grade double, p_good double, p_clean double")


def select(docs: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, whose probability of the best grade is at least `least`.

    Null texts are judged as empty ones; rows that repeat go or stay together; without a model (no labels) all stay; no
    rows give no rows. docs has a column text; others only pass through.
    """
    spark = prepare(docs.sparkSession)
    known = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = known.value, Features()
        for batch in batches:
            if model is None:
                yield batch
                continue
            texts = batch.column(at)
            total = np.array([float(model.weights[features.of(texts[k].as_py() or "")].sum()) for k in range(len(batch))], np.float64)
            yield batch.filter(pa.array(model.tails(total)[:, 1] >= least))

    return docs.mapInArrow(released(step), docs.schema)
