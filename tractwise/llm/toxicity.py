"""Toxicity: a linear classifier on character n-grams scaled by log-count ratios.

A text becomes its set of character n-grams, hashed into ``2**BITS`` features. Over
labelled texts, the log of the ratio between a feature's share of toxic and of clean
texts (each plus one) tells how much its presence speaks for either side. A feature
counts only if this ratio is large enough to matter and lies some standard errors from zero. The ratios are the values
of the features, each text's vector has length 1, and logistic regression learns a weight
for each feature by accelerated gradient descent.

The fit reads a bounded sample of labelled texts (``Fit``): per class the rows that come
first by a hash of their id. The classes need not be sampled at the same rate, so the
intercept is corrected by the rates. Counting and hashing are spread over tasks; one task
gets the few significant features of each sampled text and learns the weights. Scoring is
one pass over all texts without a shuffle.

Text is lower-cased and each run of other characters than letters is one blank. Whole
texts are read, in slices of bounded size.

Nulls: a null text is an empty one; texts without n-grams of weight get the score of the
intercept. Labels that are null or contradict each other for one doc_id are left out, as
are null ids. Of several texts with one labelled id one is learned from. Without labels
every score is 0.5; with one class only, it is that of the smoothed share of the class.
Rows are scored one by one: repeated rows and ids get equal scores, an empty table an empty
result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractwise.llm.common import bounded_batches, map_arrow, remainder, stored

#: Lengths of n-grams, hash size, and code points hashed at a time.
SHORTEST, LONGEST, BITS, SLICE = 3, 6, 20, 1 << 20
#: Odd constant that mixes hashes.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Code points below this are told from letters by table.
PLAIN = 0x3000
IS_LETTER = np.array([chr(point).isalpha() for point in range(PLAIN)])
BLANK = 32


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample (labelled rows, characters in all and in one text), tasks that
    count, least log ratio and standard errors of a feature, L2 penalty, steps of descent."""

    rows: int = 16_384
    chars: int = 64_000_000
    text_chars: int = 1_000_000
    tasks: int = 16
    ratio: float = 1.0
    z: float = 3.5
    penalty: float = 0.1
    steps: int = 200
    rate: float = 4.0


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text between blanks, each run of non-letters a blank."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    letter = IS_LETTER[np.minimum(points, PLAIN - 1)]
    rare = points >= PLAIN
    if rare.any():
        values, places = np.unique(points[rare], return_inverse=True)
        letter[rare] = np.array([chr(value).isalpha() for value in values])[places]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return np.where(letter, points, np.uint32(BLANK))[keep]


def _grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """Features of all n-grams of some code points, length by length."""
    values = points.astype(np.uint64)
    hashes = values
    for size in range(2, LONGEST + 1):
        if len(values) < size:
            return
        hashes = hashes[:-1] * MIX + values[size - 1 :]
        if size >= SHORTEST:
            mixed = (hashes ^ (hashes >> np.uint64(29))) * MIX
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str | None, known: np.ndarray | None = None) -> np.ndarray:
    """Distinct features of a text, ascending; only those marked in ``known`` if given."""
    points = letters(text or "")
    found = []
    for at in range(0, len(points), SLICE):
        # slices overlap by the longest n-gram less one
        for grams in _grams(points[at : at + SLICE + LONGEST - 1]):
            found.append(grams if known is None else grams[known[grams]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Model:
    """Significant features (ascending), their ratios and weights, and the intercept."""

    index: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    intercept: float

    def known(self) -> np.ndarray:
        marks = np.zeros(1 << BITS, bool)
        marks[self.index] = True
        return marks

    def score(self, text: str | None, known: np.ndarray) -> float:
        at = np.searchsorted(self.index, features(text, known))
        values = self.ratios[at]
        size = float(np.sqrt(values @ values))
        margin = float(values @ self.weights[at]) / size if size else 0.0
        return float(1 / (1 + np.exp(-np.clip(margin + self.intercept, -35, 35))))


def log_ratios(
    toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, least: float, z: float
) -> tuple[np.ndarray, np.ndarray]:
    """Features with a large and significant log-count ratio, and these ratios."""
    p, q = toxic + 1.0, clean + 1.0
    ratios = np.log(p / (n_toxic + 2)) - np.log(q / (n_clean + 2))
    error = np.sqrt(1 / p - 1 / (n_toxic + 2) + 1 / q - 1 / (n_clean + 2))
    index = np.flatnonzero((np.abs(ratios) >= least) & (np.abs(ratios) > z * error))
    return index, ratios[index]


#: Texts whose vectors are multiplied at a time.
BLOCK = 512


def descended(
    rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, fit: Fit
) -> tuple[np.ndarray, float]:
    """Weights and intercept of penalised logistic regression; rows hold places in ``ratios``.

    Products go block by block, so that only the places themselves are held for all rows.
    """
    n, size = len(rows), len(ratios)
    blocks = []
    for first in range(0, n, BLOCK):
        some = rows[first : first + BLOCK]
        places = np.concatenate(some)
        owner = np.repeat(np.arange(len(some), dtype=np.int16), [len(row) for row in some])
        lengths = np.sqrt(np.bincount(owner, ratios[places] ** 2, len(some)))
        values = (ratios[places] / np.maximum(lengths, 1e-12)[owner]).astype(np.float32)
        blocks.append((places, owner, values, labels[first : first + BLOCK]))
    ahead = np.zeros(size + 1)
    weights, speed = ahead.copy(), 1.0
    for _ in range(fit.steps):
        slope = np.append(2 * fit.penalty / n * ahead[:-1], 0.0)
        for places, owner, values, label in blocks:
            margin = np.bincount(owner, values * ahead[places], len(label)) + ahead[-1]
            error = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - label) / n
            slope[:-1] += np.bincount(places, values * error[owner], size)
            slope[-1] += error.sum()
        step = ahead - fit.rate * slope
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = step + (speed - 1) / faster * (step - weights)
        weights, speed = step, faster
    return weights[:-1], float(weights[-1])


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of ids whose labels agree."""
    return (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .filter("toxic = most")
        .select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    )


def training_sample(docs: DataFrame, known: DataFrame, fit: Fit) -> DataFrame:
    """text and toxic of at most ``fit.rows`` labelled documents, half of them of each class
    where there are enough, and at most ``fit.chars`` characters of each class."""
    placed = known.withColumn("place", F.xxhash64("doc_id"))
    chosen = None
    for toxic in (True, False):
        some = placed.filter(F.col("toxic") == toxic).orderBy("place", "doc_id")
        some = some.limit(fit.rows // 2)
        chosen = some if chosen is None else chosen.unionByName(some)
    # ids are bounded by fit.rows, so they are broadcast and no other text moves
    read = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).join(
        F.broadcast(chosen), "doc_id"
    )
    one = read.groupBy("doc_id", "place", "toxic").agg(
        F.min(F.struct("tie", F.length("text").alias("size"))).alias("least")
    )
    rows = one.select("doc_id", "place", "toxic", "least.*").filter(
        F.coalesce("size", F.lit(0)) <= fit.text_chars
    )
    # at most fit.rows rows with their lengths, no text
    rows = pd.DataFrame(
        [tuple(row) for row in rows.collect()], columns=["doc_id", "place", "toxic", "tie", "size"]
    ).sort_values(["toxic", "place", "doc_id"], kind="stable")
    total = rows.groupby("toxic")["size"].transform(lambda sizes: sizes.fillna(0).cumsum())
    taken = rows[total <= fit.chars][["doc_id", "tie", "toxic"]]
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.sparkSession.createDataFrame(
        list(taken.itertuples(index=False, name=None)), f"doc_id {kind}, tie long, toxic boolean"
    )
    return (
        docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .join(F.broadcast(ids), ["doc_id", "tie"])
        .groupBy("doc_id", "tie", "toxic")
        .agg(F.first("text").alias("text"))
    )


#: Features in a slice of the count vectors.
COUNT_SLICE = 1 << 15


def counted(sample: DataFrame, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of toxic and of clean texts with each feature.

    A task counts into two vectors and hands them on slice by slice, so that what is
    shuffled follows the number of tasks, and what a task adds up is one slice of each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                totals[int(toxic), features(text)] += 1
        for at in range(0, 1 << BITS, COUNT_SLICE):
            part = totals[:, at : at + COUNT_SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                    ["at", "counts"],
                )

    def add(slices: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(counts, np.int32) for counts in slices["counts"])
        return pd.DataFrame({"at": slices["at"].iloc[:1], "counts": [total.tobytes()]})

    kind = "at int, counts binary"
    parts = sample.repartition(fit.tasks).select("toxic", "text").mapInArrow(count, kind)
    totals = np.zeros((2, 1 << BITS), np.int32)
    for row in parts.groupBy("at").applyInPandas(add, kind).toLocalIterator():
        part = np.frombuffer(row.counts, np.int32).reshape(2, -1)
        totals[:, row.at : row.at + COUNT_SLICE] = part
    return totals[1], totals[0]


def fitted(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Learn from labelled documents; what reaches the driver is bounded by ``fit`` and the
    number of features."""
    bounded_batches(docs.sparkSession)
    # cached, not written: a few bytes a row, read three times here and not again
    known = labelled(labels).persist()
    try:
        # bounded by fit, so it needs no more files than the tasks that read it
        sample = stored(training_sample(docs, known, fit).coalesce(fit.tasks), "toxic-sample")
        whole = {row.toxic: row["count"] for row in known.groupBy("toxic").count().collect()}
    finally:
        known.unpersist()
    taken = {row.toxic: row["count"] for row in sample.groupBy("toxic").count().collect()}
    all_toxic, all_clean = whole.get(True, 0), whole.get(False, 0)
    n_toxic, n_clean = taken.get(True, 0), taken.get(False, 0)
    nothing = np.zeros(0)
    if not (n_toxic and n_clean):
        prior = float(np.log((all_toxic + 1) / (all_clean + 1)))
        return Model(np.zeros(0, np.int64), nothing, nothing, prior)
    toxic, clean = counted(sample, fit)
    index, ratios = log_ratios(toxic, clean, n_toxic, n_clean, fit.ratio, fit.z)
    shared = docs.sparkSession.sparkContext.broadcast((index, ratios))

    def make():
        index, ratios = shared.value
        marks = np.zeros(1 << BITS, bool)
        marks[index] = True

        def apply(columns):
            found = [
                np.searchsorted(index, features(text, marks)).astype("<i4").tobytes()
                for text in columns[1]
            ]
            return [columns[0], columns[2], found]

        return apply

    spread = sample.repartition(fit.tasks)
    vectors = map_arrow(
        spread.select("toxic", "text", "tie"), "toxic boolean, tie long, found binary", make
    )

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tie", "toxic"], kind="stable")
        index, ratios = shared.value
        found = [np.frombuffer(row, "<i4") for row in rows["found"]]
        weights, intercept = descended(found, rows["toxic"].to_numpy(float), ratios, fit)
        return pd.DataFrame({"weights": [weights.tobytes()], "intercept": [intercept]})

    # one group: at most fit.rows rows of significant features
    learned = vectors.withColumn("shard", F.lit(0)).groupBy("shard")
    learned = learned.applyInPandas(learn, "weights binary, intercept double")
    row = learned.first()
    shift = float(np.log((all_toxic / n_toxic) / (all_clean / n_clean)))
    return Model(index, ratios, np.frombuffer(row.weights), row.intercept + shift)


@functools.lru_cache(maxsize=1)
def _marks(data: bytes) -> np.ndarray:
    marks = np.zeros(1 << BITS, bool)
    marks[np.frombuffer(data, np.int64)] = True
    return marks


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        known = _marks(model.index.astype(np.int64).tobytes())

        def apply(columns):
            scores = [model.score(text, known) for text in columns[1]]
            return [columns[0], scores, [int(score >= threshold) for score in scores]]

        return apply

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"), f"doc_id {kind}, score double, predicted int", make
    )


def fitted_and_scored(
    docs: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2, fit: Fit = Fit()
) -> DataFrame:
    """Learn from labels outside the held-out fold and score all rows."""
    model = fitted(docs, labels.filter(remainder(F.col("doc_id"), divisor) != held_out), fit)
    fold = remainder(F.col("doc_id"), divisor) == held_out
    return scored(docs, model).withColumn("held_out", fold)
