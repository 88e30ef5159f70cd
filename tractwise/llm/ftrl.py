"""Quality classifier: logistic regression on hashed word n-grams, learned by FTRL.

Features are single words and pairs of neighbours, hashed into a fixed number of weights.
A text is cut into words and runs of signs; a word that repeats the one before and a
word in capitals also count as such, as both are words a vocabulary of one language
cannot list. Counts are divided by the length of the vector.

Follow-the-regularised-leader (proximal) keeps, for each weight, a sum of adjusted
gradients and a sum of squared gradients; the weight follows from the two, and L1 keeps
weights without evidence at exactly zero. If the sample is cut into shards, these learn
side by side and their weights are averaged; one shard is the default, as the sample is
bounded and small shards learn less.

Nulls: a null text is an empty one and gets the score of the intercept. Labels that are
null, or that contradict each other on one document, are left out. Without labels the
score is 0.5 throughout. Rows are scored one by one; other columns are not read. Of rows
that repeat a labelled id one is learned from, the one whose text has the least hash; all are
scored. Very long texts are scored whole, and learned from whole or not at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tractwise.llm.common import map_arrow, remainder

BITS = 18
#: Labelled rows that are learned from at most, and shards that learn side by side.
SAMPLE_ROWS, SHARDS = 12_288, 1
#: Characters that are learned from at most: in all, and in one text.
SAMPLE_CHARS, TEXT_CHARS = 1 << 26, 1 << 20
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.05, 0.5, 4
MEMO_WORDS = 1 << 18

TOKENS = re.compile(r"\w+|[^\w\s]+")
#: Odd constants that mix the hashes of two neighbours.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
REPEATED, CAPITALS = "\0repeated", "\0capitals"


class Hasher:
    """Sparse feature vectors of texts."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.memo: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        return xxhash.xxh64_intdigest(word.lower())

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices, ascending, and values; the values' squares sum to 1."""
        words = TOKENS.findall(text or "")
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        memo = self.memo
        for word in set(words).difference(memo):
            memo[word] = self._hash(word)
        hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if len(memo) > MEMO_WORDS:
            memo.clear()
        same = hashes[1:] == hashes[:-1]
        capitals = sum(map(str.isupper, words))
        marks = np.repeat(
            np.array([self._hash(REPEATED), self._hash(CAPITALS)], np.uint64),
            [int(same.sum()), capitals],
        )
        pairs = hashes[:-1] * MIX_A ^ hashes[1:] * MIX_B
        each = np.concatenate([hashes, marks, pairs]) * MIX_A >> self.shift
        index, counts = np.unique(each.astype(np.int64), return_counts=True)
        values = np.log1p(counts)
        return index, values / np.sqrt((values**2).sum())


class Ftrl:
    """Per-coordinate FTRL-proximal for the logistic loss; the last weight is the intercept."""

    def __init__(self, size: int):
        self.sums, self.squares = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        sums, squares = self.sums[at], self.squares[at]
        shrunk = np.sign(sums) * np.maximum(np.abs(sums) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(squares)) / ALPHA + L2)

    def learn(self, index: np.ndarray, values: np.ndarray, label: int) -> None:
        at = np.append(index, len(self.sums) - 1)
        x = np.append(values, 1.0)
        weights = self.weights(at)
        chance = 1 / (1 + np.exp(-np.clip(weights @ x, -35, 35)))
        gradient = (chance - label) * x
        squares = self.squares[at]
        rate = (np.sqrt(squares + gradient**2) - np.sqrt(squares)) / ALPHA
        self.sums[at] += gradient - rate * weights
        self.squares[at] = squares + gradient**2


def learned(texts: Iterable[str | None], labels: Iterable[int], bits: int = BITS) -> np.ndarray:
    """Weights after some passes over the texts, in the given order."""
    hasher, model = Hasher(bits), Ftrl(1 << bits)
    rows = [(*hasher.features(text), label) for text, label in zip(texts, labels, strict=True)]
    for _ in range(EPOCHS):
        for row in rows:
            model.learn(*row)
    return model.weights(slice(None))


def training_sample(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS
) -> DataFrame:
    """text, quality and shard of at most ``rows`` labelled documents, first by a hash of
    their id, with at most ``chars`` characters, texts beyond TEXT_CHARS left out. Ids are
    bounded by ``rows`` and broadcast, so no text moves that is not learned from."""
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter("quality = most")
        .select("doc_id", "quality", F.xxhash64("doc_id").alias("place"))
        .orderBy("place", "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    size = F.coalesce(F.length("text"), F.lit(0)).alias("size")
    one = (
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "quality", "place")
        .agg(F.min(F.struct("tie", size)).alias("least"))
        .select("doc_id", "quality", "place", "least.*")
        .filter(F.col("size") <= TEXT_CHARS)
    )
    # one window over at most rows rows without their texts
    before = Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    taken = one.withColumn("total", F.sum("size").over(before)).filter(F.col("total") <= chars)
    return (
        texts.join(F.broadcast(taken.select("doc_id", "tie", "quality", "place")), ["doc_id", "tie"])
        .groupBy("doc_id", "quality", "place")
        .agg(F.min("text").alias("text"))
        .select("text", "quality", "place", F.pmod("place", F.lit(SHARDS)).alias("shard"))
    )


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Averaged weights of all shards; a row of weights a shard reaches the driver."""

    def learn(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["place", "text"], na_position="first", kind="stable")
        weights = learned(shard["text"], shard["quality"].astype(int))
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()]})

    models = training_sample(docs, labels).groupBy("shard").applyInPandas(learn, "weights binary")
    total, count = np.zeros((1 << BITS) + 1), 0
    for row in models.toLocalIterator():
        total += np.frombuffer(row.weights, "<f4")
        count += 1
    return (total / max(1, count)).astype(np.float32)


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every text: one sparse dot product each."""
    packed = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        hasher, model = Hasher(), packed.value

        def one(text: str | None) -> float:
            index, values = hasher.features(text)
            margin = float(model[index] @ values + model[-1])
            return float(1 / (1 + np.exp(-np.clip(margin, -35, 35))))

        def apply(columns):
            ids, texts = columns
            scores = [one(text) for text in texts]
            return [ids, scores, [int(score >= threshold) for score in scores]]

        return apply

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"), f"doc_id {kind}, score double, predicted int", make
    )


def fitted_and_scored(docs: DataFrame, labels: DataFrame, divisor: int = 5) -> DataFrame:
    """Learn from labels outside the held-out fold and score all rows."""
    fold = remainder(F.col("doc_id"), divisor)
    weights = fit(docs, labels.filter(fold != 0))
    return scored(docs, weights).withColumn("held_out", remainder(F.col("doc_id"), divisor) == 0)
