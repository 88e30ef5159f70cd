"""Hard negatives by matrix products in a residue number system.

Components become integers, and scores are their inner products, exact. A product runs in
float32: for each of several small primes, both matrices are reduced to residues around
zero, so small that no sum of ``DEPTH`` products leaves the integers that float32 holds.
Sums are reduced again, and the Chinese remainder theorem gives the signed score from its
residues. There are as many primes as the lengths of the vectors need, by Cauchy and
Schwarz: no score lies beyond the product of the two greatest lengths.

For an anchor, the ``positives`` rows of its label with the highest scores are its
positives. For each of them, the ``negatives`` rows of other labels with the highest scores
are taken from a window, a band of scores between two shares of the positive's score. So
there are two passes of all rows against all anchors, each in blocks: rows and anchors are
dealt into groups by a hash, each cell of a row group and an anchor group is one task,
and per anchor (and positive) a cell hands on its few best. No cell follows a label,
so a frequent label is no hot cell.

Nulls: rows with a null label or vector, or a null or non-finite component, take no part.
A row with a null vec_id is no anchor and comes last among equal scores. Rows are told apart
by a number they get when they are stored, so repeated rows, and other rows with the vec_id
of the anchor, are rows like any other. A vector that is shorter than another ends in zeros.
Without rows or anchors the result is empty. Other columns are not read. Scores must fit
into 63 bits; vectors so long that they may not raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractwise.llm.common import stored

#: Residues are at most HALF in size, so DEPTH products of two sum to less than 2**24.
HALF = 511
DEPTH = (1 << 24) // HALF**2
#: Components of a group at most, rows of a row group at least, and blocks of a product.
GROUP_COMPONENTS, GROUP_ROWS, BLOCK_ROWS, BLOCK_ANCHORS = 1 << 21, 2048, 4096, 512
#: Stands for no score.
NONE = np.int64(-(1 << 63))


@dataclass(frozen=True)
class Choice:
    """Every how many ids is an anchor; positives an anchor; negatives a positive; the window
    in hundredths of the positive's score."""

    every: int = 50
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


@cache
def primes() -> tuple[int, ...]:
    """Primes up to 2 * HALF + 1, greatest first."""
    limit = 2 * HALF + 1
    return tuple(p for p in range(limit, 2, -1) if all(p % q for q in range(2, int(p**0.5) + 1)))


def basis(bound: int) -> tuple[int, ...]:
    """The fewest primes whose product tells all numbers within the bound apart."""
    if bound >= 1 << 62:
        raise ValueError("scores of these vectors may not fit into 63 bits")
    product, chosen = 1, []
    for prime in primes():
        if product > 2 * bound + 1 and len(chosen) > 1:
            break
        chosen.append(prime)
        product *= prime
    return tuple(chosen)


def centred(values: np.ndarray, prime: int) -> np.ndarray:
    """Whole numbers modulo a prime, between -prime / 2 and prime / 2. The quotient may be one off
    for large values and is exact for the small ones that are left, hence two steps."""
    for _ in range(2):
        values = values - np.rint(values / values.dtype.type(prime)) * values.dtype.type(prime)
    return values


def residues(components: np.ndarray, moduli: tuple[int, ...]) -> list[np.ndarray]:
    """float32 residues of whole float64 numbers of any size."""
    return [centred(np.fmod(components, p), p).astype(np.float32) for p in moduli]


def product(
    rows: list[np.ndarray], anchors: list[np.ndarray], moduli: tuple[int, ...]
) -> np.ndarray:
    """Exact scores (rows x anchors) from residues of both."""
    digits: list[np.ndarray] = []
    for a, b, prime in zip(rows, anchors, moduli, strict=True):
        total = np.zeros((a.shape[0], b.shape[0]), np.float32)
        for at in range(0, a.shape[1], DEPTH):
            part = a[:, at : at + DEPTH] @ b[:, at : at + DEPTH].T
            total = centred(total + centred(part, prime), prime)
        # mixed radix: the next digit from the residue and the digits before
        for digit, modulus in zip(digits, moduli, strict=False):
            inverse = pow(modulus, -1, prime)
            inverse = np.float32(inverse - prime if 2 * inverse > prime else inverse)
            total = centred(centred(total - digit, prime) * inverse, prime)
        digits.append(total)
    # the sum wraps on the way, if at all, and is within 63 bits at the end
    scores, weight = digits[0].astype(np.int64), 1
    for digit, prime in zip(digits[1:], moduli, strict=False):
        weight *= prime
        scores += digit.astype(np.int64) * np.int64(weight)
    return scores


def best(scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest scores of each column, greatest first, and their rows; of equal scores the
    first row. ``scores`` is used up; NONE is never chosen, its row is -1."""
    columns = np.arange(scores.shape[1])
    found = np.full((count, scores.shape[1]), NONE)
    places = np.full((count, scores.shape[1]), -1)
    for turn in range(min(count, scores.shape[0])):
        at = scores.argmax(axis=0)
        found[turn] = scores[at, columns]
        places[turn] = np.where(found[turn] == NONE, -1, at)
        scores[at, columns] = NONE
    return found, places


class Best:
    """The greatest scores of some columns over blocks of rows that come in order."""

    def __init__(self, count: int, columns: int):
        self.scores = np.full((count, columns), NONE)
        self.rows = np.full((count, columns), -1)

    def add(self, scores: np.ndarray, first_row: int) -> None:
        count = len(self.scores)
        found, places = best(scores, count)
        both = np.concatenate([self.scores, found])
        rows = np.concatenate([self.rows, np.where(places < 0, -1, places + first_row)])
        order = np.argsort(both == NONE, axis=0, kind="stable")
        both, rows = np.take_along_axis(both, order, 0), np.take_along_axis(rows, order, 0)
        # NONE is the least number: its negative would wrap, so ranks go by the complement
        order = np.argsort(~both, axis=0, kind="stable")[:count]
        self.scores = np.take_along_axis(both, order, 0)
        self.rows = np.take_along_axis(rows, order, 0)


def components(vectors: pd.Series) -> np.ndarray:
    """floor(256 * x) of all vectors as a matrix, shorter ones with zeros at the end."""
    width = max(map(len, vectors), default=0)
    matrix = np.zeros((len(vectors), width))
    for row, vector in enumerate(vectors):
        matrix[row, : len(vector)] = vector
    return np.floor(matrix * 256)


def longest(matrix: np.ndarray) -> float:
    with np.errstate(over="ignore"):
        return float(np.sqrt((matrix**2).sum(axis=1).max(initial=0.0)))


def blocks(
    rows: pd.DataFrame, anchors: pd.DataFrame
) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Scores of a cell: anchors of one block, rows of one block, and rows x anchors."""
    many, few = components(rows["embedding"]), components(anchors["embedding"])
    width = min(many.shape[1], few.shape[1])
    many, few = many[:, :width], few[:, :width]
    limit = longest(many) * longest(few) * (1 + 1e-9) + 1
    moduli = basis(int(limit) if np.isfinite(limit) else 1 << 62)
    many, few = residues(many, moduli), residues(few, moduli)
    for a in range(0, len(anchors), BLOCK_ANCHORS):
        chosen = slice(a, min(a + BLOCK_ANCHORS, len(anchors)))
        right = [part[chosen] for part in few]
        for r in range(0, len(rows), BLOCK_ROWS):
            some = slice(r, min(r + BLOCK_ROWS, len(rows)))
            yield chosen, some, product([part[some] for part in many], right, moduli)


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """By vec_id, a null one last, then by row number."""
    return rows.sort_values(["vec_id", "row"], na_position="last", kind="stable", ignore_index=True)


def found_rows(
    result: Best, rows: pd.DataFrame, columns: np.ndarray, extra: dict[str, np.ndarray]
) -> pd.DataFrame:
    """A row for each score that was found; ``columns`` and ``extra`` are by column of result."""
    turn, column = np.nonzero(result.rows >= 0)
    at = result.rows[turn, column]
    return pd.DataFrame(
        {
            "anchor": columns[column],
            **{name: values[column] for name, values in extra.items()},
            "row": rows["row"].to_numpy()[at],
            "vec_id": rows["vec_id"].array[at],
            "score": result.scores[turn, column],
        }
    )


def usable(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label and embedding of the rows that take part, with labels shifted."""
    vector, label = F.col("embedding"), F.col("label").cast("long")
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")),
    )
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return (
        embeddings.select("vec_id", "label", "embedding")
        .filter(label.isNotNull() & vector.isNotNull() & finite)
        .select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("long").alias("vec_id"),
            shifted.alias("label"),
            vector.cast("array<double>").alias("embedding"),
        )
    )


def dealt(rows: DataFrame, own: str, other: str, groups: int, others: int) -> DataFrame:
    """Rows with their group by a hash, once for every group of the other side."""
    return rows.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    )


def _first(rows: DataFrame, by: list[str], count: int, rank: str) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row")]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(rank, place).filter(F.col(rank) <= count)


def window(score: Column | np.ndarray, low: int, high: int):
    """Least and greatest whole score of a window, without leaving 64 bits; the window of a score
    below zero is empty."""
    tens, rest = score // 100, score % 100
    return low * tens + -(-low * rest // 100), high * tens + high * rest // 100


def hard_negatives(embeddings: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    rows = stored(usable(embeddings), "vectors")
    is_anchor = F.col("vec_id") % choice.every == 0
    total, anchors_total, width = rows.agg(
        F.count("*"), F.count_if(is_anchor), F.coalesce(F.max(F.size("embedding")), F.lit(0))
    ).first()
    kind = (
        "anchor_id long, positive_id long, rank int, negative_id long,"
        " positive_score long, negative_score long"
    )
    if not anchors_total:
        return spark.createDataFrame([], kind)
    # a group is bounded in components; small tables are cut finer, for as many tasks as there are
    most = max(1, GROUP_COMPONENTS // max(1, width))
    share = -(-total // (2 * spark.sparkContext.defaultParallelism))
    row_groups = -(-total // min(most, max(GROUP_ROWS, share)))
    anchor_groups = -(-anchors_total // most)
    cell = ["row_group", "anchor_group"]
    many = dealt(rows, *cell, row_groups, anchor_groups).groupBy(*cell)
    anchors = stored(rows.filter(is_anchor), "anchors")

    def positives(_, rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        rows = in_order(rows)
        labels, numbers = rows["label"].to_numpy(), rows["row"].to_numpy()
        # a product for each label, of its rows and its anchors
        parts = []
        for label, some in anchors.groupby("label"):
            same = rows[labels == label].reset_index(drop=True)
            numbers, own = same["row"].to_numpy(), some["row"].to_numpy()
            result = None
            for chosen, at, scores in blocks(same, some):
                if at.start == 0:
                    result = Best(choice.positives, scores.shape[1])
                scores[numbers[at][:, None] == own[chosen][None, :]] = NONE
                result.add(scores, at.start)
                if at.stop == len(same):
                    parts.append(found_rows(result, same, own[chosen], {}))
        empty = pd.DataFrame(columns=["anchor", "row", "vec_id", "score"])
        return pd.concat(parts) if parts else empty

    ranked = _first(
        many.cogroup(dealt(anchors, *cell[::-1], anchor_groups, row_groups).groupBy(*cell))
        .applyInPandas(positives, "anchor long, row long, vec_id long, score long"),
        ["anchor"],
        choice.positives,
        "place",
    )
    chosen = stored(ranked.withColumnRenamed("vec_id", "positive_id"), "positives")
    # at most `positives` scores an anchor
    goals = chosen.groupBy(F.col("anchor").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("place", "score"))).alias("goals")
    )
    aimed = stored(anchors.join(goals, "row"), "aimed")
    aimed = dealt(aimed, *cell[::-1], anchor_groups, row_groups)

    def negatives(_, rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        rows, parts = in_order(rows), []
        labels, own = rows["label"].to_numpy(), anchors["row"].to_numpy()
        label_of = anchors["label"].to_numpy()
        goals = np.full((choice.positives, len(anchors)), NONE)
        for column, found in enumerate(anchors["goals"]):
            for goal in found:
                goals[goal["place"] - 1, column] = goal["score"]
        least, most = window(np.maximum(goals, 0), choice.low, choice.high)
        results: list[Best] = []
        for chosen, at, scores in blocks(rows, anchors):
            if at.start == 0:
                results = [Best(choice.negatives, scores.shape[1]) for _ in goals]
            scores[labels[at][:, None] == label_of[chosen][None, :]] = NONE
            for place, result in enumerate(results):
                fits = (scores >= least[place, chosen]) & (scores <= most[place, chosen])
                fits &= goals[place, chosen] >= 0
                result.add(np.where(fits, scores, NONE), at.start)
            if at.stop == len(rows):
                for place, result in enumerate(results, 1):
                    places = {"place": np.full(chosen.stop - chosen.start, place)}
                    parts.append(found_rows(result, rows, own[chosen], places))
        empty = pd.DataFrame(columns=["anchor", "place", "row", "vec_id", "score"])
        return pd.concat(parts) if parts else empty

    mined = _first(
        many.cogroup(aimed.groupBy(*cell)).applyInPandas(
            negatives, "anchor long, place int, row long, vec_id long, score long"
        ),
        ["anchor", "place"],
        choice.negatives,
        "rank",
    ).select(
        "anchor",
        "place",
        "rank",
        F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        mined.join(chosen.select("anchor", "place", "positive_id", "score"), ["anchor", "place"])
        .join(named, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            "negative_id",
            F.col("score").alias("positive_score"),
            "negative_score",
        )
    )
