"""Spelling variants by finite-state composition.

The vocabulary, as an acceptor, is composed with a transducer that makes exactly one edit
(a code point inserted, deleted or replaced) and with the acceptor again. What the result
accepts are the pairs of words at distance one.

Before the edit both sides read the same code points, so both are in the same place of the
acceptor; a pair is found below the state in which its words part. The machine therefore
falls apart by initial states. For a pair whose shorter word has ``m`` code points and whose
words part at position ``at``, a *band* of positions ``lo <= at < hi`` fixes the first ``lo`` code
points and the last ``m - hi``. All words that agree there are one initial state: a word is
filed under (m, lo, hi, first ones, last ones), once as the shorter word, m its length, and
once as the longer. At first each length has two bands, halves of the word. An initial state
with more than ``state_words`` words has its band cut in two, and again, until it has few or
the band is one position, where the alphabet bounds it. Each pair belongs to one band, so it
is found once, whatever the cuts.

Initial states are dealt over tasks. A task minimises the acceptors of what is free between
the fixed ends, sharing states between initial states, and enumerates the accepted pairs.
What two states both accept is remembered, and pairs of states without common words are
left at once. Sums and best neighbours of each word leave the task, not pairs.

Nulls: a null text has no words; a null doc_id is the empty text in the checksum.
Repeated rows count as often as they stand. Other columns are not read. An empty table, or
one without words that occur twice, gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractwise.llm.common import ascii_lower, bounded_batches, stored

#: Letters of words.
LETTER = r"[A-Za-zÀ-ÿ]"
#: Least code points and occurrences of a word, and one in how many runs loses a code point.
LENGTH, TIMES, DROP = 7, 2, 31
#: How much more frequent a form is.
RATIO = 10
#: Words of one initial state, and states that a task keeps, before it starts anew.
STATE_WORDS, KEPT_STATES = 50_000, 500_000


def runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and run of every maximal run of letters with ``length`` code points or more."""
    pattern = f"{LETTER}{{{length},}}+"
    found = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(pattern), F.lit(0))
    return docs.select("doc_id", "text").select("doc_id", F.explode(found).alias("run"))


def words(
    docs: DataFrame, length: int = LENGTH, times: int = TIMES, drop: int = DROP
) -> DataFrame:
    """word and n. A run whose checksum with its doc_id is divisible by ``drop`` loses the code
    point that the checksum names, which makes variants of its word."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(
        F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))
    )
    return (
        runs(docs, length)
        .withColumn("h", F.crc32(name.cast("binary")))
        .select(F.when(F.col("h") % drop == 0, cut).otherwise(F.col("run")).alias("word"))
        .filter(F.length("word") >= length)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= times)
    )


#: Names the initial state of a filed word.
STATE = ("m", "lo", "hi", "first", "last")


def _ends(word: Column) -> list[Column]:
    """What a band fixes of a word; a band that reaches behind the word fixes no end."""
    first = F.substring(word, F.lit(1), F.col("lo"))
    fixed = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    last = F.substring(word, F.length(word) - fixed + 1, fixed)
    return [first.alias("first"), last.alias("last")]


def filed(vocabulary: DataFrame) -> DataFrame:
    """Each word under its initial states: as the shorter and as the longer word of a pair, in
    the first and in the second half."""
    length = F.length("word")
    roles = F.array(length, length - 1)
    half = F.floor(F.col("m") / 2).cast("int")
    bands = F.array(
        F.struct(F.lit(0).alias("lo"), half.alias("hi")),
        F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi")),
    )
    return (
        vocabulary.select("word", "n", F.explode(roles).alias("m"))
        .select("word", "n", "m", F.inline(bands))
        .select("word", "n", "m", "lo", "hi", *_ends(F.col("word")))
    )


def _cut(rows: DataFrame) -> DataFrame:
    """The same words with each band cut in two."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    bands = F.array(
        F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi"))
    )
    return (
        rows.select("word", "n", "m", F.inline(bands))
        .select("word", "n", "m", "lo", "hi", *_ends(F.col("word")))
    )


def spread(rows: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """Filed words with the bands of large initial states cut until all are small."""
    done = None
    while True:
        large = stored(
            rows.groupBy(*STATE)
            .agg(F.count("*").alias("size"))
            .filter((F.col("size") > state_words) & (F.col("hi") - F.col("lo") > 1))
            .drop("size"),
            "large-states",
        )
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, list(STATE), "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = stored(_cut(rows.join(large, list(STATE), "left_semi")), "cut-states")


class Acceptors:
    """Minimal acceptors of sets of words of one length, with shared states."""

    def __init__(self):
        self.known: dict[tuple, int] = {(): 0}
        #: Steps of each state; state 0 is the end.
        self.steps: list[dict[str, int]] = [{}]
        self.both: dict[tuple[int, int], tuple[str, ...]] = {(0, 0): ("",)}

    def state(self, steps: tuple[tuple[str, int], ...]) -> int:
        found = self.known.get(steps)
        if found is None:
            found = self.known[steps] = len(self.steps)
            self.steps.append(dict(steps))
        return found

    def of(self, sorted_words: list[str], first: int, stop: int, depth: int, size: int) -> int:
        """The state that accepts what follows ``depth`` code points of some sorted words."""
        if stop - first == 1:
            at = 0
            for sign in reversed(sorted_words[first][depth:]):
                at = self.state(((sign, at),))
            return at
        if depth == size:
            return 0
        steps = []
        while first < stop:
            sign, end = sorted_words[first][depth], first + 1
            while end < stop and sorted_words[end][depth] == sign:
                end += 1
            steps.append((sign, self.of(sorted_words, first, end, depth + 1, size)))
            first = end
        return self.state(tuple(steps))

    def common(self, one: int, other: int) -> tuple[str, ...]:
        """What both states accept."""
        if one > other:
            one, other = other, one
        found = self.both.get((one, other))
        if found is None:
            steps, more, words = self.steps[one], self.steps[other], []
            if one == other:
                for sign, after in steps.items():
                    words += [sign + rest for rest in self.common(after, after)]
            else:
                for sign, after in steps.items():
                    meets = more.get(sign)
                    if meets is not None:
                        words += [sign + rest for rest in self.common(after, meets)]
            found = self.both[one, other] = tuple(words)
        return found

    def replaced(self, at: int, before: str, pairs: list[tuple[str, str]]) -> None:
        """Pairs below a state that differ in one code point."""
        steps = self.steps[at]
        if len(steps) > 1:
            for (a, one), (b, other) in combinations(steps.items(), 2):
                for rest in self.common(one, other):
                    pairs.append((before + a + rest, before + b + rest))
        for sign, after in steps.items():
            self.replaced(after, before + sign, pairs)

    def inserted(
        self, short: int, long: int, before: str, at_end: bool, pairs: list[tuple[str, str]]
    ) -> None:
        """Pairs of a word below ``short`` and one below ``long`` that has one code point more.

        Of places that give the same word, the last counts. ``at_end``: may the code
        point stand behind the last of the shorter word?
        """
        steps = self.steps[short]
        for sign, after in self.steps[long].items():
            for rest in self.common(after, short):
                if rest[:1] != sign and (rest or at_end):
                    pairs.append((before + rest, before + sign + rest))
            below = steps.get(sign)
            if below is not None:
                self.inserted(below, after, before + sign, at_end, pairs)


def near_in_state(
    acceptors: Acceptors, rows: list[tuple[str, int]], m: int, lo: int, hi: int
) -> dict[str, tuple[int, int, str]]:
    """For each word of one initial state: near words found here, and n and word of the best."""
    fixed = max(m - hi, 0)
    short = sorted({word[lo : len(word) - fixed] for word, _ in rows if len(word) == m})
    if not short:
        return {}
    long = sorted({word[lo : len(word) - fixed] for word, _ in rows if len(word) > m})
    size = len(short[0])
    pairs: list[tuple[str, str]] = []
    start = acceptors.of(short, 0, len(short), 0, size)
    if len(short) > 1:
        acceptors.replaced(start, "", pairs)
    if long:
        other = acceptors.of(long, 0, len(long), 0, size + 1)
        acceptors.inserted(start, other, "", hi > m, pairs)
    if not pairs:
        return {}
    whole = {word[lo : len(word) - fixed]: (word, n) for word, n in rows}
    found: dict[str, tuple[int, int, str]] = {}
    for pair in pairs:
        (one, one_n), (other, other_n) = whole[pair[0]], whole[pair[1]]
        for word, near, n in ((one, other, other_n), (other, one, one_n)):
            count, best_n, best = found.get(word, (0, 0, ""))
            if n > best_n or (n == best_n and near < best):
                best_n, best = n, near
            found[word] = (count + 1, best_n, best)
    return found


NEAR = "word string, n_near long, best_n long, best string"


def near_words(rows: DataFrame) -> DataFrame:
    """word, n_near and the most frequent near word of filed words."""
    bounded_batches(rows.sparkSession)
    names = ["word", "n_near", "best_n", "best"]
    arrow = pa.schema([(n, pa.int64() if n in names[1:3] else pa.string()) for n in names])

    def enumerate_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one level a code point; these functions call each other without C in between
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
        acceptors, state, group = Acceptors(), None, []
        out: list[list] = [[], [], [], []]

        def close() -> None:
            nonlocal acceptors
            if len(group) > 1:
                found = near_in_state(acceptors, group, *state[:3])
                for word, (count, n, best) in found.items():
                    for column, value in zip(out, (word, count, n, best), strict=True):
                        column.append(value)
            if len(acceptors.steps) > KEPT_STATES or len(acceptors.both) > KEPT_STATES:
                acceptors = Acceptors()

        def batch_of() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow
            )
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            for *key, word, n in zip(*columns, strict=True):
                if key != state:
                    close()
                    state, group = key, []
                    if len(out[0]) >= 10_000:
                        yield batch_of()
                group.append((word, n))
        close()
        if out[0]:
            yield batch_of()

    dealt = (
        rows.select(*STATE, "word", "n")
        .repartition(*STATE)
        .sortWithinPartitions(*STATE)
        .mapInArrow(enumerate_pairs, NEAR)
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form")))
    return (
        dealt.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", (-F.col("best.less")).alias("best_n"), "best.form")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form. Each form is ``RATIO`` times as frequent, so chains
    are short; each round doubles how far a word looks."""
    found = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(
            found.join(further, "root", "left").select(
                "word",
                F.coalesce("further", "root").alias("root"),
                F.col("further").isNotNull().alias("moved"),
            ),
            "roots",
        )
        found = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return found


def variants(vocabulary: DataFrame, ratio: int = RATIO, state_words: int = STATE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n) of distinct words."""
    vocabulary = stored(vocabulary.select("word", "n"), "vocabulary")
    near = stored(near_words(spread(filed(vocabulary), state_words)), "near-words")
    above = vocabulary.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.struct("form", "best_n")).alias("above"),
    )
    placed = stored(above.select("word", "n", "n_near", "above.form", "above.best_n"), "forms")
    return (
        placed.join(roots(placed.filter("form IS NOT NULL")), "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            "n_near",
            F.col("best_n").alias("form_n"),
        )
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants of all words of ``text``."""
    return variants(words(docs))
