"""Language identification by cross-parsing.

For each language a suffix automaton holds every substring of its labelled text. A text
is cut greedily into the longest phrases that occur there; a text in that language needs
few, long phrases. With ``m`` characters of labelled text, ``phrases * log2(m)`` divided
by the text's length estimates the cross entropy; the least one names the language.

The automaton is a table (state, character) -> next state in which a missing step already
holds the step from the start, marked as the begin of a phrase. Characters that are frequent
in the labelled text are columns of the table. Steps by all others are a sorted list of
(state, character), so that every character of the labelled text is told apart, also in
scripts of thousands of them.

Numpy walks many blocks of text through an automaton at once, one character a step. A block
is a fixed number of characters, so long texts are many blocks and no block is a long chain.
A phrase may run on over the end of a block: it is followed into the next one until a phrase
begins where one begins in the walk of that block as well, and from there both walks agree.
So the count is that of the whole text.

Nulls and letters: a null text, or one without a letter, is ``und`` with score 0; so is
every text if nothing is labelled. Rows are judged one by one, repeated ones too. Ties go to
the language that comes first in the alphabet. Copies of one labelled text are one text of
the sample. Columns other than doc_id, text and lang are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tractwise.llm.common import map_arrow, remainder

#: Characters of labelled text a language, and labelled rows a language to take them from.
SAMPLE_CHARS, SAMPLE_ROWS = 40_000, 64
#: Columns of the step table. Code 0 is the gap between words, the last column is for
#: characters that no labelled text has; codes beyond are steps of the sorted list.
ALPHABET = 64
#: Characters in a block, and blocks walked at once.
BLOCK, LANES = 2048, 4096

START = np.int32(1 << 30)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of non-letters as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    if not len(points):
        return points
    plain = points < 0x250
    is_letter = _LETTERS[np.where(plain, points, 0)]
    if not plain.all():
        rare = np.unique(points[~plain])
        rare = rare[[chr(p).isalpha() for p in rare]]
        is_letter = np.where(plain, is_letter, np.isin(points, rare))
    points = np.where(is_letter, points, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return points[keep]


_LETTERS = np.array([chr(p).isalpha() for p in range(0x250)])


class Alphabet:
    """Codes of all characters of the labelled text, the most frequent ones as columns."""

    def __init__(self, texts: Iterable[str]):
        counts: Counter[int] = Counter()
        for text in texts:
            counts.update(letters(text).tolist())
        counts.pop(32, None)
        ranked = sorted(counts, key=lambda point: (-counts[point], point))
        codes = [rank + 1 if rank < ALPHABET - 2 else rank + 2 for rank in range(len(ranked))]
        known = sorted(zip(ranked, codes, strict=True))
        self.points = np.array([point for point, _ in known], np.uint32)
        self.numbers = np.array([code for _, code in known], np.int32)
        self.plain = np.full(len(_LETTERS), ALPHABET - 1, np.int32)
        self.plain[[point for point, _ in known if point < len(self.plain)]] = [
            code for point, code in known if point < len(self.plain)
        ]
        self.plain[32] = 0
        self.size = max([ALPHABET, *(code + 1 for code in codes)])

    def codes(self, text: str) -> np.ndarray:
        """0 for a blank, the last column for characters of no labelled text."""
        points = letters(text)
        is_plain = points < len(self.plain)
        if is_plain.all():
            return self.plain[points]
        codes = self.plain[np.where(is_plain, points, 32)]
        others = points[~is_plain]
        if len(self.points):
            at = np.minimum(np.searchsorted(self.points, others), len(self.points) - 1)
            codes[~is_plain] = np.where(self.points[at] == others, self.numbers[at], ALPHABET - 1)
        else:
            codes[~is_plain] = ALPHABET - 1
        return codes


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The steps (code to state) of each state of a text's suffix automaton."""
    steps: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for code in codes:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in steps[at]:
            steps[at][code] = new
            at = link[at]
        if at >= 0:
            target = steps[at][code]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(steps)
                steps.append(dict(steps[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and steps[at].get(code) == target:
                    steps[at][code] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return steps


class Automaton:
    """Steps of one language. A state is kept as the place of its row in the table."""

    def __init__(self, codes: list[int], alphabet: int):
        steps = suffix_automaton(codes)
        # the last state has no steps: every character begins a phrase there
        steps.append({})
        none, self.alphabet = len(steps) - 1, alphabet
        table = np.full((len(steps), ALPHABET), -1, np.int32)
        rare = []
        for state, row in enumerate(steps):
            for code, target in row.items():
                if code < ALPHABET:
                    table[state, code] = target
                else:
                    rare.append((state * alphabet + code, target * ALPHABET))
        rare.sort()
        self.keys = np.array([key for key, _ in rare] or [-1], np.int64)
        self.targets = np.array([target for _, target in rare] or [0], np.int32)
        # a character the language lacks is a phrase of its own
        start = np.where(table[0] >= 0, table[0], none) * ALPHABET | START
        self.table = np.where(table >= 0, table * ALPHABET, start[None, :]).astype(np.int32).ravel()
        self.restart = np.full(alphabet, none * ALPHABET | START, np.int32)
        for code, target in steps[0].items():
            self.restart[code] = target * ALPHABET | START
        self.begin = none * ALPHABET
        self.bits = np.log2(max(2, len(codes)))

    def step(self, states: np.ndarray, codes: np.ndarray, has_rare: bool) -> np.ndarray:
        """Next states, with START where a phrase begins."""
        if not has_rare:
            return self.table.take(states + codes)
        rare = np.flatnonzero(codes >= ALPHABET)
        found = self.table.take(states + np.minimum(codes, ALPHABET - 1))
        keys = (states[rare] // ALPHABET).astype(np.int64) * self.alphabet + codes[rare]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found[rare] = np.where(self.keys[at] == keys, self.targets[at], self.restart[codes[rare]])
        return found

    def run_on(self, state: int, block: np.ndarray, begins: np.ndarray) -> tuple[int, int, int]:
        """Follow a walk that enters ``block`` in ``state`` until a phrase begins where
        ``begins`` has one too: (phrases before, place, state), the place being the block's
        length if there is none."""
        phrases = 0
        for place in range(len(block)):
            code = block.item(place)
            if code < ALPHABET:
                value = self.table.item(state + code)
            else:
                value = int(self.step(np.array([state], np.int32), block[place : place + 1], True)[0])
            if value >= START:
                if begins[place]:
                    return phrases, place, state
                phrases += 1
            state = value & (START - 1)
        return phrases, len(block), state


class Parser:
    """Counts the phrases that texts need in each language."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [language for language, _ in samples]
        self.alphabet = Alphabet(text for _, text in samples)
        self.automata = [
            Automaton(self.alphabet.codes(text).tolist(), self.alphabet.size) for _, text in samples
        ]
        self.bits = np.array([automaton.bits for automaton in self.automata])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        blocks, owners = [], []
        for number, codes in enumerate(texts):
            for at in range(0, len(codes), BLOCK):
                blocks.append(codes[at : at + BLOCK])
                owners.append(number)
        counts = np.zeros((len(texts), len(self.automata)), np.int64)
        if not blocks:
            return counts
        owners = np.array(owners)
        follows = np.append(False, owners[1:] == owners[:-1])
        long = follows | np.append(follows[1:], False)
        order = np.argsort([-len(block) for block in blocks], kind="stable")
        groups = [order[first : first + LANES] for first in range(0, len(order), LANES)]
        laid = [self._laid([blocks[i] for i in chosen]) for chosen in groups]
        begins: list[np.ndarray | None] = [None] * len(blocks)
        ends = np.zeros(len(blocks), np.int32)
        found = np.zeros((len(blocks), len(self.automata)), np.int64)
        for column, automaton in enumerate(self.automata):
            for chosen, (codes, running, rare) in zip(groups, laid, strict=True):
                marks, ends[chosen] = self._walk(automaton, codes, running, rare)
                found[chosen, column] = np.count_nonzero(marks, axis=0)
                lanes = np.flatnonzero(long[chosen])
                for i, row in zip(chosen[lanes], np.ascontiguousarray(marks[:, lanes].T), strict=True):
                    begins[i] = row[: len(blocks[i])]
            # what the true walk differs in from the one that starts anew with the block
            state = 0
            for i in np.flatnonzero(long).tolist():
                if follows[i]:
                    before, place, state = automaton.run_on(state, blocks[i], begins[i])
                    found[i, column] = before + np.count_nonzero(begins[i][place:])
                    if place < len(blocks[i]):
                        state = int(ends[i])
                else:
                    state = int(ends[i])
        np.add.at(counts, owners, found)
        return counts

    @staticmethod
    def _laid(blocks: list[np.ndarray]) -> tuple[np.ndarray, list[int], list[bool]]:
        """Codes (place, block) of blocks in descending order of length, how many blocks
        reach each place, and whether any has a code beyond the table there."""
        lengths = np.array([len(block) for block in blocks])
        codes = np.zeros((lengths[0], len(blocks)), np.int32)
        for lane, block in enumerate(blocks):
            codes[: len(block), lane] = block
        running = len(blocks) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
        return codes, running.tolist(), (codes >= ALPHABET).any(axis=1).tolist()

    @staticmethod
    def _walk(
        automaton: Automaton, codes: np.ndarray, running: list[int], rare: list[bool]
    ) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases begin (place, block) if each block is walked from its start, and
        the last states."""
        states = np.full(codes.shape[1], automaton.begin, np.int32)
        marks = np.zeros(codes.shape, bool)
        for at, n in enumerate(running):
            values = automaton.step(states[:n], codes[at, :n], rare[at])
            np.greater_equal(values, START, out=marks[at, :n])
            np.bitwise_and(values, START - 1, out=states[:n])
        return marks, states

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the best entropy's margin to the next, 0 to 1."""
        coded = []
        for text in texts:
            has_letter = any(map(str.isalpha, text or "")) and bool(self.languages)
            coded.append(self.alphabet.codes(text) if has_letter else np.zeros(0, np.int32))
        sizes = [len(codes) for codes in coded]
        if not any(sizes):
            return ["und"] * len(texts), [0.0] * len(texts)
        cost = self.phrases(coded) * self.bits / np.maximum(sizes, 1)[:, None]
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(texts)), best]
        others = cost.copy()
        others[np.arange(len(texts)), best] = np.inf
        ratio = least / np.maximum(others.min(axis=1), 1e-12)
        names = [self.languages[b] if size else "und" for b, size in zip(best, sizes, strict=True)]
        scores = [float(1 - r) if size else 0.0 for r, size in zip(ratio, sizes, strict=True)]
        return names, [min(1.0, max(0.0, score)) for score in scores]


@functools.lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """One set of automata a worker process."""
    return Parser(samples)


def samples(
    labelled: DataFrame, chars: int = SAMPLE_CHARS, rows: int = SAMPLE_ROWS
) -> tuple[tuple[str, str], ...]:
    """Labelled text of each language, the same number of characters where there are enough.

    Takes the ``rows`` distinct texts of a language that come first by their hash, and of
    these as many characters as allowed, so what reaches the driver is bounded by the
    number of languages. Hashes are chosen first, ``rows`` a task and language before they
    are shuffled; no text moves that is not chosen.
    """
    order = Window.partitionBy("lang").orderBy("place")
    placed = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", F.xxhash64("text").alias("place"), F.substring("text", 1, chars).alias("part")
    )
    # at most rows hashes a language, so they are broadcast
    chosen = (
        placed.select("lang", "place")
        .distinct()
        .withColumn("at", F.row_number().over(order))
        .filter(F.col("at") <= rows)
    )
    # of texts with one hash, the least
    parts = (
        placed.join(F.broadcast(chosen), ["lang", "place"])
        .groupBy("lang", "at")
        .agg(F.min("part").alias("part"))
    )
    texts: dict[str, list[str]] = {}
    for row in parts.orderBy("lang", "at").toLocalIterator():
        taken = texts.setdefault(row.lang, [])
        if sum(map(len, taken)) < chars:
            taken.append(row.part)
    return tuple((lang, "\n".join(parts)[:chars]) for lang, parts in sorted(texts.items()))


def identified(docs: DataFrame, learned: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, lang_pred and score of every text. One pass, no shuffle."""

    def make():
        judge = parser(learned).judge if learned else None

        def apply(columns):
            ids, texts = columns
            if judge is None:
                return [ids, ["und"] * len(ids), [0.0] * len(ids)]
            return [ids, *judge(texts)]

        return apply

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"), f"doc_id {kind}, lang_pred string, score double", make
    )


def learned_and_judged(docs: DataFrame, divisor: int = 4, held_out: int = 2) -> DataFrame:
    """Learn from rows outside the held-out fold and judge all rows."""
    fold = remainder(F.col("doc_id"), divisor) == held_out
    rows = identified(docs, samples(docs.filter(~fold)))
    return rows.withColumn("held_out", remainder(F.col("doc_id"), divisor) == held_out)
