"""Quality rules: base counts, then bands of zstandard ratios.

Text that repeats itself compresses too well, noise too badly. Longer texts compress
better, so the limits depend on the length in bytes; pieces of a fixed size need none
of that and show junk in a part of a text.

Nulls: a null text has no words, so it fails the base rules; its ratio is null. Rows
are judged one by one: repeated rows and ids get equal verdicts, an empty table an
empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

from tractwise.llm.common import WORDS, bounded_batches, map_arrow

SYMBOLS = "#*$%&|<>"

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, ratio double, n_chunks long, n_chunks_out long, kept boolean"
)


@dataclass(frozen=True)
class Bands:
    """Limits on bytes before / bytes after compression.

    ``sizes`` are the lower ends of the length classes in bytes; ``lowest`` and
    ``highest`` hold for each class. A chunk is out of band beyond ``chunk_lowest`` or
    ``chunk_highest``; a last chunk of less than half a chunk joins the one before.
    More than ``chunk_share`` of chunks out of band reject the text. The limits are
    some 4 % above the highest ratios of texts labelled good, and above the 1.33 of random
    base64; see the README.
    """

    level: int = 3
    sizes: tuple[int, ...] = (0, 256, 1024, 4096, 16384, 65536)
    lowest: tuple[float, ...] = (0.0, 1.2, 1.4, 1.5, 1.5, 1.5)
    highest: tuple[float, ...] = (2.0, 2.1, 2.3, 2.5, 2.65, 2.8)
    chunk_bytes: int = 1024
    chunk_lowest: float = 1.35
    chunk_highest: float = 2.05
    chunk_share: float = 0.3


def base_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    first: dict[tuple[str, str, str], int] = {}
    marked = bytearray(n)
    for at, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
        before = first.setdefault(window, at)
        if before != at:
            marked[before : before + 3] = marked[at : at + 3] = b"\1\1\1"
    repeated = marked.count(1)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return (
        n,
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        n < 50 or 100 * repeated > 50 * n,
    )


def chunks_of(data: bytes, size: int) -> list[bytes]:
    """Pieces of a fixed size; a short rest joins the last piece."""
    starts = list(range(0, len(data), size))
    if len(starts) > 1 and len(data) - starts[-1] < size // 2:
        starts.pop()
    return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]


class Judge:
    """The verdict of one text."""

    def __init__(self, bands: Bands):
        import zstandard

        self.bands, self.compressor = bands, zstandard.ZstdCompressor(level=bands.level)

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.compressor.compress(data))

    def __call__(self, text: str | None) -> tuple:
        bands, base = self.bands, base_counts(text)
        data = (text or "").encode()
        if not data:
            return *base, None, 0, 0, False
        ratio = self.ratio(data)
        chunks = chunks_of(data, bands.chunk_bytes)
        judged = chunks if len(chunks) > 1 else []
        out = sum(
            not bands.chunk_lowest <= self.ratio(c) <= bands.chunk_highest for c in judged
        )
        at = bisect_right(bands.sizes, len(data)) - 1
        good = bands.lowest[at] <= ratio <= bands.highest[at]
        good = good and out <= bands.chunk_share * len(judged)
        return *base, ratio, len(judged), out, good and not base[-1]


def judged(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id with the counts, ratios and verdict of every text."""

    def make():
        judge = Judge(bands)

        def apply(columns):
            ids, texts = columns
            return [ids, *map(list, zip(*map(judge, texts), strict=True))] if ids else [[]] * 11

        return apply

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), f"doc_id {kind}, {COLUMNS}", make)


def kept_documents(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows whose text is kept, with all their columns. No shuffle."""
    bounded_batches(docs.sparkSession)

    @pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        judge = Judge(bands)
        return texts.map(lambda text: judge(text)[-1]).astype(bool)

    return docs.filter(keep(docs["text"]))
