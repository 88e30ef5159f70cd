"""Byte-level BPE by longest match and backtracking.

A piece of text becomes Latin-1 text, one character a byte, and an Aho-Corasick
automaton over the vocabulary gives the longest token that starts at each byte. The
encoding is built from left to right with these tokens. A token may follow another only
if the merges would keep the two apart; if it may not, the next shorter token is tried,
and if none is left, the last token is taken back and its end is ruled out. Each end is
ruled out once, so the work is linear in the piece. The result is the one encoding in
which all neighbours are compatible, which is what the merges produce.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractwise.llm.common import map_arrow

#: Strings are remembered up to this length; this many in each of two generations, some 200
#: bytes each, so 200 MB a worker. And how many pairs of tokens.
MEMO_CHARS, MEMO_ENTRIES, MEMO_PAIRS = 48, 1 << 19, 1 << 18

#: White space as the tokenizer's pattern takes it (Unicode's White_Space).
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"

#: The tokenizer's pattern never matches across the border of two units.
UNITS = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 and a number a line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Vocabulary:
    """Tokens, how each is made of two others, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        #: The two tokens whose merge makes a token; None for single bytes.
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.compatible_memo: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda pair: pair[1]):
            if len(token) == 1:
                self.halves[rank] = None
                continue
            halves = self._halves(token, rank)
            if halves is not None:
                self.halves[rank] = halves
                self.merged[halves] = rank
        self.compatible_memo.clear()
        self.automaton = ahocorasick.Automaton()
        for rank in self.halves:
            token = self.bytes_of[rank]
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        #: The longest token that is a shorter start of a token.
        self.shorter: dict[int, int | None] = {}
        for rank in self.halves:
            token, found = self.bytes_of[rank], None
            for size in range(len(token) - 1, 0, -1):
                part = ranks.get(token[:size])
                if part in self.halves:
                    found = part
                    break
            self.shorter[rank] = found
        self.size_of = {rank: len(self.bytes_of[rank]) for rank in self.halves}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The cut of a token whose halves come first and stay apart without its own merge;
        None if the merges never make it."""
        for at in range(1, len(token)):
            left, right = self.ranks.get(token[:at]), self.ranks.get(token[at:])
            if (
                left in self.halves
                and right in self.halves
                and max(left, right) < rank
                and self._apart(left, right)
            ):
                return left, right
        return None

    def _apart(self, left: int, right: int) -> bool:
        """Would the merges keep two tokens apart?

        Undo the merges that made the two, latest first, and look at the tokens that
        touch at the border after each step. If these merge before the merge that was
        just undone, they would have been merged first, across the border.
        """
        limit = None
        while True:
            across = self.merged.get((left, right))
            if across is not None and (limit is None or across < limit):
                return False
            undo_left, undo_right = self.halves[left], self.halves[right]
            if undo_left is None and undo_right is None:
                return True
            # of two equal merges the left one happens first, so the right one is undone
            if undo_left is not None and (undo_right is None or left > right):
                limit, left = left, undo_left[1]
            else:
                # a merge of equal rank at the border comes before the one on its right
                limit, right = right + 1, undo_right[0]

    def compatible(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left``? Remembered for each pair."""
        if len(self.compatible_memo) >= MEMO_PAIRS:
            self.compatible_memo.clear()
        apart = self.compatible_memo[left, right] = self._apart(left, right)
        return apart

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece, as the merges give them."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        size = len(piece)
        longest: list[int | None] = [None] * (size + 1)
        for end, (rank, length) in self.automaton.iter(piece.decode("latin-1")):
            # ends ascend, so a later match at one start is longer
            longest[end - length + 1] = rank
        open_ends = bytearray(b"\1") * (size + 1)
        size_of, known_pairs = self.size_of, self.compatible_memo
        found: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            last = found[-1] if found else None
            while token is not None:
                end = at + size_of[token]
                if open_ends[end]:
                    if last is None:
                        break
                    known = known_pairs.get((last, token))
                    if self.compatible(last, token) if known is None else known:
                        break
                token = self.shorter[token]
            if token is not None:
                found.append(token)
                at = end
                token = longest[at]
            elif last is None:
                raise ValueError("the vocabulary lacks a byte of the text")
            else:
                open_ends[at] = 0
                found.pop()
                at -= size_of[last]
                token = self.shorter[last]
        return tuple(found)


#: A word of Latin-1 letters with the blank before it, and signs behind it: two pieces.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD_AND_SIGNS = re.compile(f"( ?[{LETTERS}]+)([.,;:!?]+)")


def packed(ids: tuple[int, ...]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Memo(dict):
    """Packed ids by string; works out what it lacks and keeps it unless it is long."""

    def __init__(self, ids_of: Callable[[str], bytes]):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, part: str) -> bytes:
        ids = self.ids_of(part)
        if len(part) <= MEMO_CHARS:
            self[part] = ids
        return ids


class ByteBpe:
    """Encodes and decodes texts; remembers strings and their ids in two generations.

    Units of a text are looked up in the newer generation, then in the older; when the newer
    one is full it becomes the older one. A unit of several pieces is made of their ids, which
    are remembered alike.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        # \s as the public library takes it; Python's also has control characters
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}"))
        self.units = re.compile(UNITS)
        # does the pattern cut between a word and signs, and nowhere in either?
        self.plain = self.pieces.findall(" abé.,;:!?") == [" abé", ".,;:!?"]
        self.memo = Memo(self._ids)
        self.older: dict[str, bytes] = {}

    def _ids(self, part: str) -> bytes:
        """Ids of a unit or piece that is not in the newer generation."""
        known = self.older.get(part)
        if known is not None:
            return known
        two = WORD_AND_SIGNS.fullmatch(part) if self.plain else None
        pieces = two.groups() if two else self.pieces.findall(part)
        if len(pieces) == 1:
            return packed(self.vocabulary.encode_piece(part.encode()))
        return b"".join(map(self.memo.__getitem__, pieces))

    def encode_packed(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        ids = b"".join(map(self.memo.__getitem__, self.units.findall(text or "")))
        if len(self.memo) > MEMO_ENTRIES:
            self.older, self.memo = self.memo, Memo(self._ids)
        return ids

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@functools.cache
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder a worker process."""
    return ByteBpe(read_ranks(path), pattern)


def encoded(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and the ids of every text. A null text is an empty one, with no ids; rows
    are encoded one by one, so repeated rows and ids need no rule."""

    def make():
        bpe = byte_bpe(ranks, pattern)
        return lambda columns: [columns[0], [bpe.encode(text) for text in columns[1]]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), f"doc_id {kind}, ids array<int>", make)


def decoded(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that ids stand for; null ids give no bytes."""

    def make():
        bpe = byte_bpe(ranks, pattern)
        return lambda columns: [columns[0], [bpe.decode(ids or ()) for ids in columns[1]]]

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return map_arrow(tokens.select("doc_id", "ids"), f"doc_id {kind}, bytes binary", make)


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes they decode to."""

    def make():
        bpe = byte_bpe(ranks, pattern)
        text_of = {rank: str(rank) for rank in bpe.vocabulary.bytes_of}

        def one(text: str | None) -> tuple[int, str, str]:
            ids = np.frombuffer(bpe.encode_packed(text), "<u4").tolist()
            digits = ",".join(map(text_of.__getitem__, ids)).encode()
            back = bpe.decode(ids)
            return len(ids), hashlib.sha256(digits).hexdigest(), hashlib.sha256(back).hexdigest()

        def apply(columns):
            ids, texts = columns
            return [ids, *map(list, zip(*map(one, texts), strict=True))] if ids else [[]] * 4

        return apply

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", F.col("text")),
        f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
        make,
    )
