"""Token ids by the tokenizers library, remembered word by word."""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Callable

#: Words are remembered up to this length; this many are kept in each of two generations, some
#: 200 bytes each, so 200 MB a worker.
MEMO_CHARS, MEMO_WORDS = 64, 1 << 19

#: A plain word of Latin-1 letters and the signs behind it; the tokenizer cuts between them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(f"([{LETTERS}]+)([.,;:!?]*)")

#: White space to Python that is none to the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"

END_ID = 1

# The sections of a tokenizer file that allow encoding word by word. Text is
# composed, blanks are one blank, letters are lower-cased; words, numbers and signs part, and
# blanks are dropped.
WORDWISE_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORDWISE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLANKS = r"\s+"


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def is_wordwise(sections: dict) -> bool:
    """Does a tokenizer file treat what stands between blanks on its own, as ``WordEncoder``
    takes it to?"""
    normalizer, split = sections.get("normalizer") or {}, sections.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers") or []
    cuts = split.get("pretokenizers") or []
    if [step.get("type") for step in steps] != WORDWISE_NORMALIZERS:
        return False
    if [cut.get("type") for cut in cuts] != ["Split", "ByteLevel"]:
        return False
    blanks, words, level = steps[1], cuts[0], cuts[1]
    return (
        (blanks.get("pattern") or {}).get("Regex") == BLANKS
        and blanks.get("content") == " "
        and (words.get("pattern") or {}).get("Regex") == WORDWISE_SPLIT
        and words.get("behavior") == "Removed"
        and words.get("invert") is True
        and not level.get("add_prefix_space")
        and not level.get("use_regex")
        and sections.get("post_processor") is None
        and not sections.get("truncation")
        and not sections.get("padding")
    )


class Memo(dict):
    """Ids by piece; asks for those it lacks and keeps them unless the piece is long."""

    def __init__(self, ids_of: Callable[[str], bytes]):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids_of(piece)
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids


class WordEncoder:
    """Encodes texts as the library does without adding special tokens.

    Ids come as little-endian unsigned 32-bit integers in bytes. With a file that
    ``is_wordwise`` the tokenizer sees each word once: a piece between blanks gives the same
    ids alone and inside a text. Signs behind a word and the word in capitals are made of what
    is remembered. A plain word needs no more than lower case before the library's merges, so
    it goes to the tokenizer's model at once. Other files, and texts with a marker string such
    as those of the special tokens, which the library finds across blanks, are encoded as a
    whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            sections = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        markers = sections.get("added_tokens") or []
        self.markers = [marker["content"] for marker in markers]
        # a marker that is looked for in normalised text may be written in other letters
        self.wordwise = is_wordwise(sections) and not any(m.get("normalized") for m in markers)
        # the model takes bytes as signs; ASCII stands for itself
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = re.findall(f"[{LETTERS}]", "".join(map(chr, range(0x80, 0x100))))
        self.as_bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in latin}
        self.memo = Memo(self._ids)
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _ids(self, piece: str) -> bytes:
        """Ids of a piece that is not in the newer generation."""
        known = self.older.get(piece)
        if known is not None:
            return known
        plain = PLAIN.fullmatch(piece)
        if plain is None:
            return self._whole(piece)
        word, signs = plain.groups()
        if signs:
            return self.memo[word] + self.memo[signs]
        lower = word.lower()
        if lower != word:
            return self.memo[lower]
        word = word if word.isascii() else word.translate(self.as_bytes)
        return packed([token.id for token in self.model.tokenize(word)])

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self.wordwise or any(marker in text for marker in self.markers):
            return self._whole(text)
        if any(sign in text for sign in SEPARATORS):
            # blanks next to each other give empty pieces, which have no ids
            pieces = text.replace("\n", " ").replace("\t", " ").split(" ")
        else:
            pieces = text.split()
        ids = b"".join(map(self.memo.__getitem__, pieces))
        if len(self.memo) > MEMO_WORDS:
            self.older, self.memo = self.memo, Memo(self._ids)
        return ids


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker process."""
    return WordEncoder(path)
