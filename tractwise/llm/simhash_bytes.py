"""SimHash near-duplicates through an inverted index of positional bytes.

A 64-bit fingerprint is eight bytes, each a term (position, byte). Two fingerprints
within ``d`` = 2 bits differ in at most 2 bytes, so at least 6 of the 8 terms are shared.
A list of one term holds one in 256 fingerprints, and pairs from it would grow with the
square of the corpus. So the index holds sets of terms: the bytes form 4 blocks of two,
any two blocks make a key of four terms, and a pair that shares 6 terms shares at least
one of the 6 keys (two differing bytes lie in two blocks at most). For pairs that meet
in a list, shared terms are counted, pairs with 6 or more stay, and these are verified
by their differing bits.

A list may hold a great many fingerprints, as when thousands of near copies share half
their bits. Beyond ``list_pairs`` entries no pairs are formed: every entry also files
itself under each value that differs in one of the bits outside the key. Two entries
differ in at most two such bits exactly if they meet under a common value, and all who
meet there are linked to the least of them. That is as exact and linear in the list.

Equal fingerprints are one entry, whatever their number.

Nulls: a null text is an empty one and has fingerprint zero like any text without words;
null doc_ids are never a component's id unless it has no other. Repeated rows and ids
are rows of one component. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractwise.llm.common import BYTE_WORDS, map_arrow, stored
from tractwise.llm.components import components

SEED = 42
BLOCKS, BLOCK_BITS = 4, 16
#: Shingles hashed and counted at a time.
SLICE = 1 << 14


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the shingles of a text, repeats included, as an unsigned number."""
    found = BYTE_WORDS.findall((text or "").encode().lower())
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(word) + 1 for word in found]) - 1
    starts = ends - [len(word) for word in found]
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    total, ones = len(last), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, SLICE):
        spans = zip(starts[at : at + SLICE].tolist(), last[at : at + SLICE].tolist(), strict=False)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > total, bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (and columns to keep) with ``fp``, the fingerprint as a signed 64-bit number."""
    names = ["doc_id", *keep]

    def make():
        def apply(columns):
            prints = [fingerprint(text, words) for text in columns[-1]]
            return [*columns[:-1], [p - (1 << 64) if p >> 63 else p for p in prints]]

        return apply

    kinds = [f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in names]
    return map_arrow(docs.select(*names, "text"), ", ".join([*kinds, "fp long"]), make)


def shared_bytes(a: Column, b: Column) -> Column:
    """Positions at which two fingerprints have the same byte."""
    differing = a.bitwiseXOR(b)
    equal = [
        (F.shiftrightunsigned(differing, 8 * at).bitwiseAND(0xFF) == 0).cast("int")
        for at in range(8)
    ]
    return sum(equal[1:], equal[0])


def _block(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, BLOCK_BITS * at).bitwiseAND((1 << BLOCK_BITS) - 1)


def postings(prints: DataFrame) -> DataFrame:
    """(combo, key, fp): each fingerprint under its six pairs of blocks."""
    keys = [
        F.struct(
            F.lit(number).cast("int").alias("combo"),
            F.shiftleft(_block(F.col("fp"), a), BLOCK_BITS)
            .bitwiseOR(_block(F.col("fp"), b))
            .alias("key"),
        )
        for number, (a, b) in enumerate(combinations(range(BLOCKS), 2))
    ]
    return prints.select("fp", F.explode(F.array(*keys)).alias("at")).select("at.*", "fp")


def _flips(bits: int) -> Column:
    """fp itself and fp with one bit changed, of the bits outside the key of its combo."""
    masks = []
    for pair in combinations(range(BLOCKS), 2):
        free = [
            1 << bit for bit in range(64) if bit // BLOCK_BITS not in pair
        ]
        signed = [m - (1 << 64) if m >> 63 else m for m in free]
        masks.append(F.array(*[F.lit(m).cast("long") for m in [0, *signed]][: bits + 1]))
    chosen = F.element_at(F.array(*masks), F.col("combo") + 1)
    return F.transform(chosen, lambda mask: F.col("fp").bitwiseXOR(mask))


def links(prints: DataFrame, max_bits: int = 2, list_pairs: int = 32) -> DataFrame:
    """(a, b) links whose components are those of all pairs within ``max_bits`` bits.

    ``prints`` has distinct fingerprints. ``max_bits`` may be 0, 1 or 2: more differing
    bits can lie in more bytes than the keys leave free.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys guarantee a meeting for at most 2 differing bits")
    least_shared = 8 - max_bits
    index = postings(prints)
    # stored, so that the join has two shuffles of its own and Spark can split a hot list
    sizes = index.groupBy("combo", "key").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = stored(sizes, "list-sizes")
    lists = stored(index.join(sizes, ["combo", "key"]), "lists")
    small = lists.filter(F.col("size") <= list_pairs)
    a, b = F.col("x.fp"), F.col("y.fp")
    pairs = (
        small.alias("x")
        .join(
            small.alias("y"),
            (F.col("x.combo") == F.col("y.combo")) & (F.col("x.key") == F.col("y.key")) & (a < b),
        )
        .select(a.alias("a"), b.alias("b"))
        .filter(shared_bytes(F.col("a"), F.col("b")) >= least_shared)
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    )
    large = lists.filter(F.col("size") > list_pairs)
    if max_bits == 2:
        met = large.select("combo", "key", "fp", F.explode(_flips(32)).alias("value"))
        hubs = met.groupBy("combo", "key", "value").agg(
            F.min("fp").alias("hub"), F.count("*").alias("met")
        )
        starred = met.join(hubs.filter("met > 1"), ["combo", "key", "value"])
        stars = starred.select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    else:
        # within one bit: the other's value itself is among the flips
        met = large.select("combo", "key", "fp", F.explode(_flips(32 * max_bits)).alias("value"))
        others = large.select("combo", "key", F.col("fp").alias("value"))
        stars = met.join(others, ["combo", "key", "value"]).select(
            F.col("fp").alias("a"), F.col("value").alias("b")
        )
    return pairs.unionByName(stars.filter("a <> b"))


def near_groups(prints: DataFrame, max_bits: int = 2, list_pairs: int = 32) -> DataFrame:
    """Adds ``component_id``, the least doc_id reachable, and ``root``, a fingerprint of the
    component, to rows with doc_id and fp."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
    rooted = components(links(distinct.select("fp"), max_bits, list_pairs))
    members = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    members = stored(members, "members")
    least = stored(members.groupBy("root").agg(F.min("least_id").alias("component_id")), "roots")
    named = members.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp")


def kept_documents(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each component, with all its columns: the one with the least doc_id
    (a null one last), and of rows with one id the first as stored."""
    placed = stored(
        docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("document")),
        "near-input",
    )
    texts = placed.select("row", "document.doc_id", "document.text")
    prints = stored(fingerprints(texts, words, ("row",)), "fingerprints")
    grouped = stored(near_groups(prints, max_bits), "near")
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    keepers = grouped.groupBy("root").agg(first.alias("row"))
    return placed.join(keepers.select("row"), "row", "left_semi").select("document.*")
