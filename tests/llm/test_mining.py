"""Toxicity, spelling variants and hard negatives against plain versions."""

import itertools
import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractwise.llm import hard_negatives, spelling, toxicity
from tractwise.llm.queries import QUERIES

SMALL, MEDIUM, LARGE = (f"/root/testdata/sf{size}" for size in ("0.001", "0.01", "0.1"))


def shingles(text):
    """N-grams of a text as a plain set of strings."""
    plain = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    plain = re.sub(" +", " ", plain)
    return {plain[i : i + n] for n in range(3, 7) for i in range(len(plain) - n + 1)}


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_features_are_those_of_all_n_grams(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "SLICE", piece)
    rng = random.Random(1)
    texts = [None, "", "  ", "a", "Ünï-CODE x1y2 İß 日本語 🙂🙂 end"]
    texts += ["".join(rng.choices("abc .,Ä日", k=rng.randint(0, 60))) for _ in range(60)]
    hashes = {}
    for text in texts:
        found = toxicity.features(text)
        grams = shingles(text)
        for gram in grams:
            if gram not in hashes:
                # a gram alone, as the longest n-gram of its own code points
                points = np.array([ord(c) for c in gram], np.uint32)
                hashes[gram] = int(list(toxicity._grams(points))[-1][0])
        assert found.tolist() == sorted({hashes[gram] for gram in grams})
    assert len(set(hashes.values())) > 0.99 * len(hashes)


def test_ratios_and_weights_equal_plain_ones():
    rng = random.Random(2)
    rows = [sorted(rng.sample(range(8), rng.randint(0, 5))) for _ in range(40)]
    labels = np.array([float(2 in row or rng.random() < 0.2) for row in rows])
    toxic, clean = np.zeros(8), np.zeros(8)
    for row, label in zip(rows, labels, strict=True):
        (toxic if label else clean)[row] += 1
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    index, ratios = toxicity.log_ratios(toxic, clean, n1, n0, 0.0, 0.0)
    assert index.tolist() == list(range(8))
    for i in range(8):
        expected = math.log((toxic[i] + 1) / (n1 + 2) / ((clean[i] + 1) / (n0 + 2)))
        assert math.isclose(ratios[i], expected)
    some = set(toxicity.log_ratios(toxic, clean, n1, n0, 0.0, 2.0)[0])
    large = set(toxicity.log_ratios(toxic, clean, n1, n0, 1.0, 0.0)[0])
    assert some < set(index) and large == {i for i in index if abs(ratios[i]) >= 1}
    fit = toxicity.Fit(steps=3000)
    arrays = [np.array(row, np.int64) for row in rows]
    weights, intercept = toxicity.descended(arrays, labels, ratios, fit)

    def loss(w, b):
        total = fit.penalty / len(rows) * sum(x * x for x in w)
        for row, label in zip(rows, labels, strict=True):
            size = math.sqrt(sum(ratios[i] ** 2 for i in row)) or 1
            margin = b + sum(ratios[i] / size * w[i] for i in row)
            total += math.log1p(math.exp(margin if label == 0 else -margin)) / len(rows)
        return total

    least = loss(weights, intercept)
    for i in range(9):
        for step in (-1e-3, 1e-3):
            moved = np.append(weights, intercept)
            moved[i] += step
            assert loss(moved[:-1], moved[-1]) > least


def test_toxicity_of_held_out_rows(spark):
    rows = QUERIES["op11_nb_toxicity"](spark, LARGE).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic = [r.predicted for r in judged if labels[r.doc_id] == 1]
    clean = [r.predicted for r in judged if labels[r.doc_id] == 0]
    assert sum(toxic) >= 0.92 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_toxicity_of_odd_rows(spark):
    texts = [None, "", "x", "you vile thing " * 3, "a kind word " * 3, "vile " * 300_000]
    rows = [(i // 2 if i < 10 else None, t, "s", "p") for i, t in enumerate(texts + texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic string")
    kind = "doc_id long, toxic int"
    none = spark.createDataFrame([], kind)
    assert {r.score for r in toxicity.fitted_and_scored(docs, none).collect()} == {0.5}
    mixed = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], kind)
    assert {r.score for r in toxicity.fitted_and_scored(docs, mixed).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in (0, 1, 2, 3, 4)], kind)
    scores = {r.score for r in toxicity.fitted_and_scored(docs, one).collect()}
    assert len(scores) == 1 and scores.pop() > 0.5
    assert toxicity.fitted_and_scored(docs.limit(0), one).count() == 0
    bad = "thus spoke a moronic person again"
    more = [(i, bad if i % 3 == 0 else "thus spoke a gentle person again") for i in range(300)]
    # many rows of one labelled id count as one
    more += [(0, "thus spoke a gentle person again")] * 500
    docs = spark.createDataFrame(more, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], kind)
    fit = toxicity.Fit(rows=120, tasks=3)
    known = toxicity.labelled(labels)
    sample = toxicity.training_sample(docs, known, fit).collect()
    assert Counter(r.toxic for r in sample) == {True: 60, False: 60}
    few = toxicity.training_sample(docs, known, replace(fit, chars=600)).collect()
    assert 0 < sum(len(r.text) for r in few if r.toxic) <= 600
    assert toxicity.training_sample(docs, known, replace(fit, text_chars=3)).count() == 0
    found = toxicity.fitted_and_scored(docs, labels, fit=fit).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in found if r.doc_id)


def test_toxicity_writes_few_files(spark):
    """Files of a bounded sample follow its tasks, not the shuffle partitions."""
    docs = spark.range(300).select("id", F.concat(F.lit("some words "), "id").alias("text"))
    docs = docs.withColumnRenamed("id", "doc_id")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.rglob("part-*"))
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.enabled": "false"}
    old = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        toxicity.fitted(docs, labels, toxicity.Fit(tasks=3))
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert 0 < len(set(shared.rglob("part-*")) - before) <= 3


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {word: n for word, n in counts.items() if n >= 2}


def apart(a, b):
    """Is one edit of one code point between two words?"""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if apart(w, v)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * counts[word]:
            form[word] = best
    rows = set()
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        rows.add((word, form.get(word), root, n, len(near[word]), counts.get(form.get(word))))
    return rows


def test_spelling_query_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op12_spelling_variants"](spark, SMALL).collect()
    assert len(found) == len({r.word for r in found})
    assert set(map(tuple, found)) == plain_variants(plain_words(docs))


@pytest.mark.parametrize("state_words", [1, 6, 100_000])
def test_variants_of_dense_words_equal_all_pairs(spark, state_words):
    rng = random.Random(4)
    counts = {}
    for _ in range(260):
        word = rng.choice(["aaaaaaa", "abababab", "éaéaéaé", "zzzzyyyyxxxx"])
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(word))
            word = word[:at] + rng.choice(["", "a", "b", "é"]) + word[at + rng.randint(0, 1) :]
        if len(word) >= 7:
            counts[word] = rng.choice([2, 3, 30, 31, 400, 5000])
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling.variants(vocabulary, state_words=state_words).collect()
    assert set(map(tuple, found)) == plain_variants(counts) and len(found) == len(counts)


def test_forms_chain_to_a_root(spark):
    counts = {"abcdefgh" + "x" * i: 3 * 10**i for i in range(6)}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r.word: r for r in spelling.variants(vocabulary).collect()}
    assert {r.root for r in found.values()} == {"abcdefghxxxxx"}
    assert found["abcdefgh"].form == "abcdefghx" and found["abcdefghxxxxx"].form is None


def test_spelling_of_odd_rows(spark):
    long = "lang" * 4000
    texts = [None, "", "short words", "Étrange étrange ÉTRANGE étrangé", f"{long} {long} {long}q {long}q"]
    texts += ["naïveté×naïveté÷naïveté", "b" * 200_000 + " 12ab34"]
    rows = [(i if i % 3 else None, t, "w", 1) for i, t in enumerate(texts)]
    rows += rows[3:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    found = spelling.spelling_variants(docs)
    assert set(map(tuple, found.collect())) == plain_variants(plain_words([r[:2] for r in rows]))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def plain_negatives(rows):
    """rows: (vec_id, vector, label); ids may be null or repeat."""
    used = []
    for vec_id, vector, label in rows:
        if label is None or vector is None:
            continue
        if any(x is None or math.isnan(x) or math.isinf(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        used.append((vec_id, [math.floor(256 * x) for x in vector], label))
    found = Counter()
    for a, (anchor_id, anchor, label) in enumerate(used):
        if anchor_id is None or anchor_id % 50:
            continue
        scored = [
            (-sum(x * y for x, y in zip(anchor, vector)), vec_id is None, vec_id or 0, other, vec_id)
            for i, (vec_id, vector, other) in enumerate(used)
            if i != a
        ]
        scored.sort(key=lambda s: s[:3])
        for positive in [s for s in scored if s[3] == label][:5]:
            goal = -positive[0]
            fits = [s for s in scored if s[3] != label and 50 * goal <= -100 * s[0] <= 95 * goal]
            for rank, negative in enumerate(fits[:3], 1):
                found[anchor_id, positive[4], rank, negative[4], goal, -negative[0]] += 1
    return found


@pytest.mark.parametrize("scale", [1, 3000])
def test_negatives_of_odd_rows(spark, scale, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 37)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 60)
    rng = random.Random(7)
    rows = []
    for i in range(400):
        vector = [scale * rng.choice([-0.5, 0.25, 0.5, 0.75, 1.0]) for _ in range(5)]
        rows.append((rng.choice([i, i, i, None, 50, 100]), vector, rng.choice([0, 0, 0, 1, 2, 9])))
    odd = [None, [None] * 5, [math.nan] * 5, [math.inf] * 5, [], [0.5], [1.0] * 9]
    rows += [(50 * i, vector, 0) for i, vector in enumerate(odd)] + [(50, [1.0] * 5, None)]
    rows += rows[:20]
    table = spark.createDataFrame(
        [(*row, 1, "x") for row in rows],
        "vec_id long, embedding array<double>, label int, row int, score string",
    )
    found = Counter(map(tuple, hard_negatives.hard_negatives(table).collect()))
    assert found == plain_negatives(rows) and found
    assert hard_negatives.hard_negatives(table.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(table.filter("vec_id % 50 <> 0")).count() == 0


def test_products_are_exact_for_any_length():
    rng = np.random.default_rng(3)
    for size, depth in [(1, 3), (300, 64), (5000, 200), (3_000_000, 10), (2**30, 2)]:
        a = rng.integers(-size, size, (7, depth), endpoint=True)
        b = rng.integers(-size, size, (9, depth), endpoint=True)
        expected = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        moduli = hard_negatives.basis(size * size * depth)
        parts = [hard_negatives.residues(m.astype(float), moduli) for m in (a, b)]
        assert hard_negatives.product(*parts, moduli).tolist() == expected
    with pytest.raises(ValueError, match="63 bits"):
        hard_negatives.basis(1 << 62)


def test_best_keeps_the_first_of_equal_scores():
    rng = np.random.default_rng(5)
    scores = rng.integers(-3, 3, (23, 11))
    result = hard_negatives.Best(4, 11)
    for at in range(0, 23, 6):
        result.add(scores[at : at + 6].copy(), at)
    for column in range(11):
        order = sorted(range(23), key=lambda row: (-scores[row, column], row))[:4]
        assert result.rows[:, column].tolist() == order


def test_windows_are_whole_and_stay_within_64_bits():
    for score in (0, 1, 2, 39, 100, 12345, (1 << 62) - 1):
        low, high = hard_negatives.window(np.array([score]), 50, 95)
        assert (int(low[0]), int(high[0])) == (-(-50 * score // 100), 95 * score // 100)
    assert list(itertools.islice(hard_negatives.primes(), 3)) == [1021, 1019, 1013]
