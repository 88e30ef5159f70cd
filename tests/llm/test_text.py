"""Tokens, rules, classifiers and languages against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from tractwise.llm import byte_bpe, compression, cross_parse, ftrl, token_files, vocab
from tractwise.llm.common import shared_folder
from tractwise.llm.dac import Codes, pack
from tractwise.llm.queries import BYTE_RANKS, QUERIES, WORD_TOKENIZER

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [
    None,
    "",
    " \n\t ",
    "a",
    "Ünï's don't  it’ll A'S 'T x.,y 12.5% \x1c\x85\xa0 z Σς İ ß ﬁ ① é ́a ́",
    "<|endoftext|> a<|startoftext|>b",
    "日本 語。\r\nx\fy\vz",
    "word " * 40_000,
    "x" * 100_000,
]
KIND = "doc_id long, text string, score string, kept string, n_tokens string"


def odd_rows(spark):
    """Odd texts with repeated ids, NULL ids and columns named like results."""
    rows = [(i // 2 or None, text, "s", "k", "n") for i, text in enumerate(ODD + ODD)]
    return spark.createDataFrame(rows, KIND)


def texts_of(spark, path):
    rows = spark.read.parquet(f"{path}/documents.parquet").collect()
    return {row.doc_id: row.text for row in rows}


@pytest.mark.parametrize("size", [0, 1, 8, 511, 512, 513, 3000])
def test_codes_read_any_place(size):
    rng = np.random.default_rng(size)
    ids = rng.integers(0, 1 << rng.integers(1, 25, size), size) if size else np.zeros(0, int)
    codes = Codes(pack(ids))
    assert [codes[i] for i in range(size)] == ids.tolist()
    for a, b in [(0, size), (size // 3, size // 2), (size, size)]:
        assert codes.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        codes[size]


LIBRARY = Tokenizer.from_file(WORD_TOKENIZER)


def plain_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_encoder_equals_the_library_on_any_text():
    rng = random.Random(9)
    markers = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext |>"]
    parts = [*markers, "Word", "WORD,", "don't", "it'S", "12.5", "é", "e\u0301", "É!?", "日本", " ", "\t", "\n\n"]
    parts += ["\x1c", "\x1d", "\x85", "\xa0", "\u2003", "\u3000", "ß", "İ", "ﬁ", "🙂", "_", "<|", "|>", "a"]
    assert LIBRARY.encode("<|endoftext|> a", add_special_tokens=False).ids == [49407, 320]
    encoder = vocab.WordEncoder(WORD_TOKENIZER)
    assert encoder.wordwise
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert [*np.frombuffer(encoder.encode(text), "<u4").tolist(), 1] == plain_ids(text), text


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = vocab.WordEncoder(path), Tokenizer.from_file(path)
    assert not encoder.wordwise
    for text in ODD[2:7]:
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_the_older_generation(monkeypatch):
    monkeypatch.setattr(vocab, "MEMO_WORDS", 3)
    encoder = vocab.WordEncoder(WORD_TOKENIZER)
    for text in ["One two, three four", "one TWO three.", "five six seven", "one two"] * 3:
        assert [*np.frombuffer(encoder.encode(text), "<u4").tolist(), 1] == plain_ids(text)
        assert len(encoder.memo) <= 8


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_equal_whole_encodings(spark):
    rows = QUERIES["op1_token_files"](spark, SMALL).orderBy("doc_id").collect()
    texts, start = texts_of(spark, SMALL), 0
    assert [row.doc_id for row in rows] == sorted(texts)
    for row in rows:
        ids = plain_ids(texts[row.doc_id])
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_of_odd_rows(spark):
    docs, folder = odd_rows(spark), shared_folder(spark, "tokens")
    token_files.write_tokens(docs, folder, WORD_TOKENIZER, segment=50)
    rows = token_files.read_documents(spark, folder).orderBy("start").collect()
    expected = [(row.doc_id, crc(plain_ids(row.text))) for row in docs.collect()]
    key = lambda pair: (pair[0] is not None, pair)
    assert sorted([(r.doc_id, r.ids_crc32) for r in rows], key=str) == sorted(expected, key=str)
    assert [key((r.doc_id,))[0] for r in rows] == sorted(r.doc_id is not None for r in rows)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]]).tolist()[:-1]
    last = rows[-1]
    assert token_files.token_at(spark, folder, last.start + last.n_tokens - 1) == 1
    empty = shared_folder(spark, "tokens")
    token_files.write_tokens(docs.limit(0), empty, WORD_TOKENIZER)
    assert token_files.read_documents(spark, empty).count() == 0


def plain_rules(text):
    text = text or ""
    words, seen, marked = compression.WORDS.findall(text), {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            marked |= {i + k for i in places for k in range(3)}
    lines = [line for line in text.split("\n") if compression.WORDS.search(line)]
    repeated = sum(line in lines[:i] for i, line in enumerate(lines))
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, repeated, len(marked), failed


def test_compression_bands(spark):
    rows = QUERIES["op2_compression_bands"](spark, MEDIUM).collect()
    texts = texts_of(spark, MEDIUM)
    assert len(rows) == len(texts)
    for row in rows:
        assert tuple(row)[1:7] == plain_rules(texts[row.doc_id])
        assert not (row.kept and row.base_failed)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()
    kept = {row.doc_id: row.kept for row in rows}
    long_good = [r for r in rows if not r.base_failed]
    good = {label.doc_id for label in labels if label.quality == 1}
    assert all(kept[r.doc_id] for r in long_good if r.doc_id in good)
    docs = odd_rows(spark)
    assert {r.kept for r in compression.judged(docs).collect()} == {False}
    assert compression.kept_documents(docs).count() == 0
    assert compression.kept_documents(docs).columns == docs.columns
    assert compression.judged(docs.limit(0)).count() == 0


def test_bands_reject_noise_and_repeats():
    rng = random.Random(1)
    judge = compression.Judge(compression.Bands())
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    noise = " ".join("".join(rng.choices(letters, k=40)) for _ in range(200))
    assert not judge(noise)[-1] and judge(noise)[-2] > 0
    assert compression.chunks_of(b"x" * 2600, 1024) == [b"x" * 1024, b"x" * 1024, b"x" * 552]
    assert compression.chunks_of(b"x" * 2100, 1024) == [b"x" * 1024, b"x" * 1076]


def test_ftrl_beats_chance_on_held_out_rows(spark):
    rows = QUERIES["op3_ftrl_quality"](spark, "/root/testdata/sf0.1").collect()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    quality = {label.doc_id: label.quality for label in labels}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    judged = [r for r in rows if r.held_out and r.doc_id in quality]
    bad = [r.predicted for r in judged if quality[r.doc_id] == 0]
    good = [r.predicted for r in judged if quality[r.doc_id] == 1]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_ftrl_of_odd_rows(spark):
    docs = odd_rows(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = ftrl.fitted_and_scored(docs, none).collect()
    assert len(rows) == docs.count() and {r.score for r in rows} == {0.5}
    mixed = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], none.schema)
    assert {r.score for r in ftrl.fitted_and_scored(docs, mixed).collect()} == {0.5}
    assert ftrl.fitted_and_scored(docs.limit(0), mixed).count() == 0


def plain_weights(texts, labels, bits):
    """FTRL-proximal, feature by feature, on a dictionary of weights."""
    sums, squares, end = defaultdict(float), defaultdict(float), 1 << bits
    mix_a, mix_b, whole = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1

    def weight(at):
        if abs(sums[at]) <= ftrl.L1:
            return 0.0
        sign = 1 if sums[at] > 0 else -1
        rate = (ftrl.BETA + math.sqrt(squares[at])) / ftrl.ALPHA + ftrl.L2
        return -(sums[at] - sign * ftrl.L1) / rate

    def features(text):
        words = ftrl.TOKENS.findall(text or "")
        hashes = [xxhash.xxh64_intdigest(word.lower()) for word in words]
        terms = list(hashes)
        for a, b in zip(hashes, hashes[1:], strict=False):
            terms.append((a * mix_a & whole) ^ (b * mix_b & whole))
            if a == b:
                terms.append(xxhash.xxh64_intdigest(ftrl.REPEATED))
        terms += [xxhash.xxh64_intdigest(ftrl.CAPITALS)] * sum(word.isupper() for word in words)
        counts = Counter((term * mix_a & whole) >> (64 - bits) for term in terms)
        values = {at: math.log(1 + n) for at, n in counts.items()}
        length = math.sqrt(sum(v * v for v in values.values()))
        return {at: v / length for at, v in values.items()}

    for _ in range(ftrl.EPOCHS):
        for text, label in zip(texts, labels, strict=True):
            x = {**features(text), end: 1.0}
            now = {at: weight(at) for at in x}
            chance = 1 / (1 + math.exp(-sum(now[at] * v for at, v in x.items())))
            for at, v in x.items():
                gradient = (chance - label) * v
                grown = squares[at] + gradient**2
                sums[at] += gradient - (math.sqrt(grown) - math.sqrt(squares[at])) / ftrl.ALPHA * now[at]
                squares[at] = grown
    return [weight(at) for at in range(end + 1)]


def test_ftrl_weights_equal_plain_ftrl(spark):
    rng = random.Random(8)
    pools = ["good plain words of prose, he said.", "CLICK here here here $$$ now NOW !!!"]
    labels = [i % 2 for i in range(60)]
    texts = [" ".join(rng.choices(pools[1 - label].split(), k=rng.randint(0, 30))) for label in labels]
    texts[5] = None
    expected = plain_weights(texts, labels, 12)
    assert np.allclose(ftrl.learned(texts, labels, 12), expected, atol=1e-9)
    assert any(expected) and not all(expected)
    # and through the tables: the order is that of the hashed ids, scores are dot products
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    sample = ftrl.training_sample(docs, known).orderBy("place").collect()
    weights = ftrl.learned([r.text for r in sample], [r.quality for r in sample])
    found = ftrl.fit(docs, known)
    assert len(sample) == 60 and np.allclose(found, weights, atol=1e-6)
    empty = ftrl.scored(docs, found).filter("doc_id = 5").first()
    assert empty.score == pytest.approx(1 / (1 + math.exp(-float(found[-1]))))


def test_ftrl_sample_is_bounded(spark, monkeypatch):
    rows = [(1, f"copy {i}") for i in range(500)] + [(i, "x" * 10) for i in range(2, 40)]
    rows += [(40, "y" * 1000), (41, None), (41, None), (42, "twice"), (42, "twice")]
    docs = spark.createDataFrame(
        [(*row, "q", 7, "t", 1) for row in rows],
        "doc_id long, text string, quality string, place int, tie string, size int",
    )
    known = spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    whole = Counter(r.text for r in ftrl.training_sample(docs, known).collect())
    assert sum(whole.values()) == 42 and whole[None] == 1 and whole["twice"] == 1
    assert ftrl.training_sample(docs, known, rows=20).count() <= 20
    few = [r.text or "" for r in ftrl.training_sample(docs, known, chars=95).collect()]
    assert 0 < len(few) and sum(map(len, few)) <= 95
    monkeypatch.setattr(ftrl, "TEXT_CHARS", 999)
    assert ftrl.training_sample(docs, known).count() == 41


def public_encoding():
    return tiktoken.Encoding(
        "public",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=byte_bpe.read_ranks(BYTE_RANKS),
        special_tokens={},
    )


def test_byte_bpe_equals_public_library(spark):
    encoding, texts = public_encoding(), texts_of(spark, SMALL)
    for row in QUERIES["op8_byte_bpe"](spark, SMALL).collect():
        ids = encoding.encode_ordinary(texts[row.doc_id])
        digits = ",".join(map(str, ids)).encode()
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(digits).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_byte_bpe_on_random_and_odd_texts(spark):
    encoding = public_encoding()
    bpe = byte_bpe.byte_bpe(BYTE_RANKS, public_tokenizers.PATTERN)
    rng = random.Random(5)
    pools = ["ab cd'  \n\t\r", "aaaa", "日本語 русский", "\x1c\x85 \xa0x9½²", ".,;!?'s't've 'l"]
    texts = ["".join(rng.choices(rng.choice(pools) + "aé", k=rng.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        assert bpe.encode(text) == encoding.encode_ordinary(text)
    docs = odd_rows(spark)
    tokens = byte_bpe.encoded(docs, BYTE_RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decoded(tokens, BYTE_RANKS, public_tokenizers.PATTERN).collect()
    expected = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert sorted([(r.doc_id, bytes(r.bytes)) for r in back], key=str) == sorted(expected, key=str)


def test_automaton_has_exactly_the_substrings():
    rng = random.Random(2)
    codes = [rng.randrange(3) for _ in range(60)]
    steps = cross_parse.suffix_automaton(codes)
    inside = {tuple(codes[a:b]) for a in range(60) for b in range(a, 61)}
    for _ in range(3000):
        word, state = [rng.randrange(3) for _ in range(rng.randint(1, 7))], 0
        for code in word:
            state = steps[state].get(code, -1) if state >= 0 else -1
        assert (state >= 0) == (tuple(word) in inside)


def plain_letters(text):
    """Lower-cased letters; other characters between them as one blank."""
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


def plain_phrases(text, sample):
    """Longest matches, cut greedily over the whole text."""
    at = count = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, count = at + size, count + 1
    return count


def plain_judgement(text, samples):
    letters = plain_letters(text)
    cost = [
        plain_phrases(letters, known) * math.log2(max(2, len(known))) / len(letters)
        for known in (plain_letters(sample) for _, sample in samples)
    ]
    best = cost.index(min(cost))
    other = min(cost[:best] + cost[best + 1 :])
    return samples[best][0], min(1.0, max(0.0, 1 - cost[best] / other))


def random_texts(rng, pool, count, size):
    words = ["".join(rng.choices(pool, k=rng.randint(1, 6))) for _ in range(60)]
    return [" ".join(rng.choices(words, k=rng.randint(1, size))) for _ in range(count)]


@pytest.mark.parametrize("block", [3, 7, 64, 1024])
def test_phrases_are_longest_matches_of_whole_texts(monkeypatch, block):
    monkeypatch.setattr(cross_parse, "BLOCK", block)
    monkeypatch.setattr(cross_parse, "LANES", 5)
    rng = random.Random(block)
    kanji = [chr(0x4E00 + i) for i in range(400)]
    pools = {"aa": "abcde", "ja": kanji[:300] + ["の", "は"], "zh": kanji[150:], "zz": "ab𠀀é"}
    samples = tuple((lang, " ".join(random_texts(rng, pool, 6, 40))) for lang, pool in pools.items())
    parser = cross_parse.Parser(samples)
    texts = [text for pool in pools.values() for text in random_texts(rng, pool, 8, 60)]
    # phrases that never begin together in two walks, an unknown script, and a single letter
    texts += ["ab" * 150, "a" * 300, samples[0][1], samples[2][1], "ψωψ ψ", "q", "the 12 a-b"]
    found = parser.phrases([parser.alphabet.codes(text) for text in texts])
    for row, text in zip(found.tolist(), texts, strict=True):
        assert row == [plain_phrases(plain_letters(text), plain_letters(s)) for _, s in samples]
    names, scores = parser.judge([*texts, None, "12"])
    for text, name, score in zip(texts, names, scores, strict=False):
        lang, expected = plain_judgement(text, samples)
        assert name == lang and score == pytest.approx(expected)
    assert names[-2:] == ["und", "und"] and scores[-2:] == [0.0, 0.0]


def test_scripts_of_many_characters_are_told_apart():
    rng = random.Random(3)
    kanji = [chr(0x4E00 + i) for i in range(6000)]
    pools = {"aa": "abcdefgh", "ja": kanji[:3000], "zh": kanji[3000:]}
    words = {lang: ["".join(rng.choices(pool, k=3)) for _ in range(1000)] for lang, pool in pools.items()}
    samples = tuple((lang, "".join(rng.choices(some, k=3000))) for lang, some in words.items())
    texts = ["".join(rng.choices(some, k=30)) for some in words.values()]
    parser = cross_parse.Parser(samples)
    assert parser.judge(texts)[0] == list(pools)
    assert parser.alphabet.size == len(set("".join(text for _, text in samples))) + 2


def test_samples_take_each_text_once(spark):
    rows = [(i, "the same text again", "en") for i in range(200)]
    rows += [(200 + i, f"another text {i}", "en") for i in range(20)] + [(300, None, "en"), (301, "x", None)]
    docs = spark.createDataFrame(
        [(*row, "p", 5) for row in rows], "doc_id long, text string, lang string, place string, part int"
    )
    ((lang, sample),) = cross_parse.samples(docs)
    assert lang == "en" and sorted(sample.split("\n")) == sorted({r[1] for r in rows if r[1] and r[2]})
    assert cross_parse.samples(docs, rows=3)[0][1].count("\n") == 2
    assert len(cross_parse.samples(docs, chars=10)[0][1]) == 10
    assert cross_parse.samples(docs.limit(0)) == ()


def test_languages_of_held_out_rows(spark):
    rows = QUERIES["op10_cross_parse"](spark, MEDIUM).collect()
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()
    langs = {doc.doc_id: doc.lang for doc in docs}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)


def test_languages_of_odd_rows(spark):
    docs = odd_rows(spark)
    judged = cross_parse.identified(docs, (("de", "das ist ein Wort"), ("en", "a word is this")))
    texts = {(r.doc_id, r.lang_pred, r.score) for r in judged.filter("doc_id IS NULL").collect()}
    assert texts == {(None, "und", 0.0)}
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    rows = cross_parse.learned_and_judged(unlabelled).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    assert cross_parse.learned_and_judged(unlabelled.limit(0)).count() == 0
