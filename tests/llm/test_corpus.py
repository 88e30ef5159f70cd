"""Deduplication, packing, URLs, personal data and the pipeline against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests import oracle_check
from tractwise.llm import (
    compression,
    contextual_pii,
    length_buckets,
    simhash_bytes,
    stream_dedup,
    url_rules,
)
from tractwise.llm.common import shared_folder
from tractwise.llm.components import components
from tractwise.llm.queries import ORACLE, QUERIES, URL_RULES

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def written(spark, rows, kind="doc_id long, text string", parts=3):
    path = shared_folder(spark, "fixture")
    spark.createDataFrame(rows, kind).repartition(parts).write.parquet(path)
    return path


def plain_roots(nodes, linked):
    root = {node: node for node in nodes}

    def find(node):
        while root[node] != node:
            node = root[node]
        return node

    for a, b in linked:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {node: find(node) for node in nodes}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, MEDIUM)
    columns, expected = oracle_check.duckdb_rows(oracle_check.connect(MEDIUM), ORACLE[name])
    assert sorted(frame.columns) == columns
    assert oracle_check.spark_rows(frame) == expected


DUPLICATES = [
    (1, "Aa b"),
    (2, "aA B"),
    (2, "aA B"),
    (3, "ÄB"),
    (4, "äB"),
    (None, None),
    (5, ""),
    (None, "Aa b"),
    (6, "x" * 200_000),
    (7, "X" * 200_000),
]


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_exact_groups_survive_equal_digests(spark, digest_bytes):
    path = written(spark, DUPLICATES + [(100 + i, f"t{i % 40}") for i in range(120)])
    rows = stream_dedup.exact_groups(spark, path, digest_bytes=digest_bytes).collect()
    groups = defaultdict(list)
    for doc_id, text in spark.read.parquet(path).collect():
        groups[stream_dedup.normalised(text)].append(doc_id)
    expected = Counter()
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        expected.update((i, keep, len(ids)) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == expected
    assert sum(r.kept for r in rows) == len(groups)


def test_exact_state_goes_on_with_new_files(spark):
    path, folder = written(spark, [(1, "a"), (2, "b"), (3, "A")]), shared_folder(spark, "state")
    stream_dedup.exact_groups(spark, path, folder, files_per_batch=1)
    more = spark.createDataFrame([(4, "a"), (0, "B"), (9, "c")], "doc_id long, text string")
    more.coalesce(1).write.mode("append").parquet(path)
    rows = stream_dedup.exact_groups(spark, path, folder, files_per_batch=1).collect()
    found = {(r.doc_id, r.keep_id, r.group_size) for r in rows}
    assert found == {(1, 4, 3), (3, 4, 3), (4, 4, 3), (2, 2, 2), (0, 2, 2), (9, 9, 1)}


def test_exact_kept_documents(spark):
    docs = spark.createDataFrame(
        [(*row, "k", "l") for row in DUPLICATES], "doc_id long, text string, kept string, row string"
    )
    kept = stream_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "5", "7"]
    assert stream_dedup.kept_documents(docs.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(300, 400)] + [(7, 7)]
    links += [(rng.randrange(50), rng.randrange(50)) for _ in range(25)] + [(None, 3)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    real = [(a, b) for a, b in links if a is not None and a != b]
    expected = plain_roots({n for pair in real for n in pair}, real)
    assert {r.node: r.root for r in found} == expected and len(found) == len(expected)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = compression.WORDS.findall(lower)
    if not words:
        return 0
    parts = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_equals_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {doc_id: plain_fingerprint(text) for doc_id, text in docs.items()}
    pairs = itertools.combinations(sorted(docs), 2)
    roots = plain_roots(docs, [(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 2])
    rows = QUERIES["op9_simhash_bytes"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        doc_id: (f"{prints[doc_id]:016x}", roots[doc_id]) for doc_id in docs
    }


@pytest.mark.parametrize("list_pairs", [0, 4, 10_000])
@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_links_of_dense_lists_equal_all_pairs(spark, list_pairs, max_bits):
    rng = random.Random(max_bits)
    centres = [rng.getrandbits(64) for _ in range(3)] + [0, (1 << 64) - 1]
    values = set()
    for centre in centres:
        for _ in range(40):
            value = centre
            for _ in range(rng.randint(0, 4)):
                value ^= 1 << rng.randrange(64)
            values.add(value - (1 << 64) if value >> 63 else value)
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    found = simhash_bytes.links(prints, max_bits, list_pairs).collect()
    close = [
        (a, b)
        for a, b in itertools.combinations(values, 2)
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= max_bits
    ]
    assert plain_roots(values, [(r.a, r.b) for r in found]) == plain_roots(values, close)


def test_simhash_kept_documents(spark):
    rows = [(3, "a b c d"), (1, "A B C D"), (1, "a b c d"), (None, None), (None, " "), (8, "z")]
    docs = spark.createDataFrame(
        [(*row, "f", "r", 5, "keep me") for row in rows],
        "doc_id long, text string, fp string, root string, row int, tractwise_row string",
    )
    kept = simhash_bytes.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {tuple(r)[2:] for r in kept.collect()} == {("f", "r", 5, "keep me")}
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "8", "None"]
    assert simhash_bytes.kept_documents(docs.limit(0)).count() == 0


def test_hot_joins_have_shuffles_of_their_own(spark, monkeypatch):
    """Aggregates are stored before they are joined, so that a hot key can be split."""
    plans = []
    real = simhash_bytes.stored

    def seen(frame, name):
        if name in ("lists", "large-stars", "stars"):
            plans.append((name, frame._jdf.queryExecution().optimizedPlan().toString()))
        return real(frame, name)

    monkeypatch.setattr(simhash_bytes, "stored", seen)
    monkeypatch.setattr("tractwise.llm.components.stored", seen)
    prints = spark.createDataFrame([(i,) for i in range(8)], "fp long")
    components(simhash_bytes.links(prints))
    assert {name for name, _ in plans} == {"lists", "large-stars", "stars"}
    for _, plan in plans:
        _, _, below = plan.partition("Join Inner")
        assert below and "Aggregate" not in below


def test_shared_folder_is_a_setting_on_a_cluster(spark):
    from tractwise.llm import common

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({key.replace("_", "."): value for key, value in conf.items()})

    assert common.shared_folder(Session(spark_master="local[4]"), "x").startswith("file://")
    given = Session(spark_master="yarn", **{"spark_checkpoint_dir": "hdfs://c/"})
    assert common.shared_folder(given, "x").startswith("hdfs://c/x-")
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://host:1"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_folder(Session(spark_master=master), "x")


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_bounds_have_the_least_padding():
    rng = random.Random(4)
    for _ in range(40):
        lengths = [rng.randint(0, 12) for _ in range(30)]
        for buckets in (1, 2, 4, 20):
            found = length_buckets.bounds(Counter(lengths), buckets)
            size = min(buckets, len(set(lengths)))
            options = itertools.combinations(sorted(set(lengths)), size)
            best = min(padding(lengths, o) for o in options if o[-1] == max(lengths))
            assert len(found) == size and padding(lengths, found) == best


def test_packing_equals_plain_packing(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 5, 31, 32, 33, 200]), i) for i in range(300)]
    lengths = spark.createDataFrame(rows, "doc_id long, n_tokens long, tie long")
    packed = length_buckets.packed(lengths, context=32, buckets=3, budget=70).collect()
    pieces = []
    for doc_id, size, tie in rows:
        size = size or 0
        for piece in range(max(1, -(-size // 32))):
            part = min(32, size - 32 * piece)
            pieces.append((doc_id is not None, doc_id or 0, tie, piece, part))
    bounds = length_buckets.bounds(Counter(p[-1] for p in pieces), 3)
    expected, seen = [], Counter()
    for given, doc_id, _, piece, part in sorted(pieces):
        bucket = next(k for k, b in enumerate(bounds) if b >= part)
        per = 70 // max(1, bounds[bucket])
        place, seen[bucket] = seen[bucket], seen[bucket] + 1
        expected.append(
            (doc_id if given else None, piece, 32 * piece, part, bucket, bounds[bucket], place // per, place % per)
        )
    assert Counter(map(tuple, packed)) == Counter(expected)
    assert length_buckets.packed(lengths.limit(0)).count() == 0
    with pytest.raises(ValueError):
        length_buckets.packed(lengths, context=32, budget=31)


def plain_url(url):
    if not url or "://" not in url:
        return "", "", None, None
    after = url.split("://", 1)[1]
    host = re.match("[^/?#]*", after)[0]
    path = re.match("[^?#]*", after[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        r
        for r in URL_RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_url_query_keeps_fixed_rules(spark):
    rows = QUERIES["op4_url_rules"](spark, MEDIUM).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for row in rows:
        host, path, rule, verdict = plain_url(urls[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict in ("allow", "block") and verdict in (None, row.verdict)


def plain_tokens(url):
    host, path, _, _ = plain_url(url)
    rest = (url or "").split("://", 1)[-1] if "://" in (url or "") else ""
    rest = re.sub("^[^?#]*", "", rest)
    names = re.findall("[?&]([^=&#]*)", rest)
    fragment = rest.split("#", 1)[1] if "#" in rest else ""
    kinds = {"host": host.split("."), "path": path.split("/"), "query": names, "fragment": [fragment]}
    return {f"{k}:{re.sub('[0-9]+', '0', v)}" for k, vs in kinds.items() for v in vs if v}


def plain_mined(labelled, mining):
    """Combinations that mark bad pages, by counting every combination of every page."""
    labelled = [(sorted(tokens), bad) for tokens, bad in labelled if tokens]
    count, bad_count = len(labelled), sum(bad for _, bad in labelled)
    seen, bad_seen = Counter(), Counter()
    for tokens, bad in labelled:
        for size in range(1, len(tokens) + 1):
            for some in itertools.combinations(tokens, size):
                seen[some] += 1
                bad_seen[some] += bad
    base, z, rules = bad_count / count, mining.z, {}
    for some, n in seen.items():
        bad = bad_seen[some]
        share = bad / n
        if bad < max(mining.support * count, mining.pages) or share < base:
            continue
        margin = z * (share * (1 - share) / n + z * z / (4 * n * n)) ** 0.5
        if (share + z * z / (2 * n) - margin) / (1 + z * z / n) > base:
            rules[frozenset(some)] = (bad / count, share, share / base)
    return {k: v for k, v in rules.items() if not any(other < k for other in rules)}


def test_mined_rules_equal_a_plain_miner(spark):
    """Rules of the given labels, and every verdict that follows from them."""
    found = QUERIES["op4_url_rules"](spark, "/root/testdata/sf0.1").collect()
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").collect()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    bad = {label.doc_id: label.quality == 0 or label.toxic == 1 for label in labels}
    labelled = [(plain_tokens(p.url), bad[p.page_id]) for p in pages if p.page_id in bad]
    rules = plain_mined(labelled, url_rules.Mining())
    assert rules
    urls = {page.page_id: page.url for page in pages}
    used = set()
    for row in found:
        tokens = plain_tokens(urls[row.page_id])
        fits = {rule: known for rule, known in rules.items() if rule <= tokens}
        assert (row.mined_rule is not None) == bool(fits)
        if fits:
            rule = frozenset(row.mined_rule.split(" "))
            used.add(rule)
            assert max(known[1] for known in fits.values()) == pytest.approx(row.confidence)
            known = (row.support, row.confidence, row.lift)
            assert known == pytest.approx(fits[rule])
        if row.rule is None:
            assert row.verdict == ("block" if fits else "allow")
    assert used and any(r.verdict == "block" and r.rule is None for r in found)


def test_mined_rules_block_what_labels_show(spark):
    odd = [None, "", "none", "x://", "http://COM/", "http://a.com", "ftp://b.net/es/1?q#f", "://com/"]
    urls = [f"http://h{i % 7}.org/{'casino' if i % 3 == 0 else 'news'}/{i}" for i in range(300)]
    rows = list(enumerate(urls + odd)) + [(0, urls[0]), (None, urls[0]), (None, None)]
    pages = spark.createDataFrame(
        [(*r, "t", "x", "v", 0.5) for r in rows],
        "page_id long, url string, tokens string, host string, verdict string, lift double",
    )
    labels = spark.createDataFrame(
        [(i, i % 3 == 0) for i in range(200)] + [(1, None), (None, True), (3, False)],
        "page_id long, bad boolean",
    )
    found = url_rules.judged(pages, labels, URL_RULES).collect()
    assert len(found) == len(rows)
    expected = Counter()
    for page_id, url in rows:
        host, path, rule, verdict = plain_url(url)
        mined = "block" if url and "/casino/" in url else "allow"
        expected[page_id, host, path, rule, verdict or mined] += 1
    assert Counter(tuple(row)[:5] for row in found) == expected
    assert {row.mined_rule for row in found} == {None, "path:casino"}
    few = url_rules.Mining(tokens=0)
    assert {r.mined_rule for r in url_rules.judged(pages, labels, URL_RULES, few).collect()} == {None}
    none = labels.limit(0)
    assert {r.verdict for r in url_rules.judged(pages.limit(9), none, URL_RULES).collect()} == {"allow"}
    assert url_rules.judged(pages.limit(0), labels, URL_RULES).count() == 0


def luhn(digits):
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def plain_spans(text):
    text = text or ""
    digits = lambda value: re.sub("[^0-9]", "", value)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            lambda v: all(int(part) <= 255 for part in v.split(".")),
        ),
        "card": (
            r"[0-9]([\x20-]?[0-9])+",
            lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v)),
        ),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    }
    return {
        kind: [(m.start(), m.end()) for m in re.finditer(pattern, text) if valid(m[0])]
        for kind, (pattern, valid) in kinds.items()
    }


def base_text(spans):
    return ",".join(f"{kind}:{a}:{b}" for kind, found in spans.items() for a, b in found)


def test_pii_query_has_all_base_spans(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = QUERIES["op5_contextual_pii"](spark, MEDIUM).collect()
    assert len(rows) == len(texts)
    for row in rows:
        spans = plain_spans(texts[row.doc_id])
        base = base_text(spans)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [len(s) for s in spans.values()]
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert row.spans.startswith(base)


def test_pii_on_random_and_odd_texts(spark):
    rng = random.Random(8)
    pools = ["a.@b-1 ", "1.2 3", "0123456789 -", "+1() .-2", "é😀a@b.c 4111111111111111 +12345678901"]
    texts = ["".join(rng.choices(rng.choice(pools), k=rng.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "1" * 50_000, "a" * 50_000, "1.1.1.1 " * 3000, "+1" + "(" * 20_000, "a.b@" * 9000]
    docs = spark.createDataFrame([(i // 2, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    found = contextual_pii.with_spans(docs.withColumn("t0", F.col("text")), "doc_id", "t0").select(
        "doc_id", "t0", contextual_pii.spans_text(*contextual_pii.KINDS).alias("spans")
    )
    expected = Counter((i // 2, t, base_text(plain_spans(t))) for i, t in enumerate(texts))
    assert Counter(map(tuple, found.collect())) == expected
    assert contextual_pii.with_spans(docs.limit(0), "doc_id").count() == 0


def test_candidates_of_long_runs_take_linear_time(spark):
    """The plain version is left out: its expressions take square time here."""
    texts = ["-" * 400_000, "a-" * 200_000, "1 " * 200_000 + "5x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = contextual_pii.with_spans(docs, "doc_id").collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2]
    assert not any(r[kind] for r in rows for kind in (*contextual_pii.KINDS, contextual_pii.FOUND))


def test_contexts_find_unseen_identifiers(spark):
    rows = []
    for i in range(60):
        rows.append((i, f"some words and member number: +1 555 010 {1000 + i} then more"))
        rows.append((100 + i, f"in that long year {20000 + i} there were many"))
    rows.append((500, "her member number: AB-7712345 was lost"))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars int, found string")
    clean = {r.doc_id: r for r in contextual_pii.redacted(docs).collect()}
    assert contextual_pii.redacted(docs).columns == docs.columns
    assert clean[500].text == "her member number: <FOUND> was lost"
    assert clean[0].text == "some words and member number: <PHONE> then more"
    assert clean[0].n_chars == len(clean[0].text)
    assert clean[110].text == rows[21][1]


def plain_patterns(left, right):
    def words(text):
        return [w for w in re.split(r"[\s\"'=:()\[\]<>,;|]+", text.lower()) if w]

    before, behind = words(left), words(right)
    found = []
    if before:
        found.append("1 " + before[-1])
    if len(before) > 1:
        found.append("2 " + " ".join(before[-2:]))
    if before and behind:
        found.append(f"3 {before[-1]} _ {behind[0]}")
    return {re.sub("[0-9]+", "0", pattern) for pattern in found}


def plain_bootstrap(spans, bootstrap):
    """spans: (value, left, right, is seed). Scores of patterns after all rounds."""
    edges = defaultdict(dict)
    for value, left, right, seed in spans:
        for pattern in plain_patterns(left, right):
            old = edges[pattern].get(value.lower(), 0.0)
            edges[pattern][value.lower()] = max(old, float(seed))
    known = {i for instances in edges.values() for i, seed in instances.items() if seed}
    best, z = {}, bootstrap.z
    for _ in range(bootstrap.rounds):
        scores = {}
        for pattern, instances in edges.items():
            n = len(instances)
            share = sum(1.0 if i in known else best.get(i, 0.0) for i in instances) / n
            margin = z * (share * (1 - share) / n + z * z / (4 * n * n)) ** 0.5
            scores[pattern] = (share + z * z / (2 * n) - margin) / (1 + z * z / n)
        best = {}
        for pattern, instances in edges.items():
            for i in instances:
                if scores[pattern] >= bootstrap.confidence:
                    best[i] = max(best.get(i, 0.0), scores[pattern])
    return scores


def graph_rows():
    """Codes behind a key word, again behind a second word with unknown ones, and these behind
    a third with yet others."""
    rng = random.Random(12)
    codes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(400)]
    unknown = [f"{9000000 + i}" for i in range(60)]
    rows = [(i, f'the token = "{code}" was sent') for i, code in enumerate(codes)]
    rows += [(1000 + i, f"signed with stamp {code} at noon") for i, code in enumerate(codes + unknown)]
    rows += [(2000 + i, f"she wore badge {code} today") for i, code in enumerate(codes[:60] + unknown)]
    rows += [(3000 + i, f"she wore badge {7000000 + i} today") for i in range(2)]
    rows += [(4000 + i, f"in the year {10000 + i} there were") for i in range(80)]
    return rows


def test_pattern_scores_equal_plain_rounds(spark):
    docs = spark.createDataFrame(graph_rows(), "doc_id long, text string")
    rows = contextual_pii.scanned(docs, "doc_id")
    spans = []
    for row in rows.collect():
        for kind in contextual_pii.KINDS:
            spans += [(s.value, s.left, s.right, True) for s in row[kind]]
        for s in row.candidates:
            word = re.split(r"[\s\"'=:]+", s.left.lower().rstrip(" \"'=:"))[-1]
            spans.append((s.value, s.left, s.right, word == "token" and len(s.value) >= 20))
    results = []
    for rounds in (1, 2, 3):
        bootstrap = contextual_pii.Bootstrap(rounds=rounds)
        found = contextual_pii.scored_patterns(contextual_pii.graph(rows), bootstrap).collect()
        scores = {r.pattern: r.score for r in found}
        assert scores == pytest.approx(plain_bootstrap(spans, bootstrap))
        results.append({p for p, score in scores.items() if score >= bootstrap.confidence})
    # the third word needs what the second has shown
    assert "0 stamp" in results[0] and "0 badge" not in results[0]
    assert "0 badge" in results[1] and "0 year" not in results[2]
    found = contextual_pii.with_spans(docs, "doc_id").filter("size(found) > 0")
    ids = {r.doc_id for r in found.collect()}
    assert ids == {*range(400), *range(1000, 1460), *range(2000, 2120), 3000, 3001}


def test_credentials_of_the_given_texts_are_found(spark):
    path = "/root/testdata/sf0.1/documents.parquet"
    docs = spark.read.parquet(path).select("doc_id", "text").collect()
    secrets = {
        d.doc_id: [(m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', d.text or "", re.I)]
        for d in docs
    }
    rows = QUERIES["op5_contextual_pii"](spark, "/root/testdata/sf0.1").collect()
    caught = 0
    for row in rows:
        found = re.findall(r"found:(\d+):(\d+)", row.spans)
        assert {(int(a), int(b)) for a, b in found} >= set(secrets[row.doc_id])
        caught += bool(found)
        if found:
            assert secrets[row.doc_id], row.doc_id
    assert caught > 100


def test_columns_to_keep_may_have_inner_names(spark):
    docs = spark.createDataFrame(
        [(1, 'token = "a1b2c3d4e5f6a7b8c9d0e1f2"', 7, "t", "a", "c", "k", 5)],
        "doc_id long, text string, row long, t string, all string, candidates string, kept string, pattern int",
    )
    names = [name for name in docs.columns if name != "text"]
    [row] = contextual_pii.with_spans(docs, *names).collect()
    assert tuple(row)[:7] == (1, 7, "t", "a", "c", "k", 5) and len(row.found) == 1
    with pytest.raises(ValueError, match="email"):
        contextual_pii.with_spans(docs.withColumn("Email", F.lit(1)), "Email")


def test_pipeline_equals_plain_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    judge = compression.Judge(compression.Bands())
    docs = [d for d in docs if judge(d.text)[-1]]
    last = {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        last[stream_dedup.normalised(d.text)] = d
    docs = {d.doc_id: d.text for d in last.values()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    pairs = itertools.combinations(docs, 2)
    roots = plain_roots(docs, [(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 2])
    kept = {i for i in docs if roots[i] == i}
    found = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == kept
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.read.parquet(f"{SMALL}/documents.parquet")
        assert stage(spark, frame, SMALL).columns == frame.columns, name
        assert stage(spark, frame.limit(0), SMALL).count() == 0, name
