"""Personal data: patterns for known kinds, and contexts learned from them.

Base kinds are found by regular expressions and checked (parts of addresses, Luhn sums,
numbers of digits). They are seeds, and so are candidates, number-like tokens, of which there is
no doubt: long mixed codes behind a key word, and codes with a known prefix (``is_seed``). The
words around a seed are lexical patterns; the same patterns also stand around other
candidates. Patterns and instances form a graph. In turns, a pattern is scored by its
instances and an instance by its best pattern:

- an instance that is a seed has score 1; any other has the score of its best pattern,
- a pattern's score is the lower bound (Wilson) of the share of its distinct instances
  that are private, where each counts with its score.

Candidates that are seeds, or stand in a pattern above ``Bootstrap.confidence``, become spans
of kind ``found``. The bound keeps patterns out that met few instances, whatever their share.

All of it is DataFrame and SQL functions. One pass over the texts writes base spans and
candidates with their contexts to shared storage; the graph is made from that.

Offsets are code points, ends exclusive. Each expression takes linear time on any text:
quantifiers are possessive, and a run of characters is entered at its first one only or
read a bounded way ahead.

Nulls: a null text is an empty one. Rows are told apart by a number they get in the
stored table, so repeated rows and ids need no rule. An empty table gives an empty
result. Columns to keep may have any name but those of the result's kinds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractwise.llm.common import let, stored

#: Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone")
FOUND = "found"

# A match begins where a run begins, or where the last match ended (\G).
PATTERNS = {
    "email": (
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    ),
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Number-like tokens: up to 17 groups of digits with a sign or two between, and codes whose
#: first digit is at most 64 characters in. Both bounds keep long runs out of square time.
CANDIDATE = (
    r"(?<![A-Za-z0-9+])(?:\+?\(?[0-9]++(?:[().\x20-]{1,2}+[0-9]++){0,16}+(?![A-Za-z@_])"
    r"|(?=[A-Za-z_-]{0,64}+[0-9])[A-Za-z0-9]++(?:[-_./:@+][A-Za-z0-9]++)*+)"
)
CANDIDATE_DIGITS = 5

# Words that announce a credential, as ends of the word before it, and beginnings
# of keys that their issuers have published.
KEY_WORD = r"(?:token|secret|password|passwd|pwd|credential|bearer|apikey|(?:api|access|private)[_-]?key)$"
KEY_PREFIX = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\..+)$"

#: A mixed code long enough to be none by chance.
LONG_CODE = r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=.-]{20,}$"

#: Characters kept on either side, and what separates words there.
CONTEXT = 48
SEPARATORS = r"[\s\"'=:()\[\]<>,;|]+"

#: Matches whose lengths are summed together, see ``_starts``.
RUN = 256


@dataclass(frozen=True)
class Bootstrap:
    """Rounds over the graph, least score of a pattern, and z of its lower bound."""

    rounds: int = 3
    confidence: float = 0.75
    z: float = 3.0


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, value: total + value)


def _starts(lengths: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """Calls ``body`` with a function from an index to the sum of the lengths before it.

    Sums run by runs of ``RUN`` lengths, so that many matches do not take square time.
    """
    runs = F.sequence(F.lit(0), F.floor(F.size(lengths) / RUN).cast("int"))
    sums = F.transform(runs, lambda run: _total(F.slice(lengths, run * RUN + 1, RUN)))

    def with_sums(sums: Column) -> Column:
        before = F.transform(sums, lambda _, run: _total(F.slice(sums, 1, run)))

        def with_before(before: Column) -> Column:
            def start(index: Column) -> Column:
                run = F.floor(index / RUN).cast("int")
                inside = F.slice(lengths, run * RUN + 1, index - run * RUN)
                return F.element_at(before, run + 1) + _total(inside)

            return body(start)

        return let(before, with_before)

    return let(sums, with_sums)


SPAN = "array<struct<start:int,stop:int,value:string,left:string,right:string>>"


def matches(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Spans of all matches that are valid, with their values and contexts."""
    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
    )

    def located(found: Column) -> Column:
        gaps, hits = found["gaps"], found["hits"]
        lengths = F.transform(
            hits, lambda hit, at: F.length(hit) + F.length(F.element_at(gaps, at + 1))
        )

        def spans(lengths: Column) -> Column:
            def body(start: Callable[[Column], Column]) -> Column:
                def span(hit: Column, at: Column) -> Column:
                    gap, behind = F.element_at(gaps, at + 1), F.element_at(gaps, at + 2)
                    first = start(at) + F.length(gap)
                    return F.struct(
                        first.alias("start"),
                        (first + F.length(hit)).alias("stop"),
                        hit.alias("value"),
                        F.right(gap, F.lit(CONTEXT)).alias("left"),
                        F.left(behind, F.lit(CONTEXT)).alias("right"),
                    )

                return F.filter(F.transform(hits, span), lambda s: valid(s["value"]))

            return _starts(lengths, body)

        none = F.array().cast(SPAN)
        return F.when(F.size(hits) == 0, none).otherwise(let(lengths, spans).cast(SPAN))

    return let(found, located)


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _luhn(value: Column) -> Column:
    """Does the sum of digits, every second from the right doubled, end in 0?"""

    def check(reverse: Column) -> Column:
        def add(total: Column, at: Column) -> Column:
            digit = F.ascii(F.substring(reverse, at, F.lit(1))) - 48
            doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
            return total + F.when(at % 2 == 0, doubled).otherwise(digit)

        places = F.sequence(F.lit(1), F.length(reverse))
        return F.aggregate(places, F.lit(0), add) % 10 == 0

    return let(F.reverse(F.regexp_replace(value, "[^0-9]", "")), check)


ADDRESS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"

VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda value: F.lit(True),
    "ip": lambda value: F.rlike(value, F.lit(ADDRESS)),
    "card": lambda value: F.when(_digits(value).between(13, 19), _luhn(value)).otherwise(False),
    "phone": lambda value: _digits(value).between(9, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans of a kind; texts that lack its sign are not searched."""
    sign = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    spans = matches(text, PATTERNS[kind], VALID[kind])
    if sign is None:
        return spans
    return F.when(F.contains(text, F.lit(sign)), spans).otherwise(F.array().cast(SPAN))


def scanned(docs: DataFrame, *keep: str) -> DataFrame:
    """The stored result of the one pass: row, kept columns as one struct ``kept``, a column of
    spans for each kind, and ``candidates``: those outside them, and those with one inside, as a
    long code may have digits that look like a card."""
    text = F.coalesce("text", F.lit(""))
    columns = [base_spans(F.col("t"), kind).alias(kind) for kind in KINDS]
    kept = F.struct(*[F.col(f"`{name}`") for name in keep]) if keep else F.lit(None)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), kept.alias("kept"), text.alias("t")
    ).select(
        "row",
        "kept",
        *columns,
        matches(F.col("t"), CANDIDATE, lambda v: _digits(v) >= CANDIDATE_DIGITS).alias("all"),
    )
    base = F.concat(*KINDS)

    def outside(candidate: Column) -> Column:
        def in_the_way(b: Column) -> Column:
            meets = (b["start"] < candidate["stop"]) & (candidate["start"] < b["stop"])
            inside = (candidate["start"] <= b["start"]) & (b["stop"] <= candidate["stop"])
            longer = candidate["stop"] - candidate["start"] > b["stop"] - b["start"]
            return meets & ~(inside & longer)

        return ~F.exists(base, in_the_way)

    return stored(
        rows.withColumn("candidates", F.filter("all", outside)).drop("all"), "scanned"
    )


def _words(context: Column) -> Column:
    return F.filter(F.split(F.lower(context), SEPARATORS), lambda word: word != "")


def is_seed(span: Column) -> Column:
    """Is a candidate a credential by its prefix, or by its length and the word before it?"""
    before = F.coalesce(F.try_element_at(_words(span["left"]), F.lit(-1)), F.lit(""))
    announced = F.rlike(before, F.lit(KEY_WORD)) & F.rlike(span["value"], F.lit(LONG_CODE))
    return announced | F.rlike(span["value"], F.lit(KEY_PREFIX))


def patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of a place: the word before, the two before, the words around.

    Digits in them count as one sign. A place without a word on the left has none.
    """

    def of_words(words: Column) -> Column:
        before, behind = words["before"], words["behind"]
        one = F.try_element_at(before, F.lit(-1))
        two = F.concat_ws(" ", F.try_element_at(before, F.lit(-2)), one)
        around = F.concat_ws(" _ ", one, F.try_element_at(behind, F.lit(1)))
        some, both = F.size(before) > 0, F.size(before) > 1
        return F.filter(
            F.array(
                F.when(some, F.concat(F.lit("1 "), one)),
                F.when(both, F.concat(F.lit("2 "), two)),
                F.when(some & (F.size(behind) > 0), F.concat(F.lit("3 "), around)),
            ),
            lambda pattern: pattern.isNotNull(),
        )

    words = F.struct(_words(left).alias("before"), _words(right).alias("behind"))
    return F.transform(
        let(words, of_words), lambda pattern: F.regexp_replace(pattern, "[0-9]+", "0")
    )


def graph(rows: DataFrame) -> DataFrame:
    """Distinct (pattern, instance, seed). Equal values are one instance, so a text that is
    repeated many times has no more weight than one, and a value that is a seed in one place
    is one everywhere."""
    seeds = rows.select(F.explode(F.concat(*KINDS)).alias("s")).withColumn("seed", F.lit(1.0))
    others = rows.select(F.explode("candidates").alias("s"))
    others = others.withColumn("seed", is_seed(F.col("s")).cast("double"))
    edges = (
        seeds.unionByName(others)
        .select(
            F.explode(patterns(F.col("s.left"), F.col("s.right"))).alias("pattern"),
            F.lower("s.value").alias("instance"),
            "seed",
        )
        .groupBy("pattern", "instance")
        .agg(F.max("seed").alias("here"))
    )
    known = edges.groupBy("instance").agg(F.max("here").alias("seed"))
    return edges.join(known, "instance").select("pattern", "instance", "seed")


def scored_patterns(edges: DataFrame, bootstrap: Bootstrap) -> DataFrame:
    """(pattern, score) after some rounds over the stored graph."""
    z = bootstrap.z
    scores = edges.withColumn("score", F.col("seed"))
    for turn in range(bootstrap.rounds):
        share = F.sum("score") / F.count("*")
        n = F.count("*")
        margin = F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) * z
        bound = (share + z * z / (2 * n) - margin) / (1 + z * z / n)
        rated = stored(scores.groupBy("pattern").agg(bound.alias("bound")), f"patterns{turn}")
        if turn + 1 < bootstrap.rounds:
            best = (
                edges.filter("seed < 1")
                .join(rated, "pattern")
                .groupBy("instance")
                .agg(F.max("bound").alias("best"))
            )
            scores = edges.join(best, "instance", "left").withColumn(
                "score",
                F.when(F.col("seed") == 1, 1.0)
                .when(F.col("best") >= bootstrap.confidence, F.col("best"))
                .otherwise(0.0),
            )
    return rated.select("pattern", F.col("bound").alias("score"))


def discovered(rows: DataFrame, bootstrap: Bootstrap = Bootstrap()) -> DataFrame:
    """(row, found): spans of candidates that are seeds or stand in a pattern of high
    confidence."""
    edges = stored(graph(rows), "graph")
    good = scored_patterns(edges, bootstrap).filter(F.col("score") >= bootstrap.confidence)
    candidates = rows.select("row", F.explode("candidates").alias("s"))
    places = candidates.select(
        "row", "s", F.explode(patterns(F.col("s.left"), F.col("s.right"))).alias("pattern")
    )
    span = F.struct("s.start", "s.stop")
    return (
        places.join(good, "pattern")
        .select("row", "s")
        .unionByName(candidates.filter(is_seed(F.col("s"))))
        .groupBy("row")
        .agg(F.array_sort(F.collect_set(span)).alias(FOUND))
    )


def with_spans(docs: DataFrame, *keep: str, bootstrap: Bootstrap = Bootstrap()) -> DataFrame:
    """Kept columns, and an array (start, stop) of spans for each kind and ``found``. Raises
    ValueError if a kept column has the name of one of these."""
    clash = sorted({name.lower() for name in keep} & {*KINDS, FOUND})
    if clash:
        raise ValueError(f"columns to keep are named like results: {clash}")
    rows = scanned(docs, *keep)
    spans = [
        F.transform(kind, lambda s: F.struct(s["start"], s["stop"])).alias(kind) for kind in KINDS
    ]
    none = F.array().cast("array<struct<start:int,stop:int>>")
    kept = [F.col("kept").getField(name).alias(name) for name in keep]
    return (
        rows.select("row", "kept", *spans)
        .join(discovered(rows, bootstrap), "row", "left")
        .select(*kept, *KINDS, F.coalesce(FOUND, none).alias(FOUND))
    )


def spans_text(*kinds: str) -> Column:
    """kind:start:end of all spans, joined by commas."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["stop"]))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def redacted(docs: DataFrame, bootstrap: Bootstrap = Bootstrap()) -> DataFrame:
    """All columns, with every span in ``text`` replaced by its kind in angle brackets and
    ``n_chars`` counted anew. Spans that overlap are one; its kind is that of the first."""
    packed = docs.select("text", F.struct("*").alias("document"))
    rows = with_spans(packed, "document", bootstrap=bootstrap)

    def tagged(kind: str) -> Column:
        return F.transform(
            kind,
            lambda s: F.struct(
                s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind")
            ),
        )

    spans = F.array_sort(F.concat(*map(tagged, (*KINDS, FOUND))))
    text = F.col("document.text")

    def step(done: Column, span: Column) -> Column:
        at = done["at"]
        fresh = span["start"] >= at
        between = F.substring(text, at + 1, span["start"] - at)
        piece = F.array(between, F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">")))
        return F.struct(
            F.greatest(at, span["stop"]).alias("at"),
            F.when(fresh, F.concat(done["parts"], piece)).otherwise(done["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def finish(done: Column) -> Column:
        rest = F.substring(text, done["at"] + 1, F.length(text))
        return F.concat(F.array_join(done["parts"], ""), rest)

    clean = F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, finish))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("clean").alias(name))
        elif name == "n_chars":
            kind = docs.schema[name].dataType
            columns.append(F.length("clean").cast(kind).alias(name))
        else:
            columns.append(F.col("document").getField(name).alias(name))
    return rows.select("document", clean.alias("clean")).select(*columns)
