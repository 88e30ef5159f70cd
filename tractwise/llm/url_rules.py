"""URL filter: fixed rules, then association rules mined from labelled pages.

A URL becomes a set of tokens: parts of the host, segments of the path, names in the
query, the fragment. FP-growth finds combinations of tokens that are frequent among
labelled pages, and rules "combination -> bad" that are frequent and reliable enough
block a URL. How reliable that is, is measured against the share of bad pages among all
labelled ones: the lower bound (Wilson) of a rule's confidence must lie above it. Rules that
need more than a shorter rule needs are left out.

To match, each rule is filed under its rarest token, and each distinct URL looks up its
own tokens; the other tokens of a rule are then compared as sets. So a token that stands
in most URLs is looked up only for rules that have no rarer one.

DataFrame and SQL functions only.

Nulls: a null URL, or one without ``://``, has empty host and path, no tokens, and is
allowed unless a rule says otherwise. Labels that are null are ignored; a page with
several labels is bad if one says so. Repeated rows get equal verdicts. Without labels
there are no rules; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractwise.llm.common import ascii_lower, stored

BAD = "label:bad"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Mining:
    """Which rules count: least share and number of labelled pages that have a combination
    and are bad, least confidence, z of its lower bound, which must exceed the share of bad
    pages among all, and most tokens (None: any number)."""

    support: float = 0.005
    pages: int = 10
    confidence: float = 0.0
    z: float = 2.33
    tokens: int | None = None


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host, path and rest (from ``?`` or ``#`` on) to rows with ``url``."""
    at = F.instr("url", F.lit("://"))
    after = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise("")
    return (
        pages.withColumn("after", F.coalesce(after, F.lit("")))
        .withColumn("host", F.regexp_extract("after", "^[^/?#]*", 0))
        .withColumn("behind", F.substring("after", F.length("host") + 1, F.length("after")))
        .withColumn("path", F.regexp_extract("behind", "^[^?#]*", 0))
        .withColumn("rest", F.substring("behind", F.length("path") + 1, F.length("behind")))
        .withColumn("host", ascii_lower(F.col("host")))
        .drop("after", "behind")
    )


def _named(kind: str, values: Column) -> Column:
    full = F.filter(values, lambda value: value != "")
    return F.transform(
        full, lambda value: F.concat(F.lit(kind), F.regexp_replace(value, "[0-9]+", "0"))
    )


def with_tokens(pages: DataFrame) -> DataFrame:
    """Adds ``tokens``, the sorted set of a URL's tokens, to rows with host, path and rest."""
    names = F.regexp_extract_all("rest", F.lit("[?&]([^=&#]*)"), 1)
    fragment = F.array(F.regexp_extract("rest", "#(.*)$", 1))
    return pages.withColumn(
        "tokens",
        F.array_sort(
            F.array_distinct(
                F.concat(
                    _named("host:", F.split("host", r"\.")),
                    _named("path:", F.split("path", "/")),
                    _named("query:", names),
                    _named("fragment:", fragment),
                )
            )
        ),
    )


def fixed_rule(rules: tuple[Rule, ...], name: bool) -> Column:
    """Name or verdict of the longest rule that fits, NULL if none does."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: len(rule.name)):
        fits = (F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))
        fits = fits & F.startswith("path", F.lit(rule.path))
        chosen = F.when(fits, rule.name if name else rule.verdict).otherwise(chosen)
    return chosen


#: What is known of a mined rule: its tokens as text, the share of labelled pages that have
#: them and are bad, the share of bad ones among those that have them, and how many times
#: this is the share among all.
MINED = ("mined_rule", "support", "confidence", "lift")


def mined(labelled: DataFrame, mining: Mining) -> DataFrame:
    """(rule, tokens, key, support, confidence, lift): combinations of tokens that mark bad
    pages; ``key`` is the rarest of them.

    ``labelled`` has ``tokens`` and ``bad``. The number of rules is bounded by the support,
    not by the number of pages.
    """
    spark = labelled.sparkSession
    kind = "rule long, tokens array<string>, support double, confidence double, lift double"
    none = spark.createDataFrame([], f"{kind}, key string")
    baskets = stored(
        labelled.filter(F.size("tokens") > 0).select(
            F.concat(
                "tokens", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array())
            ).alias("items"),
            "bad",
        ),
        "baskets",
    )
    count, bad = baskets.agg(F.count("*"), F.count_if("bad")).first()
    if not bad or bad < mining.pages:
        return none
    base, z = bad / count, mining.z
    support = max(mining.support, mining.pages / count)
    model = FPGrowth(minSupport=support, minConfidence=max(mining.confidence, base)).fit(baskets)
    share = F.col("confidence")
    n = F.col("support") * count / share
    margin = F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) * z
    bound = (share + z * z / (2 * n) - margin) / (1 + z * z / n)
    found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    if mining.tokens is not None:
        found = found.filter(F.size("antecedent") <= mining.tokens)
    rules = stored(
        found.filter(bound > base)
        .select(F.array_sort("antecedent").alias("tokens"), "support", "confidence", "lift")
        .withColumn("rule", F.xxhash64("tokens")),
        "rules",
    )
    single = model.freqItemsets.filter(F.size("items") == 1).select(
        F.element_at("items", 1).alias("token"), "freq"
    )
    rarest = (
        rules.select("rule", F.explode("tokens").alias("token"))
        .join(single, "token")
        .groupBy("rule")
        .agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    )
    needless = (
        rules.alias("long")
        .select("rule", "tokens", F.explode("tokens").alias("key"))
        .join(
            rules.select("rule", F.col("tokens").alias("fewer")).join(rarest, "rule").drop("rule"),
            "key",
        )
        .filter(F.size("fewer") < F.size("tokens"))
        .filter(F.size(F.array_except("fewer", "tokens")) == 0)
        .select("rule")
    )
    kept = rules.join(rarest, "rule").join(needless, "rule", "left_anti")
    return kept.select("rule", "tokens", "support", "confidence", "lift", "key")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct URLs (url, tokens) to which mined rules apply, with the most confident of them;
    of equal ones the last by its tokens."""
    text = F.array_join("needed", " ")
    best = F.max_by(
        F.struct(text.alias("mined_rule"), "support", "confidence", "lift"),
        F.struct("confidence", "support", text),
    )
    return (
        urls.select("url", "tokens", F.explode("tokens").alias("key"))
        .join(rules.withColumnRenamed("tokens", "needed"), "key")
        .filter(F.size(F.array_except("needed", "tokens")) == 0)
        .groupBy("url")
        .agg(best.alias("best"))
        .select("url", "best.*")
    )


def judged(
    pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...], mining: Mining = Mining()
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, and the mined rule that fits best
    (see ``MINED``), whether or not a fixed rule comes before it.

    ``labels`` has page_id and bad. The verdict of a mined rule depends on the URL alone,
    so distinct URLs are matched and joined back by URL.
    """
    split = with_tokens(with_parts(pages.select("page_id", "url")))
    known = (
        labels.filter(F.col("bad").isNotNull() & F.col("page_id").isNotNull())
        .groupBy("page_id")
        .agg(F.max("bad").alias("bad"))
    )
    found = mined(split.join(known, "page_id").select("tokens", "bad"), mining)
    urls = split.filter(F.size("tokens") > 0).select("url", "tokens").distinct()
    blocked = stored(matched(urls, found), "blocked")
    verdict = F.coalesce(
        fixed_rule(rules, name=False),
        F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"),
    )
    return split.join(blocked, "url", "left").select(
        "page_id",
        "host",
        "path",
        fixed_rule(rules, name=True).alias("rule"),
        verdict.alias("verdict"),
        *MINED,
    )
