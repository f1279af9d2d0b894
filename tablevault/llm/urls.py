"""URL filters: rules by host and path, and boosted trees on lexical features for the urls no rule fits.

The trees learn from urls that rules label. Features: lengths, depth, digit ratios, character entropy of
the host, parameter counts, and how often rules block the urls of the host's suffix, and of suffix and
first part of the path together, counted over all labelled urls. The sample they are fitted on is the ``SAMPLE`` labelled rows with the smallest hash of
their url, a documented bound; everything else covers all rows.

Only DataFrame functions and Spark's own tree learner; urls are scored by a SQL expression of the trees.

Defined results: null urls and urls without ``://`` have empty host and path and no rule; without any
labelled url the verdict is allow; equal urls get equal results; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevault.llm import boosting
from tablevault.llm.common import cut
from tablevault.llm.licenses import LOWER, UPPER

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

SAMPLE = 20_000
SUFFIX_CLASSES, SECTION_CLASSES = 256, 1024
TREES, DEPTH = 12, 3


def with_parts(df: DataFrame, url_col: str) -> DataFrame:
    """Adds ``host``, ``path`` and ``_tail`` (what follows the path)."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.position(F.lit("://"), url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    df = df.withColumn("_rest", rest)
    df = df.withColumn("host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER))
    df = df.withColumn("path", F.regexp_extract(F.substr(F.col("_rest"), F.length("host") + 1), r"^[^?#]*", 0))
    return df.withColumn("_tail", F.substr(F.col("_rest"), F.length("host") + F.length("path") + 1)).drop("_rest")


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(
            F.col("path"), F.lit(slash + path))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rules=RULES) -> Column:
    said = F.lit(None).cast("string")
    for rule, verdict in rules:
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    return said


def suffix_class() -> Column:
    """The class of the host's last two names; a fixed number of classes, however many hosts there are."""
    return F.pmod(F.xxhash64(F.substring_index("host", ".", -2)), F.lit(SUFFIX_CLASSES)).cast("int")


def section_class() -> Column:
    """The class of the host's last two names with the path's first part."""
    first = F.split_part(F.col("path"), F.lit("/"), F.lit(2))
    return F.pmod(F.xxhash64(F.substring_index("host", ".", -2), first), F.lit(SECTION_CLASSES)).cast("int")


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits per character over the hosts' usual characters."""
    total = F.lit(0.0)
    length = F.greatest(F.length(text), F.lit(1)).cast("double")
    for c in "abcdefghijklmnopqrstuvwxyz0123456789.-":
        p = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / length
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return total


def features(*blocked_shares: Column) -> list[Column]:
    host, path, tail = F.col("host"), F.col("path"), F.col("_tail")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    out = [F.length(host), F.length(path), F.length(tail), count(host, "."), count(host, "-"), count(path, "/"),
           count(path, "-"), count(tail, "="), count(tail, "&"), _share(host, "[^0-9]"), _share(path, "[^0-9]"),
           _share(tail, "[^0-9]"), _entropy(host), F.length(F.substring_index(host, ".", 1)),
           F.length(F.substring_index(host, ".", -1)), F.length(F.split_part(path, F.lit("/"), F.lit(2))),
           *blocked_shares]
    return [c.cast("double") for c in out]


def _blocked_share(labelled: DataFrame, column: str, unseen: Column | None = None) -> Column:
    """How often rules block the urls of a class, pulled towards the overall share where the class is small.

    ``unseen`` stands for classes without a labelled url (default: the overall share). The driver gets a row per class, of which there is a fixed number.
    """
    stats = labelled.groupBy(column).agg(F.sum("_label").alias("b"), F.count("*").alias("n")).collect()
    overall = (sum(r["b"] for r in stats) + 1) / (sum(r["n"] for r in stats) + 2)
    if not stats:
        return F.lit(overall)
    shares = F.create_map(*[x for r in sorted(stats) for x in (
        F.lit(r[column]), F.lit(float((r["b"] + 10 * overall) / (r["n"] + 10))))])
    return F.coalesce(shares[F.col(column)], F.lit(float(overall)) if unseen is None else unseen)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """Per row: its id, host, path, rule, verdict and the trees' score (above 0: block)."""
    df = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")), "_url")
    df = df.withColumn("rule", rule_of(rules))
    df = df.withColumn("_said", verdict_of(rules))
    df = df.withColumn("_suffix", suffix_class()).withColumn("_section", section_class())
    labelled = df.filter(F.col("_said").isNotNull()).withColumn("_label", (F.col("_said") == "block").cast("int"))
    suffix = _blocked_share(labelled, "_suffix")
    shares = [suffix, _blocked_share(labelled, "_section", suffix)]
    rows = labelled.orderBy(F.xxhash64("_url"), "_url").limit(sample)
    rows = cut(rows.select(F.array(*features(*shares)).alias("features"), F.col("_label").alias("label")).coalesce(4))
    trees = boosting.fit(rows, TREES, DEPTH)
    names = [f"_f{i}" for i in range(len(features(*shares)))]
    df = df.select("page_id", "host", "path", "rule", "_said", *[c.alias(n) for c, n in zip(features(*shares), names, strict=True)])
    df = df.withColumn("score", boosting.expression(trees, [F.col(n) for n in names]))
    learned = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return df.select("page_id", "host", "path", "rule", F.coalesce("_said", learned).alias("verdict"), "score")
