"""URL filtering by hashed host-suffix and path-prefix expressions.

A URL is expanded into the host's suffixes at label borders times the path's
prefixes. Expressions and rules meet by an equi-join on the first bytes of a
SHA-256 digest; the full digests then confirm a match, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PREFIX = 8  # hex digits: 4 bytes
#: Up to so many rules are broadcast; with 64-digit digests they stay below 4 MB.
BROADCAST_RULES = 20_000


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, action) rows; ``action`` is allow or block."""
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def judge_urls(df: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Each row's ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``n_rules`` that fit.

    A rule fits its host and all subdomains if the path starts with the rule's.
    The longest wins, by host and then by path; of equal rules block wins.
    Without a fitting rule ``rule`` is null and the verdict is ``default``. A null
    URL or one without ``://`` has an empty host and path, which fit no rule with
    a host. Every input row gives one row, repeated ones too; null ids stay null.

    All prefixes of a path are covered: only prefixes as long as some rule's path
    can match, so just those lengths are expanded, and likewise for the numbers of
    host labels. Both are counted from the rules, whose distinct lengths are few.
    Up to ``broadcast_rules`` rules are broadcast, more are shuffled.
    """
    key = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)
    own = rules.where(F.col("host").isNotNull() & F.col("action").isin("allow", "block")).select(F.lower("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("action").alias("r_action"))
    own = own.groupBy("r_host", "r_path").agg(F.max("r_action").alias("r_action")).withColumn("r_digest", key(F.col("r_host"), F.col("r_path")))
    shape = own.agg(F.count("*").alias("n"), F.collect_set(F.length("r_path")).alias("paths"), F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels")).first()
    own = own.withColumn("r_short", F.substring("r_digest", 1, _PREFIX))

    src = F.col(url)
    pages = df.select(F.col(page_id).alias("page_id"), url_host(src).alias("host"), url_path(src).alias("path"))
    pages = pages.withColumn("row", F.monotonically_increasing_id())
    ints = lambda values: F.array(*[F.lit(v) for v in sorted(values)]).cast("array<int>")
    labels = F.split("host", r"\.")
    hosts = F.transform(F.filter(ints(shape["labels"]), lambda n: n <= F.size(labels)), lambda n: F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n)))
    paths = F.transform(F.filter(ints(shape["paths"]), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    digests = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: key(h, p))))
    asked = pages.withColumn("digest", F.explode_outer(digests)).withColumn("short", F.substring("digest", 1, _PREFIX))
    if shape["n"] <= broadcast_rules:
        own = F.broadcast(own)
    # A null short prefix, as of a row without expressions, meets nothing and keeps the row.
    met = asked.join(own, (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest")), "left")
    rank = F.struct(F.length("r_host").alias("h"), F.length("r_path").alias("p"), F.col("r_host").alias("host"), F.col("r_path").alias("path"), F.col("r_action").alias("action"))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(F.col("r_host").isNotNull(), rank)).alias("best"), F.count("r_host").alias("n_rules"))
    return best.select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"), "n_rules")
