"""URL filters by a sort-merge range join over reversed-host keys.

A host such as ``www.example.com`` has the canonical key ``com.example.www.``.  A rule's host key is a prefix of the keys of the host and of all its
subdomains, so a rule is an interval of keys, and intervals of different rules either nest or are disjoint.  A sweep in key order therefore needs
only a stack of the rules that are still open.  In Spark the sweep is a window in key order over the union of rule starts and urls:
the last rule that started at or before a url carries its stack (itself and the rules that enclose it); rules whose interval has ended are
popped by a prefix test, and the longest open rule whose path prefixes the url's path decides.

The sweep runs in many buckets that deal rows evenly, whatever the hosts, so a host with a third of all urls is no hot key.  Each bucket
gets a copy of the rules, as long as these are at most ``MAX_SWEPT_RULES``; larger rule sets are equi-joined through the (few) suffixes of each
distinct host.  Only DataFrame functions are used.

Defined results: a null url, or one without ``://``, has an empty host and an empty path and meets no rule; a url that meets no rule gets
``default`` (allow).  Where several rules fit, the longest ``host + path`` wins, then the longer host, then ``block`` before ``allow``.
Empty tables give empty results; repeated rows are judged alike; columns of ``pages`` other than ``page_id`` and ``url`` are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, require

#: Beyond this number of rules the sweep's copies per bucket are given up for an equi-join over host suffixes.
MAX_SWEPT_RULES = 10_000
BUCKETS_PER_PARTITION = 16

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.com`` -> ``com.example.www.``; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def _prepared(rules: DataFrame) -> DataFrame:
    """One row per rule host: its key, and its own rules, longest path first."""
    require(rules, "host", "path", "verdict")
    r = rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v")).where("h <> ''")
    r = r.groupBy("h", "p").agg(F.max("v").alias("v"))  # 'block' sorts after 'allow'
    r = r.withColumn("key", host_key(F.col("h")))
    own = F.struct((F.length("h") + F.length("p")).alias("size"), F.length("h").alias("host_size"), "v", "h", "p", "key")
    return r.groupBy("key").agg(F.collect_list(own).alias("own"))


def _chains(prepared: DataFrame) -> DataFrame:
    """The stack at each rule host: its rules and those of the hosts that enclose it (an equi-join over the key's own prefixes)."""
    levels = F.expr("transform(sequence(1, size(split(key, '[.]')) - 1), i -> concat(array_join(slice(split(key, '[.]'), 1, i), '.'), '.'))")
    up = prepared.select("key", F.explode(levels).alias("outer_key"))
    outer = prepared.select(F.col("key").alias("outer_key"), F.col("own").alias("outer_own"))
    return up.join(outer, "outer_key").groupBy("key").agg(F.flatten(F.collect_list("outer_own")).alias("stack"))


def _decide(stack: Column, key: Column, path: Column) -> Column:
    """The longest rule of the stack that is still open at ``key`` and whose path fits."""
    fits = F.filter(stack, lambda r: F.startswith(key, r["key"]) & F.startswith(path, r["p"]))
    return F.array_max(fits)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_swept_rules: int = MAX_SWEPT_RULES) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict."""
    require(pages, "page_id", "url")
    spark = pages.sparkSession
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    chains = _chains(_prepared(rules))
    found = _swept(urls, chains, partitions(spark) * BUCKETS_PER_PARTITION) if rules.count() <= max_swept_rules else _joined(urls, chains)
    hit = _decide(F.col("stack"), F.col("key"), F.col("path"))
    out = found.withColumn("hit", hit)
    return out.select(
        "page_id", "host", "path",
        F.concat(F.col("hit.h"), F.col("hit.p")).alias("rule"),
        F.coalesce(F.col("hit.v"), F.lit(default)).alias("verdict"),
    )


def _swept(urls: DataFrame, chains: DataFrame, buckets: int) -> DataFrame:
    """The sweep: in each bucket, rule starts and urls in key order; the last start at or before a url brings its stack."""
    from pyspark.sql import Window

    starts = chains.select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "key", F.lit(0).alias("kind"),
        F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack",
    )
    rows = urls.select(
        F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int").alias("bucket"), "key", F.lit(1).alias("kind"),
        "page_id", "host", "path", F.lit(None).cast(chains.schema["stack"].dataType).alias("stack"),
    )
    w = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return starts.unionByName(rows).withColumn("stack", F.last("stack", ignorenulls=True).over(w)).where("kind = 1")


def _joined(urls: DataFrame, chains: DataFrame) -> DataFrame:
    """For rule sets too large to copy: each distinct host finds its longest known suffix; hosts then join back to urls (AQE splits a hot host)."""
    hosts = urls.select("key").distinct()
    levels = F.expr("transform(sequence(1, greatest(size(split(key, '[.]')) - 1, 1)), i -> concat(array_join(slice(split(key, '[.]'), 1, i), '.'), '.'))")
    inner = chains.select(F.col("key").alias("rule_key"), "stack")
    best = hosts.select("key", F.explode(levels).alias("rule_key")).join(inner, "rule_key").groupBy("key").agg(F.max_by("stack", F.length("rule_key")).alias("stack"))
    return urls.join(best, "key", "left")
