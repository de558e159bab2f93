"""Contamination scans and shingle joins.

Exact and normalised copies meet by hash.  Similar texts meet by their rarest shingles: sets are ordered by shingle frequency, and a pair that reaches the
threshold must share one of the first n - ceil(t n) + 1, so only those are joined; frequent shingles (licence lines, headers) hardly ever are among
them.  Equal sets are one class throughout, so copies are never paired with one another.  The MinHash variant buckets classes by bands and verifies all candidates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import sets
from ..functions.strings import jaccard, let, normalized, shingles

WIDTH = 5
PERCENT = 80
#: A pair at PERCENT shares no band with a probability of (1 - 0.8**4)**32, below 1e-7.
BANDS, ROWS = 32, 4
#: Pairs are verified in up to BUCKETS squared groups.
BUCKETS = 128
MIN_BYTES = 20
#: Up to so many eval units are sent to all executors; beyond that, both sides are shuffled.
SMALL = 20_000


def tokens(text: Column) -> Column:
    return let(normalized(text), lambda n: F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " ")))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(members: key, class_id; sets: class_id, sh) by equal shingle sets; class_id is the least key.  Texts without a token have no class.

    ``sh`` holds 64-bit hashes: that two shingles of a pair of sets collide has a probability below 1e-10 for sets of 40,000.  Sets are kept on disk, as several steps read them."""

    @F.pandas_udf("struct<sh:array<long>,digest:string>")
    def run(hashes: pd.Series) -> pd.DataFrame:
        rows = [sets.shingled(h, width) for h in hashes]
        return pd.DataFrame({"sh": rows, "digest": [hashlib.sha256(r.tobytes()).hexdigest() for r in rows]})

    words = F.transform(tokens(F.col(text)), lambda w: F.xxhash64(w))
    t = docs.select(F.col(key).alias("__k"), words.alias("w")).where("size(w) > 0").select("__k", run("w").alias("r")).select("__k", "r.*").persist(StorageLevel.DISK_ONLY)
    least = t.groupBy("digest").agg(F.min("__k").alias("class_id"))
    members = t.select("__k", "digest").join(least, "digest").select(F.col("__k").alias(key), "class_id")
    own = t.select("__k", "sh").join(least.select(F.col("class_id").alias("__k")), "__k", "left_semi").select(F.col("__k").alias("class_id"), "sh")
    return members, own.persist(StorageLevel.DISK_ONLY)


def hashed(sets_: DataFrame) -> DataFrame:
    """The same with 64-bit hashes in place of strings."""
    return sets_.withColumn("sh", F.transform("sh", lambda s: F.xxhash64(s))) if sets_.schema["sh"].dataType.elementType.typeName() == "string" else sets_


def similar_sets(sets_: DataFrame, percent: int = PERCENT, key: str = "class_id") -> DataFrame:
    """All pairs a < b of sets with 100 |A n B| >= percent |A u B|, by prefix filtering.

    Any order of the shingles is exact; this one puts the rare first, by counts in a table of fixed size that many shingles share."""
    h = hashed(sets_)
    spark = h.sparkSession
    parts = h.select("sh").mapInArrow(sets.cell_counts, "chunk int, counts binary").groupBy("chunk").applyInPandas(sets.added, "chunk int, counts binary").collect()
    table = np.zeros((sets.CHUNKS, sets.CELLS // sets.CHUNKS), dtype=np.uint32)
    for r in parts:
        table[r["chunk"]] = np.frombuffer(r["counts"], dtype=np.uint32)
    counts = spark.sparkContext.broadcast(table.ravel())

    @F.pandas_udf("array<long>")
    def first(sh: pd.Series) -> pd.Series:
        return sh.map(lambda x: sets.prefix(x, counts.value, percent))

    prefix = h.select(key, F.size("sh").alias("n"), F.explode(first("sh")).alias("s"))
    a, b = prefix.select(F.col(key).alias("a"), F.col("n").alias("na"), "s"), prefix.select(F.col(key).alias("b"), F.col("n").alias("nb"), "s")
    near = a.join(b, "s").where((F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    return verified(near.select("a", "b").distinct(), h, percent, key)


def verified(pairs: DataFrame, sets_: DataFrame, percent: int, key: str = "class_id") -> DataFrame:
    """The pairs that reach ``percent``, with their Jaccard.  Keys are dealt into buckets and pairs into cells of two buckets; a set goes to each of its cells once, not to each pair."""
    h = hashed(sets_)
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    p = pairs.select("a", "b", (bucket("a") * BUCKETS + bucket("b")).alias("cell")).persist(StorageLevel.DISK_ONLY)
    needed = p.select(F.col("a").alias(key), F.col("cell").alias("at")).union(p.select("b", "cell")).distinct()
    own = h.select(key, "sh").join(needed, key)
    kind = h.schema[key].dataType.simpleString()

    def judge(these: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        at = dict(zip(known[key], known["sh"], strict=True))
        rows = []
        for x, y in zip(these["a"], these["b"], strict=True):
            both = len(np.intersect1d(at[x], at[y], assume_unique=True))
            union = len(at[x]) + len(at[y]) - both
            if 100 * both >= percent * union:
                rows.append((x, y, both / union))
        return pd.DataFrame(rows, columns=["a", "b", "jaccard"])

    return p.groupBy("cell").cogroup(own.groupBy("at")).applyInPandas(judge, f"a {kind}, b {kind}, jaccard double")


def lsh_pairs(left: DataFrame, right: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Candidate pairs (a of left, b of right) that agree in a whole band; both have (key, sh)."""

    @F.pandas_udf("array<long>")
    def run(sh: pd.Series) -> pd.Series:
        return sh.map(lambda x: sets.bands(x, bands, rows))

    signed = lambda df: hashed(df).where("size(sh) > 0").select("key", run("sh").alias("bands")).persist(StorageLevel.DISK_ONLY)
    banded = lambda df, name: df.select(F.col("key").alias(name), F.explode("bands").alias("band"))
    a = signed(left)
    return banded(a, "a").join(banded(a if right is left else signed(right), "b"), "band").select("a", "b").distinct()


def linked_classes(docs: DataFrame, pairs: DataFrame, members: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: its class and the number of other classes it is linked with; texts without tokens are a class of their own."""
    ends = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).groupBy("class_id").agg(F.count("*").alias("links"))
    out = docs.select(key).join(members, key, "left").join(ends, "class_id", "left")
    return out.select(key, F.coalesce("class_id", key).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def scan(train: DataFrame, evals: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Contamination of ``evals`` (key, text) by ``train`` (key, text): per eval unit the first stage that hits (exact, normalized, near, contained; else clean),
    the number of train classes it hit, the best Jaccard and the best containment.

    Train units of at least MIN_BYTES normalised bytes count.  The reported containment is the share of the eval unit's shingles found in one train unit."""
    prep = lambda df: df.select("key", "text", normalized(F.col("text")).alias("norm")).where(F.octet_length("norm") >= MIN_BYTES)
    t, e = prep(train), prep(evals)
    small = F.broadcast if evals.count() <= SMALL else lambda df: df

    def stage(c: str) -> DataFrame:
        own = e.select("key", F.sha2(c, 256).alias("h"))
        mine = t.select(F.sha2(c, 256).alias("h")).join(small(own.select("h").distinct()), "h", "left_semi")
        return mine.groupBy("h").agg(F.count("*").alias("hits")).join(own, "h").select("key", "hits")

    exact, norm = stage("text"), stage("norm")
    sh = lambda df: df.select("key", shingles(F.split("norm", " "), width).alias("sh"))
    te, ee = sh(t), sh(e)
    # the eval side is the small one: shingles of train that no eval unit has are dropped before they are shuffled
    own = ee.select(F.col("key").alias("b"), F.size("sh").alias("nb"), F.explode("sh").alias("s"))
    hit = te.select(F.col("key").alias("a"), F.size("sh").alias("na"), F.explode("sh").alias("s")).join(small(own), "s")
    both = hit.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    best = both.groupBy("b").agg(
        F.max(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"),
        F.max(F.col("both") / F.col("nb")).alias("containment"),
        F.sum(F.when(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")), 1).otherwise(0)).alias("near"),
    ).withColumnRenamed("b", "key")
    out = e.select("key").join(exact.withColumnRenamed("hits", "exact"), "key", "left").join(norm.withColumnRenamed("hits", "normalized"), "key", "left").join(best, "key", "left")
    kind = F.when(F.col("exact") > 0, "exact").when(F.col("normalized") > 0, "normalized").when(F.col("near") > 0, "near").when(F.col("containment") >= percent / 100, "contained").otherwise("clean")
    return out.select("key", kind.alias("verdict"), F.coalesce("exact", F.lit(0)).alias("exact"), F.coalesce("normalized", F.lit(0)).alias("normalized"), F.coalesce("near", F.lit(0)).cast("long").alias("near"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


__all__ = ["classes", "similar_sets", "verified", "lsh_pairs", "linked_classes", "scan", "jaccard", "tokens"]
