"""Splits, de-duplication, balanced samples and loss weights; all deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import group_number


def split(df: DataFrame, group: str, train: int = 60, calibrate: int = 20) -> DataFrame:
    """``split``: train, calib or dev by the group's hash, so a group is never cut."""
    n = group_number(F.col(group).cast("string"))
    return df.withColumn("split", F.when(n < train, "train").when(n < train + calibrate, "calib").otherwise("dev"))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order`` (which must be unique in a key): a map-side combined minimum, not a window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__f"))
    return least.select(*(F.col(c) if c in keys else F.col(f"__f.{c}").alias(c) for c in df.columns))


def round_robin(df: DataFrame, label: str, key: str, n: int, seed: str = "") -> DataFrame:
    """The first n rows of: first of each label, second of each, ...; inside a label by hash.  A label can give n rows at most, so only these are ranked together."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    w = Window.partitionBy(label).orderBy("__h", key)
    top = df.withColumn("__h", h).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)  # a group limit is pushed before the shuffle
    return top.orderBy("turn", label).limit(n).drop("__h")


def loss_weights(df: DataFrame, kind: str, source: str, root: bool = False) -> DataFrame:
    """``weight``: 1/n (or 1/sqrt n) of the row's (kind, source), scaled to a mean of 1 in each kind."""
    sizes = df.groupBy(kind, source).agg(F.count("*").alias("__n"))
    raw = 1 / (F.sqrt(F.col("__n").cast("double")) if root else F.col("__n"))
    sizes = sizes.withColumn("__w", raw)
    kinds = sizes.groupBy(kind).agg((F.sum(F.col("__w") * F.col("__n")) / F.sum("__n")).alias("__mean"))
    table = sizes.join(kinds, kind).select(kind, source, (F.col("__w") / F.col("__mean")).alias("weight"))
    return df.join(table, [kind, source])


def proportional_caps(pool: int, caps: tuple[int, ...] = (1200, 400, 400)) -> tuple[int, ...]:
    """Caps of train, calib and dev, scaled down together when the pool is smaller than their sum."""
    total = sum(caps)
    return caps if pool >= total else tuple(pool * c // total for c in caps)


def verify_records(records: DataFrame) -> DataFrame:
    """problem, n: missing ids, repeated ids, missing requests or golds, groups that cross splits."""
    r = records
    ids = r.groupBy("id").agg(F.count("*").alias("n"))
    crossed = r.where("`group` is not null").groupBy("group").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi")
    parts = [
        r.where("id is null or id = ''").select(F.lit("missing_id").alias("problem")),
        ids.where("id is not null and n > 1").select(F.lit("repeated_id").alias("problem")),
        r.where("request is null").select(F.lit("missing_request").alias("problem")),
        r.where("gold is null").select(F.lit("missing_gold").alias("problem")),
        crossed.select(F.lit("group_crosses_splits").alias("problem")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("problem").agg(F.count("*").alias("n"))


def unseen(train: DataFrame, dev: DataFrame, key: str) -> DataFrame:
    """Rows of ``train`` whose key occurs in no row of ``dev``; a null key never does."""
    return train.join(dev.select(key).distinct(), key, "left_anti")


def label_counts(df: DataFrame, split: str, label: str, labels: list) -> DataFrame:
    """One row per split, a count for each of the given labels."""
    return df.groupBy(split).agg(*(F.count_if(F.col(label) == v).alias(f"label_{v}") for v in labels))


MARKER = " [truncated]"
#: What a text may be cut behind, and how many characters of it stay.
ENDS = (". ", "? ", "! ", ".\n", "\n")


def _last(text: Column, part: str) -> Column:
    """0-based place of the last ``part``; -1 without one."""
    at = F.instr(F.reverse(text), part[::-1])
    return F.when(at > 0, F.length(text) - at - (len(part) - 1)).otherwise(F.lit(-1))


def truncated(text: Column, limit: int) -> Column:
    """The text, or as much of it as ends with a sentence (else a word, else anywhere) and has ``limit`` characters with the marker; null stays null."""
    cut = F.substring(text, 1, limit - len(MARKER))
    sentence = F.greatest(*(_last(cut, e) for e in ENDS))
    word = _last(cut, " ")
    end = F.when(sentence >= limit // 2, sentence).when(word >= limit // 2, word).otherwise(F.length(cut) - 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(cut, F.lit(1), end.cast("int") + 1), r"\s+$", ""), F.lit(MARKER)))


def option_bucket(n: Column) -> Column:
    return F.when(n <= 2, "2").when(n <= 4, "3-4").when(n <= 8, "5-8").when(n <= 16, "9-16").otherwise("17+")


def length_bucket(n: Column) -> Column:
    return F.when(n < 64, "<64").when(n < 256, "64-256").when(n < 1024, "256-1k").otherwise("1k+")
