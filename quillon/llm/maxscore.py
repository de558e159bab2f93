"""Exact top-k inner products by MaxScore.

Each component is a term: a query's weight on it times a posting's value.  The rows are cut into shards; within a shard every term has its postings
(one column) and its least and largest value, so a query knows between which bounds each term's addition lies.  With a floor (no more than the k-th best score), terms are split:
the largest set of terms that even together cannot lift a row from the least possible score to the floor is non-essential (:func:`non_essential`).  The postings of the
essential terms are traversed; this raises the floor; the others are only probed, widest bounds first, for rows that can still reach it.
The first floor of a query comes from its scores on ``SEEDS`` rows, the same for all shards; it only saves work.  A shard returns its k best; a window merges the shards.

Queries (a set that grows with the table) and shards meet in blocks: every (query block, shard) pair is one bounded task.
Components are floor(scale * x).  A component outside of a long, or a pair of blocks whose sums could leave one, raises an error.  Defined results: vectors that are null, hold a null or a non-finite
component, or have no id take no part; a shorter vector counts as padded with zeros; rows that share an id are all candidates, yet never
for their own id, and as queries only the least of their vectors counts; ties go to the smaller id.  Fewer candidates than k: all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, require

SHARD_ROWS = 65_536
MIN_SHARD_ROWS = 2_048
QUERY_BLOCK = 4_096
#: Terms probed between two rounds of pruning, and rows that give the first floors.
STRIDE = 8
SEEDS = 1_024


def matrix(vectors) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), max(1, width)), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def non_essential(spread: np.ndarray, slack: float) -> tuple[np.ndarray, int]:
    """Terms by ascending spread, and how many of the first ones add less than ``slack`` together."""
    order = np.argsort(spread, kind="stable")
    return order, int(np.searchsorted(np.cumsum(spread[order]), slack, side="left"))


def top_k_shard(q_ids, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, floors=None, probes: list | None = None):
    """The k best rows of a shard for each query: lists of (query, row ids, scores).  Rows below a query's floor may be left out."""
    width = max(q.shape[1], v.shape[1])
    q, v = np.pad(q, ((0, 0), (0, width - q.shape[1]))), np.pad(v, ((0, 0), (0, width - v.shape[1])))
    exact = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * width < 2.0**52
    if not exact and int(max(q.max(initial=0), -int(q.min(initial=0)))) * int(max(v.max(initial=0), -int(v.min(initial=0)))) * width >= 2**63:
        raise OverflowError("scores could exceed a long: the components of embedding are too large")
    kind = np.float64 if exact else np.int64  # sums below 2**52 are exact in doubles, which numpy multiplies faster
    q, postings = q.astype(kind), np.ascontiguousarray(v.T.astype(kind))
    high, low = postings.max(axis=1), postings.min(axis=1)
    floors = [None] * len(q_ids) if floors is None else floors
    for qid, w, known in zip(q_ids, q, floors, strict=True):
        most, least = np.maximum(w * high, w * low), np.minimum(w * high, w * low)
        live = np.flatnonzero(ids != qid)
        if not len(live):
            continue
        floor = -np.inf if known is None or known != known else known
        order, m = non_essential(most - least, floor - least.sum())
        essential, rest = order[m:], order[:m][::-1]
        part = w[essential] @ (postings[essential] if len(live) == postings.shape[1] else postings[np.ix_(essential, live)])
        above = np.append(np.cumsum(most[rest][::-1])[::-1], 0)  # what the terms from a place on add at most
        if len(live) >= k:
            floor = max(floor, np.partition(part, len(part) - k)[len(part) - k] + least[rest].sum())
        for at in range(0, m + 1, STRIDE):
            keep = part + above[min(at, m)] >= floor
            if not keep.all():
                live, part = live[keep], part[keep]
            now = rest[at : at + STRIDE]
            if len(now):
                part += w[now] @ postings[np.ix_(now, live)]
                if probes is not None:
                    probes.append((m, len(live)))
        best = np.lexsort((ids[live], -part))[:k]
        yield qid, ids[live[best]], part[best].astype(np.int64)


def search(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """For each row whose id is divisible by ``every``: query_id, rank, vec_id, score of its k best other rows."""
    require(vectors, "vec_id", "embedding")
    spark = vectors.sparkSession
    fit = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: x.cast("double") * scale
    whole = lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x)).cast("long")).otherwise(F.raise_error(F.lit("a component of embedding exceeds a long")).cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(fit)
    rows = rows.select("vec_id", F.transform("embedding", whole).alias("v"))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS), min(partitions(spark), n // MIN_SHARD_ROWS))
    blocks = max(1, -(-(n // every + 1) // QUERY_BLOCK))
    left = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "v")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v").toDF("block", "shard", "vec_id", "v")

    # floors: the k-th best score on a few rows
    seeds = rows.orderBy(F.xxhash64("vec_id", "v")).limit(SEEDS).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v").toDF("block", "vec_id", "v")

    def lowest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [(q, int(s[-1])) for q, _, s in top_k_shard(a["vec_id"].to_numpy(), matrix(a["v"].tolist()), b["vec_id"].to_numpy(), matrix(b["v"].tolist()), k) if len(s) == k] if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["vec_id", "floor"], dtype="int64")

    asked = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v").toDF("block", "vec_id", "v")
    floors = asked.groupBy("block").cogroup(seeds.groupBy("block")).applyInPandas(lowest, "vec_id long, floor long")
    left = left.join(floors.toDF("of", "floor"), F.col("vec_id") == F.col("of"), "left").select("block", "shard", "vec_id", "v", "floor").toDF("block", "shard", "vec_id", "v", "floor")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = list(top_k_shard(a["vec_id"].to_numpy(), matrix(a["v"].tolist()), b["vec_id"].to_numpy(), matrix(b["v"].tolist()), k, a["floor"].astype(object).where(a["floor"].notna(), None).tolist())) if len(a) and len(b) else []
        return pd.DataFrame({
            "query_id": np.repeat(np.array([x[0] for x in out], dtype=np.int64), [len(x[1]) for x in out]),
            "vec_id": np.concatenate([x[1] for x in out]) if out else np.array([], dtype=np.int64),
            "score": np.concatenate([x[2] for x in out]) if out else np.array([], dtype=np.int64),
        })

    best = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(meet, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
