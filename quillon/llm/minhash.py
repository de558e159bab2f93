"""Near-duplicate classes by circulant MinHash, banding and exact verification.

A text's words are its runs of non-white-space bytes with A-Z lowered; its set holds the 64-bit hashes of its distinct word shingles (the first
permutation).  A second permutation of 32-bit numbers, circularly shifted by k, gives signature coordinate k: min over the set of pi(x + k mod
2**32).  ``BANDS`` bands of ``ROWS`` coordinates make buckets; at the threshold 0.8 a pair shares none with a probability below 1e-5.  Only
representatives of equal sets enter buckets, so groups of copies cost one row.

Representatives that buckets connect form a candidate group (each bucket adds one edge a member, to its least id, so no pairs are made).  Every link lies
inside one group.  A group's full sets then meet in a bounded task, and postings of its shingles give the exact size of the intersection of one set with all
the others at once: :func:`spanning` takes set after set until all that were not taken are in one component, so a group of near copies costs few steps, and
sets that are linked with nothing cost one step each.  At most one link less than a task has rows leaves it.  No pair is left to an estimate.

A group of more than ``PART`` shingles is cut into parts.  First each part finds its own links, together with a few sets that visit all parts of their group;
then the sets that are not in the group's largest component so far, dealt to blocks, visit the other parts.  So a large group that hangs together is
shipped about once, and one that doesn't is compared block by block; nothing is dropped.

Defined results: a null text counts as empty; a text with fewer words than a shingle is one shingle; without words the set is empty and linked
with nothing.  Rows without a doc_id are linked with nothing (component_id null, kept).  Rows that share a doc_id pool their links.  Other
columns are ignored by :func:`components` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import discard, materialize, require, trim

BANDS, ROWS = 30, 5
K = BANDS * ROWS
#: Shingles (about) of one part of a large group, and of the small groups that share a task.
PART = 400_000
#: Sets of a large group that visit all its parts first.
VISITORS = 8
#: Up to so many ids are broadcast to pick their texts; beyond that they are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    m = min(n, width)
    s = np.full(n - m + 1, m, dtype=np.uint64)
    for j in range(m):
        s = mix64((s + h[j : n - m + 1 + j]) * MIX[j % len(MIX)])
    return np.unique(s)


def signature(u: np.ndarray) -> np.ndarray:
    """Circulant MinHash: the minimum of pi(x + k) for each shift k."""
    x = (u >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(K, dtype=np.uint32)[:, None]
    out = np.full(K, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        v = x[None, at : at + 2048] + shifts
        v ^= v >> np.uint32(16)
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        v *= np.uint32(0xC2B2AE35)
        v ^= v >> np.uint32(16)
        np.minimum(out, v.min(axis=1), out=out)
    return out


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix64((key + rows[:, j]) * MIX[j])
    return key.astype(np.int64)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, n_shingles, set_key (equal sets share it), keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                u = shingle_set(t, width)
                rows.append((len(u), xxhash.xxh3_128_digest(u.tobytes()), bucket_keys(signature(u))) if len(u) else (0, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_key", "keys"])
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out
            trim()

    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = StructType([StructField("doc_id", LongType()), StructField("n_shingles", LongType()), StructField("set_key", BinaryType()), StructField("keys", ArrayType(LongType()))])
    return t.mapInPandas(run, kinds)


def spanning(sets: list[np.ndarray], comp: np.ndarray, percent: int, visiting: np.ndarray | None = None) -> np.ndarray:
    """``comp`` (small whole numbers; equal: joined already) after all links among ``sets``.  With ``visiting``, only links between a visiting set and one that isn't
    are looked for."""
    comp, n = comp.copy(), len(sets)
    size = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    change = np.r_[True, flat[order][1:] != flat[order][:-1]]
    code = np.empty(len(flat), dtype=np.int64)
    code[order] = np.cumsum(change) - 1
    rows = np.repeat(np.arange(n), size)[order]
    first = np.flatnonzero(change)
    count = np.diff(np.r_[first, len(flat)])
    starts = np.cumsum(size) - size

    def take(r: int, others: np.ndarray) -> None:
        own = code[starts[r] : starts[r] + size[r]]
        own = own[count[own] > 1]
        k = count[own]
        after = np.cumsum(k)
        both = np.bincount(rows[np.repeat(first[own] - (after - k), k) + np.arange(after[-1] if len(after) else 0)], minlength=n)
        hit = others & (comp != comp[r]) & (100 * both >= percent * (size[r] + size - both))
        if hit.any():
            comp[np.isin(comp, comp[hit])] = comp[r]

    if visiting is not None:
        for r in np.flatnonzero(visiting):
            if (comp[~visiting] != comp[r]).any():
                take(int(r), ~visiting)
        return comp
    waiting, everyone = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    while True:
        often = np.bincount(comp[waiting])
        if (often > 0).sum() < 2:
            return comp
        r = int(np.flatnonzero(waiting & (comp != often.argmax()))[0])
        waiting[r] = False
        take(r, everyone)


def labels(edges: DataFrame) -> DataFrame:
    """id, comp: the least id of each end's component.  Each node points to its least neighbour, pointers are doubled, and the graph is contracted to where
    they point; edges inside a component fall away, so each round works on what is left of the one before."""
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    now, old = None, []
    while True:
        both = left.union(left.select("b", "a"))
        to = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        to = materialize(to.join(to.toDF("x", "y"), F.col("to") == F.col("x")).select("a", F.col("y").alias("to")), "pointers")
        if now is None:
            now = to.toDF("id", "comp")
        else:
            now = now.join(to, F.col("comp") == F.col("a"), "left").select("id", F.coalesce("to", "comp").alias("comp"))
        old += [left, to]
        left = left.join(to.toDF("a", "ta"), "a").join(to.toDF("b", "tb"), "b").where("ta <> tb")
        left = materialize(left.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if left.isEmpty():
            now = materialize(now, "labels")
            discard(left, *old)
            return now


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (by distinct id) with their texts; documents that share an id have a row each."""
    t = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    return t.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "id")


def met(width: int, percent: int, visits: bool = False):
    """For the rows (comp, id, text, joined, visiting) of one task: a, b, where a is the least id of the rows that links inside a comp join.  ``joined`` are components
    known so far; with ``visits``, visiting sets are compared with the others only."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for _, own in g.groupby("comp", sort=False):
            visiting = own["visiting"].to_numpy(dtype=bool)
            if len(own) < 2 or (visits and not visiting.any()):
                continue
            ids = own["id"].to_numpy()
            _, comp = np.unique(own["joined"].to_numpy(), return_inverse=True)
            comp = spanning([shingle_set(t, width) for t in own["text"]], comp, percent, visiting if visits else None)
            order = np.lexsort((ids, comp))
            start = np.r_[True, comp[order][1:] != comp[order][:-1]]
            a.append(ids[order][np.flatnonzero(start)[np.cumsum(start) - 1]])
            b.append(ids[order])
        a, b = np.concatenate(a), np.concatenate(b)
        trim()
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    return run


def small_links(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links a, b of groups that fit one task; several share one."""
    cells = members.agg(F.ceil(F.sum("n") / PART)).first()[0] or 1
    t = texts_of(docs, members.select("id", "comp"))
    t = t.select("comp", "id", "text", F.col("id").alias("joined"), F.lit(False).alias("visiting"), F.pmod(F.xxhash64("comp"), F.lit(cells)).alias("cell"))
    return t.groupBy("cell").applyInPandas(met(width, percent), "a long, b long")


def large_links(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links a, b of groups that are cut into parts; members: id, comp, n, parts."""
    texts = materialize(texts_of(docs, members.select("id")), "texts")
    members = members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    cells = lambda m, visits: m.join(texts, "id").groupBy("comp", "part", "block").applyInPandas(met(width, percent, visits), "a long, b long")
    chosen = members.withColumn("k", F.row_number().over(Window.partitionBy("comp").orderBy(F.xxhash64("id", F.lit(1)), "id"))).where(F.col("k") <= VISITORS)
    chosen = chosen.withColumn("own", F.col("part")).select("id", "comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), "own").where("part <> own").drop("own")
    m = members.select("id", "comp", "part").unionByName(chosen)
    first = materialize(cells(m.select("id", "comp", "part", F.lit(0).alias("block"), F.col("id").alias("joined"), F.lit(False).alias("visiting")), False), "links")
    known = labels(first) if not first.isEmpty() else None
    m = members.withColumn("joined", F.col("id")) if known is None else members.join(known.toDF("id", "j"), "id", "left").withColumn("joined", F.coalesce("j", "id")).drop("j")
    weights = m.groupBy("comp", "joined").agg(F.sum("n").alias("w"))
    most = weights.groupBy("comp").agg(F.max(F.struct("w", "joined")).alias("x"), F.sum("w").alias("w"))
    most = most.select("comp", F.col("x.joined").alias("main"), F.ceil((F.col("w") - F.col("x.w")) / PART).alias("blocks"))
    m = materialize(m.join(most, "comp").where("blocks > 0"), "members")  # groups that are not one component yet
    stay = m.select("id", "comp", "part", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), "joined", F.lit(False).alias("visiting"))
    go = m.where("joined <> main").withColumn("own", F.col("part")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int"))
    go = go.select("id", "comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), "block", "joined", F.lit(True).alias("visiting"), "own").where("part <> own").drop("own")
    second = materialize(cells(stay.unionByName(go), True), "links")
    discard(texts, known, m)
    return first.union(second)


def links(docs: DataFrame, signs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame | None:
    """id, comp of all representatives that are linked; None if nothing shares a bucket."""
    every = reps.select(F.explode("keys").alias("key"), "id")
    shared = every.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key", "lo")
    edges = every.join(shared, "key").where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b"))
    # a document id with several texts ties their classes
    several = signs.where("set_key is not null and doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select("doc_id")
    ties = signs.join(several, "doc_id").join(reps.select("set_key", "id"), "set_key").where("id <> doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    ties = materialize(ties.distinct(), "ties")
    groups = labels(edges)
    members = groups.join(reps.groupBy("id").agg(F.sum("n_shingles").alias("n")), "id").select("id", "comp", "n")
    sizes = members.groupBy("comp").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    members = materialize(members.join(sizes, "comp"), "members")
    found = small_links(docs, members.where("parts <= 1"), width, percent)
    large = members.where("parts > 1")
    if not large.isEmpty():
        found = found.union(large_links(docs, large, width, percent))
    out = labels(found.union(ties))
    discard(members, groups, ties)
    return out


def components(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id that links reach), kept."""
    require(docs, "doc_id", "text")
    signs = materialize(signed(docs, width), "signatures")
    reps = signs.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("r"))
    reps = materialize(reps.select("set_key", F.col("r.doc_id").alias("id"), "r.n_shingles", "r.keys"), "classes")
    comp = links(docs, signs, reps, width, percent)
    classes = reps.select("set_key", "id").join(comp, "id", "left").select("set_key", F.coalesce("comp", "id").alias("comp"))
    out = signs.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("set_key").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("comp"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents of a component but its least doc_id."""
    gone = components(docs, width, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
