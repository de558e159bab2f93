"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that aren't blank.  A gram starts at a line and takes as few lines as hold ``NOISE`` words.  For every run of
as few lines as hold ``GUARANTEE`` words, the gram with the least hash that lies inside is selected, so every repeated run of at least that many words
shares a selected gram, and fewer than ``NOISE`` words never match.  A fingerprint's first occurrence (by doc_id, then position; a map-side
combined minimum) is joined to its later ones, so a passage in a third of all documents costs one row for each occurrence and no pairs.  As the
first occurrence of a gram may sit in a shorter run than some other earlier one, the windows themselves (the shortest runs with the guarantee, from each line on
and up to each line) are fingerprints too; where a line holds that many words, gram and windows are one.  So each line of a
repeated run of ``GUARANTEE`` words is found, whichever earlier copies there are.  A match is extended line by line both ways, as far as
the next ``GUARANTEE`` words, and the later run is deleted.

Every deleted line has an equal line earlier in the corpus, and the earliest copy of a line is never deleted.

Defined results: a null text stays null, an empty one empty; a document whose lines are all deleted keeps an empty text; rows that agree in
doc_id and text are one document and treated alike; documents without a doc_id come last in the order.  Blank lines inside a deleted run go with it.
Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, trim

NOISE = 20
GUARANTEE = 40
SALTS = 8
#: Documents whose fingerprints are held at once.
DOCS = 500


def lines_of(text: str) -> tuple[list[int], list[int], list[int]]:
    """Of the lines that aren't blank: their numbers, hashes, and words."""
    at, hashes, words = [], [], []
    for i, line in enumerate(text.split("\n")):
        if n := len(line.split()):
            at.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(line.strip().encode("utf-8", "surrogatepass")))
            words.append(n)
    return at, hashes, words


def ends(words: list[int], least: int) -> list[int]:
    """For each line, the line after the shortest run from it that holds ``least`` words; -1 if the rest is too short."""
    out, end, total = [], 0, 0
    for start, n in enumerate(words):
        while end < len(words) and total < least:
            total += words[end]
            end += 1
        out.append(end if total >= least else -1)
        total -= n
    return out


def reach(words: list[int], least: int) -> list[int]:
    """Like :func:`ends`, but the end of the document where the rest is too short."""
    return [e if e > 0 else len(words) for e in ends(words, least)]


def selected(hashes: list[int], words: list[int], noise: int = NOISE, guarantee: int = GUARANTEE) -> list[tuple[int, int]]:
    """(first line, line after the last) of the selected grams, and of the shortest runs that hold the guarantee from each line on and up to each line."""
    gram_end, run_end = ends(words, noise), ends(words, guarantee)
    grams = [xxhash.xxh3_64_intdigest(np.array(hashes[s:e], dtype=np.uint64).tobytes()) if e > 0 else None for s, e in enumerate(gram_end)]
    picked = set()
    for start, stop in enumerate(run_end):
        if stop < 0:
            break
        inside = [(grams[s], -s) for s in range(start, stop) if 0 < gram_end[s] <= stop]
        s = -min(inside)[1]
        picked |= {(s, gram_end[s]), (start, stop)}
    n = len(words)
    picked |= {(n - e, n - s) for s, e in enumerate(ends(words[::-1], guarantee)) if e > 0}
    return sorted(picked)


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def extended(own: np.ndarray, i: int, other: np.ndarray, j: int) -> tuple[int, int]:
    """How many lines before ``i`` and ``j``, and from there on, are equal."""
    n = min(i, j)
    differ = np.flatnonzero(own[i - n : i][::-1] != other[j - n : j][::-1])
    back = int(differ[0]) if len(differ) else n
    n = min(len(own) - i, len(other) - j)
    differ = np.flatnonzero(own[i : i + n] != other[j : j + n])
    return back, int(differ[0]) if len(differ) else n


def repeated_runs(docs: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """Per document (by __id and __tie) with later repeated runs: ``runs``, an array of (first, last) numbers among its lines that aren't blank."""

    def of(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, tie, t in zip(b["__id"].tolist(), b["__tie"].tolist(), b["text"].tolist(), strict=True):
            _, hashes, words = lines_of(t)
            h = np.array(hashes, dtype=np.uint64)
            before, after = reach(words[::-1], guarantee)[::-1], reach(words, guarantee)
            for s, e in selected(hashes, words, noise, guarantee):
                low, high = len(words) - before[s - 1] if s else 0, after[e] if e < len(words) else e
                out.append((signed(xxhash.xxh3_64_intdigest(h[s:e].tobytes())), i, tie, s, s - low, h[low:high].view(np.int64)))
        return pd.DataFrame(out, columns=["gram", "__id", "__tie", "line", "off", "near"])

    def fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), DOCS):
                yield of(b.iloc[at : at + DOCS])
            trim()

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [extended(a, i, o, j) for a, i, o, j in zip(b["near"], b["off"].tolist(), b["first_near"], b["first_off"].tolist(), strict=True)]
            back, on = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))
            line = b["line"].to_numpy()
            yield pd.DataFrame({"__id": b["__id"], "__tie": b["__tie"], "first": line - back, "last": line + on - 1})
        trim()

    f = docs.where("text is not null").mapInPandas(fingerprints, "gram long, __id long, __tie long, line long, off long, near array<long>")
    order = F.struct("__id", "__tie", "line", "off", "near")
    first = f.groupBy("gram").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = first.select("gram", F.explode(F.array([F.lit(i) for i in range(SALTS)])).alias("salt"), F.col("f.__id").alias("first_id"), F.col("f.__tie").alias("first_tie"), F.col("f.line").alias("first_line"), F.col("f.off").alias("first_off"), F.col("f.near").alias("first_near"))
    later = f.withColumn("salt", F.pmod(F.xxhash64("__id", "__tie", "line"), F.lit(SALTS)).cast("int")).join(first, ["gram", "salt"])
    later = later.where("not (__id = first_id and __tie = first_tie and line = first_line)")
    runs = later.select("__id", "__tie", "line", "off", "near", "first_off", "first_near").mapInPandas(match, "__id long, __tie long, first long, last long")
    return runs.groupBy("__id", "__tie").agg(F.collect_set(F.struct("first", "last")).alias("__runs"))


def without(text: str, runs) -> tuple[str, int, int]:
    """The text without the runs; its lines that aren't blank, and how many of them went."""
    at, _, _ = lines_of(text)
    lines = text.split("\n")
    gone, count = set(), set()
    for r in runs:
        gone.update(range(at[r["first"]], at[r["last"]] + 1))
        count.update(range(r["first"], r["last"] + 1))
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(at), len(count)


def keyed(docs: DataFrame) -> DataFrame:
    require(docs, "doc_id", "text")
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "__tie": F.xxhash64(F.col("text").cast("string"))})


def dedup(docs: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE, counts: bool = False) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``; with ``counts``, also n_lines and n_deleted."""
    k = keyed(docs)
    runs = repeated_runs(k.select("__id", "__tie", F.col("text").cast("string").alias("text")), noise, guarantee)

    @F.pandas_udf("text string, n_lines long, n_deleted long")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0) if t is None else (t, sum(not x.isspace() and x != "" for x in t.split("\n")), 0) if r is None or not len(r) else without(t, r) for t, r in zip(texts, found, strict=True)]
        trim()
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_deleted"])

    out = k.join(runs, ["__id", "__tie"], "left").withColumn("__cut", cut(F.col("text").cast("string"), "__runs"))
    columns = [F.col("__cut.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, *([F.col("__cut.n_lines").alias("n_lines"), F.col("__cut.n_deleted").alias("n_deleted")] if counts else []))
