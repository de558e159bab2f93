"""Training, calibration and evaluation on labelled requests."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import py_softmax
from ..operators.features import NAMES

#: Heads are fitted in one task each, on at most so many questions (by hash), a documented bound on its memory.
MAX_QUESTIONS = 50_000


def examples(features: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per question: its feature rows in the order of its criteria, and the place of the right one.

    gold: (request_id, question_id, gold) with JSON values: an option's key, a level's number, or a truth value."""
    rows = features.select("request_id", "question_id", "kind", "family", F.struct("idx", "key", F.array(*(F.col(n).cast("float") for n in NAMES)).alias("x")).alias("c"))
    g = rows.groupBy("request_id", "question_id", "kind", "family").agg(F.sort_array(F.collect_list("c")).alias("c"))
    j = g.join(gold, ["request_id", "question_id"])
    keys = F.transform("c", lambda x: x["key"])
    text = F.regexp_replace("gold", '^"|"$', "")
    truth = text.isin("true", "yes", "1") | (F.coalesce(text.try_cast("double"), F.lit(0.0)) >= 0.5)
    place = F.when(F.col("kind") == "choice", F.array_position(keys, text) - 1).when(F.col("kind") == "score", text.try_cast("int")).otherwise(F.when(truth, 0).otherwise(1))
    return j.withColumn("y", place.cast("int")).where((F.col("y") >= 0) & (F.col("y") < F.size("c")))


def fit_logit(x: list[np.ndarray], y: np.ndarray, family: np.ndarray, ordinal: bool, l2: float = 1e-3, family_l2: float = 1e-2, least: int = 40, epochs: int = 300, rate: float = 0.05) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Conditional logit by Adam: shared weights and shrunken differences of families with ``least`` questions."""
    k = len(NAMES)
    fams = [f for f in sorted(set(family)) if (family == f).sum() >= least]
    place = {f: i + 1 for i, f in enumerate(fams)}
    w, m, v = np.zeros((len(fams) + 1, k)), np.zeros((len(fams) + 1, k)), np.zeros((len(fams) + 1, k))
    sizes = np.array([len(r) for r in x])
    rows, owner = np.vstack(x), np.repeat(np.arange(len(x)), sizes)
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    fam = np.array([place.get(f, 0) for f in family])
    target = np.zeros(len(rows))
    for i, (start, n) in enumerate(zip(first, sizes, strict=True)):
        if ordinal:  # a little of the mass goes to the levels beside the right one
            near = [j for j in (y[i] - 1, y[i] + 1) if 0 <= j < n]
            target[start + y[i]] = 1 - 0.04 * len(near)
            for j in near:
                target[start + j] = 0.04
        else:
            target[start + y[i]] = 1
    for step in range(1, epochs + 1):
        z = np.einsum("ij,ij->i", rows, w[0] + np.where((fam[owner] > 0)[:, None], w[fam[owner]], 0))
        e = np.exp(z - np.maximum.reduceat(z, first)[owner])
        p = e / np.add.reduceat(e, first)[owner]
        d = ((p - target) / len(x))[:, None] * rows
        g = np.zeros_like(w)
        g[0] = d.sum(axis=0) + l2 * w[0]
        for i in range(1, len(w)):
            g[i] = d[fam[owner] == i].sum(axis=0) + family_l2 * w[i]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[0], {f: w[i] for f, i in place.items()}


def train(ex: DataFrame, epochs: int = 300) -> dict:
    """Weights by kind: {kind: {"base": {...}, "families": {...}}}, rounded to four decimals, zeros left out."""

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["request_id", "question_id"])
        x = [np.array([np.asarray(r["x"], dtype=float) for r in c]) for c in df["c"]]
        base, fams = fit_logit(x, df["y"].to_numpy(), df["family"].to_numpy(), df["kind"].iloc[0] == "score", epochs=epochs)
        rows = [("base", n, w) for n, w in zip(NAMES, base, strict=True)] + [(f, n, w) for f, ws in fams.items() for n, w in zip(NAMES, ws, strict=True)]
        return pd.DataFrame([(df["kind"].iloc[0], f, n, float(round(w, 4))) for f, n, w in rows if round(w, 4)], columns=["kind", "part", "feature", "weight"])

    bounded = ex.orderBy(F.xxhash64("request_id", "question_id"), "request_id", "question_id").limit(MAX_QUESTIONS)
    out: dict = {}
    for r in bounded.groupBy("kind").applyInPandas(fit, "kind string, part string, feature string, weight double").collect():
        head = out.setdefault(r["kind"], {"base": {}, "families": {}})
        (head["base"] if r["part"] == "base" else head["families"].setdefault(r["part"], {}))[r["feature"]] = r["weight"]
    return out


def golden(f, lo: float, hi: float, steps: int = 40) -> float:
    """Least point of a unimodal function by golden-section search."""
    r = (5**0.5 - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - r * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + r * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def temperature(logits: list, y: list[int]) -> float:
    """Log grid of 41 points in [.03, 8], then golden-section search around the best."""
    loss = lambda lt: -np.mean([np.log(max(py_softmax(list(z), float(np.exp(lt)))[k], 1e-12)) for z, k in zip(logits, y, strict=True)])
    grid = np.linspace(np.log(0.03), np.log(8), 41)
    at = grid[int(np.argmin([loss(g) for g in grid]))]
    return float(np.exp(golden(loss, at - 0.4, at + 0.4)))


def calibrate(scored: DataFrame, least: int = 30) -> dict[str, float]:
    """Temperature by family (and global) of (family, logits, y); each group is fitted in its own task on a bounded number of rows."""

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(df["part"].iloc[0], temperature(df["logits"].tolist(), df["y"].tolist()), len(df))], columns=["part", "t", "n"])

    b = scored.orderBy(F.xxhash64("request_id", "question_id"), "request_id").limit(MAX_QUESTIONS)
    both = b.select("family", "logits", "y", F.explode(F.array(F.col("family"), F.lit("global"))).alias("part"))
    return {r["part"]: r["t"] for r in both.groupBy("part").applyInPandas(fit, "part string, t double, n long").collect() if r["part"] == "global" or r["n"] >= least}


def platt(z: np.ndarray, y: np.ndarray, steps: int = 4000, rate: float = 0.05) -> tuple[float, float]:
    """Gradient descent on sigma(a z + b), a drawn to 1; identity with fewer than five rows."""
    if len(z) < 5:
        return 1.0, 0.0
    a, b = 1.0, 0.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - y
        a, b = a - rate * ((e * z).mean() + 1e-3 * (a - 1)), b - rate * e.mean()
    return float(a), float(b)


def isotonic(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators fit of y on p, for comparison."""
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []
    for v in y[order].astype(float):
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2 = blocks.pop()
            v1, n1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    out = np.empty(len(p))
    out[order] = np.concatenate([[v] * int(n) for v, n in blocks]) if blocks else []
    return out


def judged(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Answers beside their golds: correct, confidence; a missing answer counts as wrong."""
    j = gold.join(answers, ["request_id", "question_id"], "left")
    text = F.regexp_replace("gold", '^"|"$', "")
    said = F.when(F.col("kind") == "choice", F.col("choice")).when(F.col("kind") == "score", F.round("score").cast("int").cast("string")).otherwise(F.when(F.col("noul") >= 0.5, "true").otherwise("false"))
    return j.withColumn("correct", F.coalesce((said == text).cast("int"), F.lit(0))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def golds(records: DataFrame) -> DataFrame:
    return records.select("request_id", F.lit("q").alias("question_id"), "gold")


