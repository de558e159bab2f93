"""Quality by hierarchical empirical Bayes.

A logistic regression over surface features of the whole text gives each document's own evidence.  Grouped aggregation sums that evidence by host
and by path; the spread of the host means around the global mean gives the strength of a Beta prior (method of moments), so a
sparse host is shrunk toward the global rate and a sparse path toward its host.  A document's posterior log-odds are its own evidence plus what its path's
posterior adds to the global log-odds.

The document evidence is fitted on at most ``MAX_FIT`` labelled rows (those with the least hash of doc_id); site statistics count every document.
Where documents have no url, the host is ``source`` and the path is ``lang`` within it.

Defined results: a null text counts as empty; null hosts and paths are a site of their own; rows without a doc_id are scored like others; repeated rows
count as often as they occur; without labels of both kinds the evidence is the smoothed label rate and every document gets its site's rate.
Extra columns stay as they are in :func:`keep_good`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, require, trim

MAX_FIT = 8_000
RIDGE = 1e-2
#: Site tables of up to so many rows are broadcast (a few MB); larger ones are joined by a shuffle that AQE splits at hot sites.
MAX_BROADCAST_SITES = 50_000
#: Least share of a site posterior; keeps a site from overruling a document's own text.
SITE_WEIGHT = 0.5

SYMBOLS = re.compile(r"[^\w\s.,;:'\"!?()-]")
MARKED = re.compile(r"[^\w\s.,;:'\"!?()-]{2,}|!!|\?\?")
FEATURES = ("bias", "log_words", "word_length", "upper", "digits", "symbols", "marked_words", "bars", "bangs", "distinct_words", "distinct_lines", "line_words", "stops", "repeat_run")


def features(text: str) -> list[float]:
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [1.0, *[0.0] * (len(FEATURES) - 1)]
    lines = [x for x in text.split("\n") if x]
    upper = sum(map(str.isupper, words))
    symbols = len(text) - len(SYMBOLS.sub("", text))
    bars, bangs = text.count("|"), text.count("!!")
    marked = len(MARKED.findall(text))
    digits = sum(text.count(d) for d in "0123456789")
    repeat = len(set(zip(words, words[1:], words[2:], words[3:]))) / max(1, n - 3) if n > 8 else 1.0  # noqa: B905
    return [
        1.0, np.log1p(n) / 5, chars / n / 8, upper / n, digits / chars * 10, symbols / chars * 10, marked / n * 3, bars / n * 3, bangs / n * 3,
        len(set(words)) / n, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))) / 5, text.count(". ") / n * 5, 1 - repeat,
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares, and whether each is over a small bound."""
    return np.hstack([x, x[:, 1:] ** 2, (x[:, 3:9] > 0.3).astype(float)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 40) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * np.r_[0, w[1:]] / 10
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(np.r_[1e-9, np.full(len(w) - 1, ridge / 10)])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def log_odds(p):
    return F.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", max_fit: int = MAX_FIT) -> np.ndarray:
    require(labels, "doc_id", column)
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [features(t) for t in b["text"]]})

    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = t.join(F.broadcast(known), "doc_id").mapInPandas(run, "doc_id long, y int, x array<double>").collect()  # max_fit rows
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["y"] for r in got], dtype=float)
    width = expand(np.zeros((1, len(FEATURES)))).shape[1]
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return np.r_[np.log(rate / (1 - rate)), np.zeros(width - 1)]
    return logistic(expand(np.array([r["x"] for r in got])), y)


def evidence(docs: DataFrame, weights: np.ndarray, host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` with the document's own probability __p, its host __host and path __path."""
    require(docs, "text", host, path)

    @F.pandas_udf("double")
    def own(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        z = expand(np.array([features(t) for t in texts])) @ weights
        trim()
        return pd.Series(np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-4, 1 - 1e-4))

    # Scored once a row: declared nondeterministic, as a filter on the score would else make the optimizer run it twice, in a second worker a task.
    own = own.asNondeterministic()
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    return docs.withColumns({"__p": own(F.coalesce(F.col("text").cast("string"), F.lit(""))), "__host": blank(host), "__path": blank(path)})


def site_rates(scored: DataFrame) -> tuple[DataFrame, float]:
    """Posterior rate of each (host, path), and the global rate."""
    paths = scored.groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum("__p").alias("s"), F.sum(F.col("__p") * (1 - F.col("__p"))).alias("v"))
    paths = materialize(paths, "sites")
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("v").alias("hv"))
    total = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("k"), F.var_samp(F.col("hs") / F.col("hn")).alias("between"), F.avg(F.col("hv") / F.col("hn") / F.col("hn")).alias("within")
    ).first()
    if not total["n"]:
        return paths.select("__host", "__path", F.lit(0.5).alias("rate")), 0.5
    rate = min(max(total["s"] / total["n"], 1e-3), 1 - 1e-3)
    spread = max((total["between"] or 0.0) - (total["within"] or 0.0), 1e-6)
    strength = min(max(rate * (1 - rate) / spread - 1, 1.0), 1e6)  # alpha + beta of the Beta prior, by moments
    host = hosts.select("__host", ((F.col("hs") + strength * rate) / (F.col("hn") + strength)).alias("host_rate"))
    out = paths.join(host, "__host").select("__host", "__path", ((F.col("s") + strength * F.col("host_rate")) / (F.col("n") + strength)).alias("rate"))
    return out, rate


def posterior(docs: DataFrame, weights: np.ndarray, host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` with __p (own evidence), __site (its path's posterior rate) and __score (posterior probability of good quality)."""
    scored = evidence(docs, weights, host, path)
    rates, rate = site_rates(scored.select("__host", "__path", "__p"))
    few = rates.count() <= MAX_BROADCAST_SITES
    out = scored.join(F.broadcast(rates) if few else rates, ["__host", "__path"], "left")
    clip = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("rate")))
    z = log_odds(F.col("__p")) + SITE_WEIGHT * (log_odds(clip) - float(np.log(rate / (1 - rate))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), "__p", F.col("rate").alias("__site"), (1 / (1 + F.exp(-z))).alias("__score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, evidence, site_rate, score, kept."""
    require(docs, "doc_id", "text")
    t = posterior(docs.select("doc_id", "text", "source", "lang"), fit(docs, labels))
    return t.select("doc_id", F.round("__p", 6).alias("evidence"), F.round("__site", 6).alias("site_rate"), F.round("__score", 6).alias("score"), (F.col("__score") >= 0.5).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a posterior of at least 0.5."""
    t = posterior(docs, fit(docs, labels))
    return t.where("__score >= 0.5").select(*(F.col(f"`{c}`") for c in docs.columns))
