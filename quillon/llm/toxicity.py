"""Toxicity: a convolutional text classifier, trained in numpy.

A word's embedding is the sum of three hashed rows: two independent hashes of the word (so that one collision alone doesn't make a word look like
another) and one of its first four letters.  Filters of several widths run over the words, a rectifier and max pooling over the whole text follow, and a
linear layer gives the logit.  Training is Adam on a bounded sample of labelled rows (``MAX_FIT``, those with the least hash of doc_id, all outside the held-out fold);
a fifth of the sample is set aside to calibrate a threshold by language, where the language is guessed from the text's own
function words.  The calibrated threshold of the guessed language maps to a score of 0.5.

Only the text enters a score.  Texts are scored whole.  Defined results: null and empty texts have no words, pool to zero and get the score of the bias alone;
repeated rows score alike; without labelled rows of both kinds the score is the smoothed rate of label 1.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import require

BITS = 17
SIZE = 1 << BITS
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
MAX_FIT = 6_000
EPOCHS = 6
#: The training label is the held-out fold's complement: crc32(doc_id) mod FOLDS != 0.
FOLDS = 5
MEMO = 300_000
WORD = re.compile(r"[^\W_]+")
LANGUAGES = {
    "en": "the of and to in is that it for was on are as with his they at be this have from or had by",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se il ce",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}
NAMES = (*LANGUAGES, "other")


class Hasher:
    """Rows of the three embedding tables for the words of a text, with a bounded memo; and the guessed language."""

    def __init__(self):
        self.memo: dict[str, int] = {}
        self.speaks: dict[str, int] = {}
        for i, words in enumerate(LANGUAGES.values()):
            for w in words.split():
                self.speaks[w] = self.speaks.get(w, 0) | 1 << i

    def missing(self, w: str) -> int:
        h, p = xxhash.xxh3_64_intdigest(w), xxhash.xxh3_64_intdigest("^" + w[:4])
        v = (h & SIZE - 1) | (h >> 20 & SIZE - 1) << BITS | (p & SIZE - 1) << 2 * BITS | self.speaks.get(w, 0) << 3 * BITS
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(w) <= 40:
            self.memo[w] = v
        return v

    def rows(self, text: str | None) -> np.ndarray:
        memo = self.memo
        words = WORD.findall(text.lower()) if text else []
        try:
            return np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            get, miss = memo.get, self.missing
            return np.fromiter((v if (v := get(w)) is not None else miss(w) for w in words), dtype=np.int64, count=len(words))


@functools.cache
def hasher() -> Hasher:
    """One for each Python worker."""
    return Hasher()


def language(rows: np.ndarray) -> int:
    """Place in NAMES of the language with most function words; ties and none: other."""
    n = [np.count_nonzero(rows >> (3 * BITS + i) & 1) for i in range(len(LANGUAGES))]
    best = int(np.argmax(n))
    return best if n[best] and n.count(n[best]) == 1 else len(LANGUAGES)


class Net:
    """Weights: the embedding tables, filters and biases by width, output weights and bias, thresholds by language."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.tables = [r.normal(0, 0.05, (SIZE, DIM)).astype(np.float32) for _ in range(3)]
        self.filters = [r.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, dtype=np.float32)
        self.thresholds = [0.0] * len(NAMES)

    @staticmethod
    def ids(rows: np.ndarray) -> list[np.ndarray]:
        return [rows >> (i * BITS) & SIZE - 1 for i in range(3)]

    def embed(self, ids: list[np.ndarray]) -> np.ndarray:
        return self.tables[0][ids[0]] + self.tables[1][ids[1]] + self.tables[2][ids[2]]

    def pooled(self, x: np.ndarray, where: bool = False):
        """Max over the text of each filter, from 0; with ``where``, also the places of the maxima (-1: nothing above 0)."""
        out, places = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            n = len(x) - w + 1
            if n <= 0:
                out.append(np.zeros(FILTERS, dtype=np.float32))
                places.append(np.full(FILTERS, -1))
                continue
            y = x[:n] @ f[:DIM]
            for j in range(1, w):
                y += x[j : j + n] @ f[j * DIM : (j + 1) * DIM]
            y += b
            if where:
                at = y.argmax(axis=0)
                top = y[at, np.arange(FILTERS)]
                places.append(np.where(top > 0, at, -1))
            else:
                top = y.max(axis=0)
            out.append(np.maximum(top, 0))
        return (np.concatenate(out), places) if where else np.concatenate(out)

    def logit(self, rows: np.ndarray) -> float:
        best = None
        for at in range(0, max(1, len(rows)), 8192):  # very long texts in parts that overlap by the widest filter
            p = self.pooled(self.embed(self.ids(rows[max(0, at - max(WIDTHS) + 1) : at + 8192])))
            best = p if best is None else np.maximum(best, p)
        return float(best @ self.out + self.bias[0])

    def score(self, rows: np.ndarray) -> float:
        z = self.logit(rows) - self.thresholds[language(rows)]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> Net:
    net = Net()
    if labels.min() == labels.max():
        rate = (labels.sum() + 1) / (len(labels) + 2)
        net.out[:] = 0
        net.bias[0] = np.log(rate / (1 - rate))
        return net
    rng = np.random.default_rng(17)
    aside = rng.random(len(texts)) < 0.2
    own = np.flatnonzero(~aside)
    weight = np.where(labels == 1, 0.5 / labels[own].mean(), 0.5 / (1 - labels[own].mean()))
    dense = [*net.filters, *net.biases, net.out, net.bias]
    m, v = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    tm, tv = [np.zeros_like(p) for p in net.tables], [np.zeros_like(p) for p in net.tables]
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(own), max(1, len(own) // 32)):
            grads = [np.zeros_like(p) for p in dense]
            touched: list[dict[int, np.ndarray]] = [{}, {}, {}]
            for i in batch:
                rows = texts[i]
                ids = net.ids(rows)
                x = net.embed(ids)
                h, places = net.pooled(x, where=True)
                z = float(h @ net.out + net.bias[0])
                e = np.float32((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) * weight[i] / len(batch))
                grads[-2] += e * h
                grads[-1] += e
                back = e * net.out
                for k, w in enumerate(WIDTHS):
                    for f, at in enumerate(places[k]):
                        if at >= 0 and (g := back[k * FILTERS + f]):
                            grads[k][:, f] += g * x[at : at + w].ravel()
                            grads[len(WIDTHS) + k][f] += g
                            d = g * net.filters[k][:, f].reshape(w, DIM)
                            for j in range(w):
                                for t, table in enumerate(touched):
                                    r = int(ids[t][at + j])
                                    table[r] = table[r] + d[j] if r in table else d[j].copy()
            step += 1
            fix = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, a, b in zip(dense, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= fix * a / (np.sqrt(b) + 1e-8)
            for p, table, a, b in zip(net.tables, touched, tm, tv, strict=True):
                if table:
                    r = np.fromiter(table, dtype=np.int64)
                    g = np.stack(list(table.values()))
                    a[r] += 0.1 * (g - a[r])
                    b[r] += 0.001 * (g * g - b[r])
                    p[r] -= fix * a[r] / (np.sqrt(b[r]) + 1e-8)
    held = np.flatnonzero(aside)
    z = np.array([net.logit(texts[i]) for i in held])
    spoken = np.array([language(texts[i]) for i in held])
    net.thresholds = [threshold(z[spoken == k], labels[held][spoken == k], threshold(z, labels[held], 0.0)) for k in range(len(NAMES))]
    return net


def threshold(z: np.ndarray, y: np.ndarray, otherwise: float, least: int = 5) -> float:
    """The cut with the best F1, in the middle of the best stretch; ``otherwise`` with fewer than ``least`` rows of either label."""
    if min((y == 1).sum(), (y == 0).sum()) < least:
        return otherwise
    order = np.argsort(-z)
    hit = np.cumsum(y[order] == 1)
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + (y == 1).sum())
    at = np.flatnonzero(f1 == f1.max())
    cut = z[order]
    return float((cut[at[0]] + cut[min(at[-1] + 1, len(z) - 1)]) / 2)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_fit: int = MAX_FIT) -> Net:
    """A net from at most ``max_fit`` labelled rows outside the held-out fold."""
    require(labels, "doc_id", column)
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = hasher()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "rows": [h.rows(t).tobytes() for t in b["text"]]})

    # max_fit rows of two numbers: a proven bound for the broadcast
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known.select(F.col("doc_id").cast("long").alias("doc_id"), "y")), "doc_id")
    got = t.mapInPandas(hashed, "doc_id long, y int, rows binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["rows"])))
    if not got:
        return train([np.zeros(0, dtype=np.int64)], np.zeros(1))
    return train([np.frombuffer(bytes(r["rows"]), dtype=np.int64) for r in got], np.array([r["y"] for r in got], dtype=np.float32))


def classify(docs: DataFrame, net: Net) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    require(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(net)  # three fixed tables, 12 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, n = hasher(), shared.value
        for b in batches:
            s = np.array([n.score(h.rows(t)) for t in b["text"]], dtype=float)
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "held_out": b["held_out"].array, "score": s, "predicted": (s >= 0.5).astype("int32")})

    t = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    kinds = StructType([t.schema["doc_id"], StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return t.mapInPandas(run, kinds)
