"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

Base spans come from three patterns (assigned values, access keys, long hexadecimal runs).  The method adds spans of kind ``random``: runs of
token characters outside of base spans (or parts of such runs between slashes and equals signs) that a second-order character Markov chain of random strings explains better than one of ordinary identifiers, by at least
``MIN_RATIO`` nats a character.  Both chains are trained from labelled samples made here with a fixed seed: random base-64, base-62, base-32 and
hexadecimal strings on one side; camel-case, snake-case and numbered identifiers from pronounceable syllables on the other.

Whole texts are scanned; positions are code points.  Defined results: a null text counts as empty (no spans); repeated rows are scanned alike; other
columns are not touched.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import require, trim

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}
MIN_LONG = 20
MIN_RATIO = 0.6
MIN_LETTERS = 1.2
PART = re.compile("[^/=]+")
SAMPLES = 4000

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PLACE = {c: i for i, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET)


def random_samples(rng: random.Random) -> list[str]:
    pools = [ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "-_", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:26] + "0123456789"]
    return ["".join(rng.choices(rng.choice(pools), k=rng.randint(20, 64))) for _ in range(SAMPLES)]


def identifier_samples(rng: random.Random) -> list[str]:
    onset = "b c d f g h j k l m n p r s t v w z st tr th sh ch pr gr bl cl pl qu".split()
    nucleus = "a e i o u ai ea ie io ou ee".split()
    coda = ["", "", "n", "r", "s", "t", "l", "nd", "ng", "st", "ck", "nt"]
    syllable = lambda: rng.choice(onset) + rng.choice(nucleus) + rng.choice(coda)
    word = lambda: "".join(syllable() for _ in range(rng.randint(1, 3)))
    out = []
    for _ in range(SAMPLES):
        words = [word() for _ in range(rng.randint(3, 7))]
        style = rng.randrange(6)
        s = [lambda: words[0] + "".join(w.title() for w in words[1:]), lambda: "_".join(words), lambda: "-".join(words), lambda: "_".join(words).upper(), lambda: "/".join(words), lambda: "".join(words)][style]()
        if rng.random() < 0.5:
            s += rng.choice(["", "_", "-", "/"]) + str(rng.randrange(10 ** rng.randint(1, 6)))
        if rng.random() < 0.15:
            s = rng.choice(["2024-01-31-", "v2_", "20240131_", "img_0001-", "-----", "====="]) + s
        out.append(s)
    return out


@functools.cache
def ratios() -> list[float]:
    """log P(c | a, b, random) - log P(c | a, b, identifier), at (a * SIZE + b) * SIZE + c."""

    def chain(samples: list[str]) -> list[float]:
        n = [0.0] * SIZE**3
        for s in samples:
            x = [PLACE[c] for c in s]
            for a, b, c in zip(x, x[1:], x[2:], strict=False):
                n[(a * SIZE + b) * SIZE + c] += 1
        back = [[1.0] * SIZE for _ in range(SIZE)]  # first order, add one
        for i, v in enumerate(n):
            if v:
                back[i // SIZE % SIZE][i % SIZE] += v
        out = [0.0] * SIZE**3
        for b in range(SIZE):
            total = sum(back[b])
            p = [v / total for v in back[b]]
            for a in range(SIZE):
                at = (a * SIZE + b) * SIZE
                seen = sum(n[at : at + SIZE])
                for c in range(SIZE):
                    out[at + c] = math.log((n[at + c] + 20 * p[c]) / (seen + 20))
        return out

    r, i = chain(random_samples(random.Random(7))), chain(identifier_samples(random.Random(11)))
    return [x - y for x, y in zip(r, i, strict=True)]


def ratio(run: str) -> float:
    """Mean log-likelihood ratio a character; higher: likelier random."""
    t, x = ratios(), [PLACE[c] for c in run]
    return sum(t[(a * SIZE + b) * SIZE + c] for a, b, c in zip(x, x[1:], x[2:], strict=False)) / max(1, len(x) - 2)


def looks_random(run: str) -> bool:
    """Letters and digits together at ``MIN_RATIO``; letters alone only in both cases and at ``MIN_LETTERS``, as rare words of one case come near random ones."""
    if not any(c.isalpha() for c in run):
        return False
    if any(c.isdigit() for c in run):
        return ratio(run) >= MIN_RATIO
    return any(c.isupper() for c in run) and any(c.islower() for c in run) and ratio(run) >= MIN_LETTERS


def random_parts(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """A run that looks random, or else those of its parts between slashes and equals signs that do."""
    if looks_random(text[start:end]):
        return [(start, end, "random")]
    parts = [(start + m.start(), start + m.end()) for m in PART.finditer(text[start:end])]
    return [(s, e, "random") for s, e in parts if (s, e) != (start, end) and e - s >= MIN_LONG and looks_random(text[s:e])]


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind."""
    spans = []
    if "=" in text or ":" in text:
        spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    at = 0
    found = []
    # A key or a long run has no white space in it, so only long chunks are looked at.
    for chunk in text.split():
        if len(chunk) >= MIN_LONG:
            at = text.find(chunk, at)
            own = [(at + m.start(), at + m.end(), "access") for m in ACCESS.finditer(chunk) if m.end() - m.start() >= 20]
            own += [(at + m.start(), at + m.end(), "hex") for m in HEX.finditer(chunk)]
            spans += own
            found += [(at + m.start(), at + m.end()) for m in RUN.finditer(chunk)]
            at += len(chunk)
    spans.sort(key=lambda s: (s[0], KINDS[s[2]]))
    if found:
        base, i, new = sorted((s, e) for s, e, _ in spans), 0, []
        reach = 0  # no base span that was passed ends later
        for s, e in found:
            # what no base span covers of a run is judged
            free = s
            while i < len(base) and base[i][1] <= s:
                reach = max(reach, base[i][1])
                i += 1
            j = i
            free = max(free, min(reach, e))
            while j < len(base) and base[j][0] < e:
                if base[j][0] - free >= MIN_LONG:
                    new += random_parts(text, free, base[j][0])
                free = max(free, base[j][1])
                j += 1
            if e - free >= MIN_LONG:
                new += random_parts(text, free, e)
        spans += new
        spans.sort(key=lambda s: (s[0], KINDS[s[2]]))
    return spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                spans = scan(t)
                base = [s for s in spans if s[2] != "random"]
                n = [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    t = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = StructType([t.schema["doc_id"], *(StructField(f"n_{k}", LongType()) for k in ("assign", "access", "hex")), StructField("base_sha256", StringType()), StructField("spans", StringType())])
    return t.mapInPandas(run, kinds)


def blot(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every span, or run of overlapping spans, replaced by ``mark``."""
    spans = scan(text) if text else []
    if not spans:
        return text
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; other columns stay as they are."""
    require(docs, "text")

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = texts.map(lambda t: blot(t, mark), na_action="ignore")
        trim()
        return out

    return docs.withColumn("text", clean(F.col("text").cast("string")))
