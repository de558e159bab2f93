import math
import random

import numpy as np

import pytest

from quillon.llm import maxscore, urlfilter


def brute(rows, k):
    fit = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    queries = {}
    for i, v in fit:
        if i % 100 == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, w in queries.items():
        best = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in fit if i != q)[:k]  # noqa: B905
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2100, [float("nan")] * 16), (2101, [float("inf")] * 16), (2200, [0.5] * 3), (2300, []), (None, [0.1] * 16), (100, rows[7][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in maxscore.search(df).collect())
    assert got == brute(rows, 10)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in maxscore.search(few).collect()) == brute(rows[:4], 10)
    assert maxscore.search(few.limit(0)).count() == 0


def test_non_essential_terms_are_probed_for_few_rows():
    order, m = maxscore.non_essential(np.array([5.0, 1.0, 2.0, 9.0]), 4.0)
    assert order.tolist() == [1, 2, 0, 3] and m == 2 and maxscore.non_essential(np.array([1.0, 2.0]), 3.0)[1] == 1 and maxscore.non_essential(np.array([1.0]), -np.inf)[1] == 0
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(5000, 24)) * np.r_[np.full(4, 400.0), np.full(20, 4.0)]).astype(np.int64)
    ids, q = np.arange(5000), v[:20]
    scores = q @ v.T
    scores[np.arange(20), np.arange(20)] = -(2**40)
    floors, probes = np.sort(scores[:, :1000], axis=1)[:, -10].tolist(), []
    for qid, found, best in maxscore.top_k_shard(ids[:20], q, ids, v, 10, floors, probes):
        assert found.tolist() == sorted(range(5000), key=lambda i: (-scores[qid][i], i))[:10] and best.tolist() == scores[qid][found].tolist()
    assert min(m for m, _ in probes) >= 15 and sum(n for _, n in probes) / len(probes) < 2000  # of 5000 rows


def test_top_k_of_large_components(spark):
    rows = [(0, [1.0, 1.0]), (1, [200000.0, 0.0]), (2, [150000.0, 1.0]), (3, [-300000.5, 5.0]), (4, [140000.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in maxscore.search(df).collect()) == brute(rows, 10)
    for x in (1e12, 1e17):  # a score, and a component, that no long holds
        with pytest.raises(Exception, match="exceed a long|exceeds a long"):
            maxscore.search(spark.createDataFrame([(0, [x]), (1, [x])], "vec_id long, embedding array<double>")).collect()


URLS = [
    None, "", "no scheme", "http://", "http://Example.COM", "http://example.com/en/", "http://example.com/en", "https://a.example.com/en/x?y#z", "http://www.example.com/en/q", "http://x.www.example.com/en/",
    "http://notexample.com/en/", "http://b.net/es/1", "http://net/fr/", "http://net/frx", "http://com", "http://com/", "ftp://a.b.org/p#/en/", "http://example.com?/en/", "x://é.com/en/", "a://b://c.com/", "http://www.example.com./en/", "http://.com/x", "http://a..com/x",
]


def judged(url, rules):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_rules_against_plain_matching(spark):
    pages = [(i, u, "h", "k") for i, u in enumerate(URLS * 3)] + [(None, "http://example.com/en/", None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, host string, key string")
    want = sorted(((i, *judged(u, urlfilter.RULES)) for i, u, *_ in pages), key=str)
    for limit in (10_000, 0):  # swept, and joined through host suffixes
        got = urlfilter.judge(df, urlfilter.rules_frame(spark), max_swept_rules=limit).collect()
        assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=str) == want
    assert urlfilter.judge(df.limit(0), urlfilter.rules_frame(spark)).count() == 0
    assert urlfilter.judge(df, urlfilter.rules_frame(spark).limit(0)).where("verdict = 'allow' and rule is null").count() == len(pages)
