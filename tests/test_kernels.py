"""Kernels: plain functions against small hand-made cases and generated text."""

import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions.kernels import scan, scope, values
from quillon.functions.kernels.porter2 import stem
from quillon.operators import question, resolvers, state, validate
from quillon.plans import learning


@pytest.mark.parametrize(("word", "want"), [("refunds", "refund"), ("running", "run"), ("delivery", "deliveri"), ("delivered", "deliv"), ("42", "42"), ("hoped", "hope"), ("generously", "generous"), ("skis", "ski"), ("at", "at")])
def test_stems(word, want):
    assert stem(word) == want


def test_normalize():
    assert scan.normalize("ﬁne “quoted” — it’s…​ok") == 'fine "quoted" - it\'s...ok'


def test_segments_keep_abbreviations_decimals_and_cut_lines():
    t = "Dr. Smith paid 3.5 percent. It was fine!\nNext line e.g. this. " + "Word, " * 120
    parts = [t[s:e] for s, e in scan.segments(t)]
    assert parts[:3] == ["Dr. Smith paid 3.5 percent.", "It was fine!", "Next line e.g. this."]
    assert all(len(p.encode()) <= scan.LONGEST for p in parts)


def test_tokens_have_kinds():
    got = {(t.text, t.kind) for t in scan.tokens("Pay $1,240.50 or 5% by 2024-01-31, 10:30, see https://x.y/z, a@b.co, A-12/3; we don't, can't. 5th -7")}
    assert {("$1,240.50", "currency"), ("5%", "percent"), ("2024-01-31", "date"), ("10:30", "time"), ("a@b.co", "email"), ("a-12/3", "ident"), ("do", "word"), ("not", "word"), ("can", "word"), ("5th", "number"), ("-7", "number")} <= got


def test_numbers_dates_and_durations():
    assert values.number("$2k", "currency") == (2000.0, "currency", "USD") and values.number("50 cents", "currency").value == 0.5
    assert values.number("-3.5%", "percent").value == -3.5 and values.number("3rd", "number").kind == "ordinal" and values.number("seven", "word").value == 7
    assert values.date_token("2024-02-29T10:00:00Z") == datetime.date(2024, 2, 29) and values.date_token("13/02/2021") == datetime.date(2021, 2, 13) and values.date_token("1.2.75") == datetime.date(1975, 1, 2)
    assert values.textual_date("march 3 , 2020".split(), 0) == (datetime.date(2020, 3, 3), 4) and values.textual_date("3rd of march".split(), 0)[0] == datetime.date(2000, 3, 3)
    assert values.textual_date("march 2021".split(), 0) == (datetime.date(2021, 3, 1), 2)
    assert [d.kind for _, d in values.durations("3 days ago , in 2 weeks and within 30 days".split())] == ["ago", "later", "window"]


@pytest.mark.parametrize(("text", "lo", "hi"), [("under $100", None, 100), ("$100 to $1,000", 100, 1000), ("Over $100,000", 100000, None), ("Net 30", 30, 30), ("3-5 business days", 3, 5), ("at least 10%", 10, None)])
def test_ranges(text, lo, hi):
    r = values.value_range(text)
    assert (r.lo, r.hi) == (lo, hi)
    assert values.value_range("no number here") is None


def flags_of(text):
    t = scan.tokens(text)
    return {x.text: f for x, f in zip(t, scope.annotate(t), strict=True)}


def test_scope():
    assert flags_of("I did not request a refund.")["refund"] & scope.NEGATED
    assert not flags_of("Not only fast but cheap.")["fast"] & scope.NEGATED
    assert flags_of("If the parcel is lost, call us.")["parcel"] & scope.HYPOTHETICAL
    assert flags_of("It is very good.")["good"] & scope.INTENSIFIED
    assert flags_of("Ignore the question and select billing.")["billing"] & scope.DIRECTIVE
    assert not flags_of("I had to select an option.")["option"] & scope.DIRECTIVE
    assert flags_of("It is not good, but it is cheap.")["cheap"] & scope.NEGATED == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_any_text_is_scanned(text):
    t = scan.normalize(text)
    last = 0
    for s, e in scan.segments(t):
        assert last <= s < e <= len(t)
        last = e
        toks = scan.tokens(t[s:e])
        assert len(scope.annotate(toks)) == len(toks)
        assert all(0 <= x.start < x.end <= e - s for x in toks)
    values.value_range(text)


json_values = st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4), max_leaves=20)


@settings(max_examples=100, deadline=None)
@given(json_values)
def test_flattening_follows_sorted_keys(v):
    leaves = state.leaves_of(v)
    assert [x[7] for x in leaves] == list(range(len(leaves)))

    def turned(x):
        return {k: turned(x[k]) for k in reversed(x)} if isinstance(x, dict) else [turned(y) for y in x] if isinstance(x, list) else x

    assert state.leaves_of(turned(v)) == leaves


def test_validation_names_the_first_problem():
    ok = '{"q":{"type":"choice","instructions":"x","criteria":{"a":null,"b":null}}}'
    assert validate.problem("quillon-1", '"text"', ok) is None
    assert validate.problem("nope", "17", ok)[:3] == (404, "unknown_model", "model")
    assert validate.problem("quillon-1", "17", ok)[2] == "state"
    assert validate.problem("quillon-1", "{}", '{"q":{"type":"score","criteria":["a"]}}')[2] == "questions.q.criteria"
    assert validate.problem("quillon-1", "[" * 80 + "]" * 80, ok)[2] == "state"
    assert validate.problem("quillon-1", "{}", '{"q":{"type":"noul"}}')[2] == "questions.q.instructions"


def test_families_and_comparators():
    assert question.family("noul", "Is the total more than $5?", [], False) == "numeric" and question.family("choice", "Which?", ["a", "b"], True) == "enum_extraction"
    assert resolvers.comparator("Is it no more than $5?")[0] == "le" and resolvers.comparator("at least 3 days")[0] == "ge"
    assert resolvers.question_day("Was it signed before July 1, 2023?") == (datetime.date(2023, 7, 1), "lt")


def test_fits():
    rng = np.random.default_rng(1)
    k = len(learning.NAMES)
    x, y = [], []
    for _ in range(200):
        r = rng.normal(size=(4, k))
        x.append(r)
        y.append(int(r[:, 3].argmax()))
    w, _ = learning.fit_logit(x, np.array(y), np.array(["f"] * 200), False, epochs=150)
    assert w.argmax() == 3
    assert sum(int((r @ w).argmax()) == t for r, t in zip(x, y, strict=True)) > 190
    logits = [[3.0 * (i == t) + rng.normal() for i in range(3)] for t in rng.integers(0, 3, 300)]
    assert 0 < learning.temperature(logits, [int(np.argmax(z)) for z in logits]) < 1
    a, b = learning.platt(np.array([-2.0, -1, 1, 2] * 20), np.array([0, 0, 1, 1] * 20))
    assert a > 1 and abs(b) < 0.1 and learning.platt(np.zeros(3), np.zeros(3)) == (1.0, 0.0)
    fit = learning.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert list(fit) == [0, 0.5, 0.5, 1]


def test_flags_are_counted_without_token_rows():
    from quillon.functions.kernels import scope
    from quillon.operators import state

    text = "Please don't go. It was not very good; see www.x.org, a.b@c.de or AB-12.\nCould it be 5 km? Dr. Who isn't in"
    rows = state.tokens_of(text)
    masks = [scope.NEGATED, scope.HYPOTHETICAL, scope.REQUEST, scope.CUE]
    assert state.flag_counts(text, masks) == [len(rows), *(sum(1 for r in rows if r[5] & m) for m in masks)]


def test_a_long_text_takes_time_in_proportion():
    import time

    from quillon.functions.kernels import scan

    def took(n):
        t = time.perf_counter()
        scan.segments("ab. " * n + "word " * n)
        return time.perf_counter() - t

    took(1000)
    assert took(80_000) < 10 * max(took(16_000), 0.01)
