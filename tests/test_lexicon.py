"""Lexicon measures by hand, whole evaluations, and preparation of records."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.functions.kernels import scope
from quillon.operators import features, lexicon, metrics, question, sampling, state
from quillon.operators.lexicon import Lexicon
from quillon.plans.decide import decide, feature_table
from quillon.sources import io


@pytest.fixture(scope="module")
def lex(spark):
    return Lexicon(
        valence=spark.createDataFrame([("great", 0.8), ("awful", -0.9), ("slow", -0.3)], "word string, valence double"),
        magnitude=spark.createDataFrame([("minor", 0.2), ("severe", 0.9)], "word string, magnitude double"),
        lemmas=spark.createDataFrame([("refund", "s1", 0), ("repayment", "s1", 0), ("dog", "s2", 0), ("cat", "s3", 0), ("give_back", "s1", 0)], "lemma string, synset string, sense_rank int"),
        edges=spark.createDataFrame([("s2", "hypernym", "s9"), ("s3", "hypernym", "s9"), ("s2", "domain", "zoo"), ("s3", "domain", "zoo")], "synset string, rel string, target string"),
        antonyms=spark.createDataFrame([("open", "closed")], "lemma_a string, lemma_b string"),
    )


def test_tone_by_hand(spark, lex):
    t = spark.createDataFrame([(1, "Great", "great", 0), (1, "slow", "slow", scope.NEGATED), (1, "severe", "sever", 0), (2, "awful", "aw", scope.INTENSIFIED), (3, "word", "word", 0), (4, "!", "!", 0)], "k int, text string, stem string, flags int")
    got = {r["k"]: r for r in lexicon.tone(lexicon.toned(t, lex), ["k"]).collect()}
    assert set(got) == {1, 2}
    assert got[1]["valence"] == pytest.approx(min(1, (0.8 + 0.3 * 0.74) / 2**0.5)) and got[1]["intensity"] == pytest.approx((0.8 + 0.9) / 2)
    assert got[2]["valence"] == -1 and got[2]["intensity"] == pytest.approx(0.9)
    crit = {r["k"]: r for r in lexicon.tone(lexicon.toned(t, lex, criterion=True), ["k"]).collect()}
    assert crit[4]["intensity"] == pytest.approx(0.8) and crit[2]["intensity"] == pytest.approx(1.17)


def test_terms_by_hand(spark, lex):
    by = lex.stemmed()
    st = lambda w: spark.createDataFrame([(w,)], "w string").transform(lambda d: state.stemmed(d, "w")).first()["stem"]
    terms = spark.createDataFrame([("r", 0, st(w), 2.0, 1, False) for w in ("refund", "open", "dog")] + [("r", 1, st("refund"), 1.0, -1, False)], "request_id string, idx int, stem string, w double, polarity int, negated boolean")
    stats = spark.createDataFrame([("r", st("repayment"), 4, 1), ("r", st("closed"), 2, 1), ("r", st("cat"), 1, 0)], "request_id string, stem string, n long, negated long")
    got = {r["idx"]: r for r in lexicon.term_measures(terms, stats, ["request_id", "idx"], by, features.rarity).collect()}
    assert got[0]["syn"] == pytest.approx(0.6 * 2 * 0.75) and got[0]["ant"] == pytest.approx(1.0) and got[0]["ant_neg"] == pytest.approx(1.0)
    # refund shares its sense with repay (idf .6), dog an ancestor with cat (idf .45), one step up on either side
    assert got[0]["graph_w"] == 6.0 and got[0]["hyper"] == pytest.approx(2 * 0.6 + 2 * 0.45 * 0.75 * 0.75) and got[0]["domain"] == pytest.approx(2 * 0.45)
    assert all(got[1][n] == 0 for n in ("syn", "ant", "ant_neg", "graph_w", "hyper", "domain"))


def test_features_take_lexicons(spark, lex):
    qs = {"tone": io.score("How severe is the complaint?", ["minor trouble", "trouble", "severe trouble"]), "mood": io.choice("Which mood?", {"happy": "great service", "angry": "awful service"})}
    r = spark.createDataFrame([("a", "quillon-1", json.dumps({"note": "The service was awful. A severe delay."}), json.dumps(qs))], "request_id string, model string, state string, questions string")
    leaves = state.flatten(r, "request_id", "state")
    asked = question.questions(r)
    f = feature_table(leaves, state.token_rows(leaves, "request_id"), asked, question.criteria(asked), lex=lex)
    got = {(x["question_id"], x["idx"]): x for x in f.collect()}
    assert got["mood", 0]["valence_agree"] < 0 < got["mood", 1]["valence_agree"] and got["mood", 1]["valence_abs"] == pytest.approx(0.9)
    assert got["tone", 2]["intensity_cov"] == 1 and got["tone", 2]["intensity_dist"] > got["tone", 0]["intensity_dist"] and got["tone", 2]["ord_hit"] == 1 and got["tone", 0]["ord_hit"] == 0
    bare = feature_table(leaves, state.token_rows(leaves, "request_id"), asked, question.criteria(asked)).collect()
    assert all(x[n] == 0 for x in bare for n in features.LEXICAL) and len(bare) == len(got)
    assert decide(r, lex=lex).where("error is null").count() == 2


def test_cross_antonyms(spark, lex):
    t = spark.createDataFrame([("q", "open", 0.5, 2, 0, 0, 0), ("q", "close", 0.6, 0, 2, 0, 1), ("q", "dog", 0.4, 1, 1, 0, 0)], "q string, stem string, w double, na int, nb int, ga int, gb int")
    assert lexicon.cross_antonyms(t, ["q"], lex.stemmed()).first()["antonym"] == pytest.approx(0.25)


def test_truncation(spark):
    cut = lambda t, n: spark.range(1).select(sampling.truncated(F.lit(t).cast("string"), n)).first()[0]
    assert cut("short", 30) == "short" and cut(None, 30) is None and cut("", 30) == ""
    assert cut("One sentence here. Another one that goes on", 34) == "One sentence here." + sampling.MARKER
    assert cut("word " * 20, 40) == ("word " * 5).strip() + sampling.MARKER
    assert cut("x" * 100, 40) == "x" * 28 + sampling.MARKER


def test_pairs_and_missing_answers(spark):
    g = spark.createDataFrame([("a", 1, 1, True), ("a", 1, 0, True), ("b", 1, 1, True), ("b", 0, 1, False), ("c", 1, 1, True)], "g string, predicted int, correct int, valid boolean")
    r = metrics.pair_agreement(g, "g", "predicted", "correct", "valid").first()
    assert (r["pairs"], r["both_valid"], r["agree"], r["both_correct"], r["agreement"]) == (2, 1, 1, 0, 1.0)
    assert metrics.pair_agreement(g.where("false"), "g", "predicted", "correct", "valid").first()["agreement"] is None
    tasks = spark.createDataFrame([(1, 1), (2, 0)], "id int, gold int")
    j = {x["id"]: x for x in metrics.judged_tasks(tasks, tasks.where("id = 1").select("id", F.col("gold").alias("a")), ["id"], "a", "gold").collect()}
    assert j[1]["correct"] == 1 and j[2]["correct"] == 0 and not j[2]["attempted"]
