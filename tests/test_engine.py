"""Column functions and whole plans on small tables."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quillon.functions import strings as S
from quillon.functions import vectors as V
from quillon.operators import metrics, neardup, ranking, resolvers, sampling
from quillon.plans.decide import decide
from quillon.sources import io


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_range_answer_by_hand(spark):
    z = F.array(*map(F.lit, [-2.0, -2.0, 6.0, -1.752, -1.9752]))
    p = V.mixed(V.softmax(z), 1 / 11)
    assert value(spark, p) == pytest.approx([0.018486, 0.018486, 0.925961, 0.018572, 0.018494], abs=1e-6)
    s = V.ordinal_smoothed(p, 0.05)
    assert value(spark, s) == pytest.approx([0.019697, 0.059617, 0.841283, 0.059695, 0.019708], abs=1e-6)
    assert value(spark, V.expected_level(s)) == pytest.approx(2.000099, abs=1e-6)
    assert value(spark, V.concentration(s)) == pytest.approx(0.604520, abs=1e-6) and value(spark, V.margin(s)) == pytest.approx(0.781589, abs=1e-6)
    assert [value(spark, resolvers.noul(F.lit(x))) for x in (4.8, -4.8, -3.6)] == pytest.approx([0.987634, 0.012366, 0.030643], abs=1e-6)
    assert sum(value(spark, V.softmax(F.array(*[F.lit(float(i)) for i in range(255)])))) == 1.0


def test_strings(spark):
    assert value(spark, S.key_words(F.lit("orderTotal_v2-max.name"))) == ["order", "total", "v", "2", "max", "name"]
    assert value(spark, S.literal_count(F.lit("red redder RED, red."), F.lit("red"))) == 3
    assert value(spark, S.shingles(F.split(F.lit("a b c d"), " "), 3)) == ["a b c", "b c d"] and value(spark, S.shingles(F.split(F.lit("a b"), " "), 3)) == ["a b"]
    assert len(value(spark, S.char_grams(F.lit("ab!c")))) == 3


def test_ranks_and_auroc_against_plain_code(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, round(rng.random(), 2), rng.randint(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id long, p double, y int")
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        got = {r["id"]: (r["rank"], r["rank_of"]) for r in ranking.ranked(df, ["g"], "p", ["id"]).where(F.col("g") == g).collect()}
        assert got == {r[1]: (i + 1, len(own)) for i, r in enumerate(own)}
        pos, neg = [r[2] for r in own if r[3]], [r[2] for r in own if not r[3]]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        assert ranking.auroc(df, ["g"], "p", "y").where(F.col("g") == g).first()["auroc"] == pytest.approx(want)
    assert metrics.ece(df.withColumns({"confidence": F.col("p"), "correct": F.col("y")}), ["g"], 10).count() == 2


def test_lsh_finds_what_the_exact_join_finds(spark):
    import random

    rng = random.Random(3)
    base = [[f"w{rng.randrange(300)}" for _ in range(80)] for _ in range(12)]
    rows = []
    for i, b in enumerate(base):
        for k in range(4):
            w = [*b]
            if k:
                w[rng.randrange(80)] = f"x{k}"
            rows.append((4 * i + k, " ".join(w)))
    docs = spark.createDataFrame([*rows, (100, ""), (101, None), (102, rows[0][1])], "doc_id long, text string")
    members, sets = neardup.classes(docs)
    exact = {(r["a"], r["b"]) for r in neardup.similar_sets(sets).collect()}
    words = {i: t.split() for i, t in rows}
    sh = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    assert exact == {(a, b) for a in sh for b in sh if a < b and 100 * len(sh[a] & sh[b]) >= 80 * len(sh[a] | sh[b])}
    keyed = sets.withColumnRenamed("class_id", "key")
    found = {(r["a"], r["b"]) for r in neardup.verified(neardup.lsh_pairs(keyed, keyed).where("a < b"), sets, 80).collect()}
    assert found <= exact and len(found) >= 0.85 * len(exact)
    assert neardup.linked_classes(docs, neardup.similar_sets(sets), members).count() == docs.count()


def test_lsh_bands_lose_no_pair_at_the_threshold(spark):
    sets = [(i, [f"{i}-{j}" for j in range(80)]) for i in range(200)]  # Jaccard 80 / 100
    left = spark.createDataFrame([(i, [*s, *(f"{i}-a{j}" for j in range(10))]) for i, s in sets], "key long, sh array<string>")
    right = spark.createDataFrame([(i, [*s, *(f"{i}-b{j}" for j in range(10))]) for i, s in sets], "key long, sh array<string>")
    assert neardup.lsh_pairs(left, right).where("a = b").count() == 200


def requests(spark, rows):
    return spark.createDataFrame([io.request_row(*r) for r in rows], io.REQUESTS)


def test_decisions_keep_the_contract(spark):
    dep = {"billing": "payments, invoices and refunds", "shipping": "parcels, couriers and tracking", "technical": "crashes and login errors"}
    qs = {
        "route": io.choice("Which department should handle this?", dep),
        "level": io.score("How large is the total?", ["Under $100", "$100 to $1,000", "Over $1,000"]),
        "paid": io.noul("Was it paid?"),
        "big": io.noul("Is the total more than $100?"),
    }
    state = {"body": "My parcel is late; tracking says the courier lost it. Total $450.00.", "paid": True}
    rows = [("a", state, qs), ("b", dict(reversed(state.items())), {"route": io.choice("Which department should handle this?", dict(reversed(dep.items())))}), ("c", 17, qs)]
    got = {(r["request_id"], r["question_id"]): r for r in decide(requests(spark, rows)).collect()}
    a = got["a", "route"]
    assert a["choice"] == "shipping" and [p["key"] for p in a["probabilities"]] == list(dep)
    assert sum(p["p"] for p in a["probabilities"]) == pytest.approx(1, abs=1e-9)
    b = got["b", "route"]
    assert {p["key"]: p["p"] for p in b["probabilities"]} == pytest.approx({p["key"]: p["p"] for p in a["probabilities"]}, abs=1e-9)
    assert got["a", "level"]["path"] == "numeric_range" and round(got["a", "level"]["score"]) == 1
    assert got["a", "paid"]["noul"] > 0.9 and got["a", "big"]["noul"] > 0.9
    assert got["c", None]["error"].startswith("422 state")
    assert all(0 <= r["confidence"] <= 1 for r in got.values() if r["error"] is None)


def test_records_are_read_and_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_text('# note\n\n{"id":"1","split":"dev","request":{"a":1},"gold":{"q":"x"},"tier":"easy","more":7}\n')
    r = io.read_records(spark, str(tmp_path / "in"))
    row = io.extra(r, "more").first()
    assert (row["id"], json.loads(row["request"]), row["gold"], row["more"]) == ("1", {"a": 1}, {"q": "x"}, "7")
    io.write_records(r.select("id", "split"), str(tmp_path / "out"), 1)
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError):
        io.check_model({}, {"temperature": {"global": 0.0}})


def test_splits_and_samples(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("label"), F.floor(F.col("id") / 10).cast("string").alias("g"))
    s = sampling.split(df, "g")
    assert s.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    picked = sampling.round_robin(df, "label", "id", 10)
    assert sorted(r["count"] for r in picked.groupBy("label").count().collect()) == [3, 3, 4]


def test_entry_works_without_the_optional_parts():
    code = "import sys; sys.modules['quillon.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_features_of_named_fields_pairs_and_windows(spark):
    from quillon.operators import question, state
    from quillon.plans.decide import feature_table

    def rows(st, qs):
        r = spark.createDataFrame([("r", "quillon-1", json.dumps(st), json.dumps(qs))], "request_id string, model string, state string, questions string")
        leaves = state.flatten(r, "request_id", "state")
        asked = question.questions(r)
        f = feature_table(leaves, state.token_rows(leaves, "request_id"), asked, question.criteria(asked))
        return {(x["question_id"], x["key"]): x for x in f.collect()}

    st = {"answer": "The parcel weighs 12 kilos. The parcel is not damaged.", "note": "urgent refund", "question": "The parcel weighs 15 kilos and is damaged."}
    qs = {"pair": io.noul("Does `answer` agree with `question`?"), "pick": io.choice("What is in `note`?", {"refund": "a refund", "parcel": "a parcel"})}
    f = rows(st, qs)
    yes, no = f["pair", "true"], f["pair", "false"]
    # stems parcel (.6), weigh (.6), kilo (.45), damag (.6) are shared, as are none of the numbers 12 and 15 (.2)
    assert yes["xfield_available"] == 1 and yes["xfield_cov_ab"] == pytest.approx(2.25 / 2.45) and yes["xfield_cov_ba"] == pytest.approx(2.25 / 2.45)
    assert yes["xfield_jaccard"] == pytest.approx(4 / 6) and 0.5 < yes["xfield_cos"] < 1 and 0.5 < yes["xfield_gram"] < 1
    assert yes["xfield_neg_conflict"] == pytest.approx(0.6 / 2.45) and yes["xfield_num_conflict"] == 1
    assert no["xfield_available"] == 0 and no["xfield_cov_ab"] == 0
    assert f["pick", "refund"]["focus_cov"] > 0 and f["pick", "refund"]["focus_literal"] == 1
    assert f["pick", "parcel"]["cov_w"] > 0 and f["pick", "parcel"]["focus_cov"] == 0 and f["pick", "parcel"]["focus_literal"] == 0
    ask = {"w": io.noul("Is the return allowed?")}
    for text, want in (("Returns within 30 days. Bought 20 days ago.", 1), ("Returns within 30 days. Bought 45 days ago.", -1), ("Bought 45 days ago.", 0), ("Today is 2026-03-10. Returns within 30 days. Bought on 2026-01-05.", -1)):
        f = rows({"text": text}, ask)
        assert (f["w", "true"]["window_ok"], f["w", "false"]["window_ok"]) == (want, 0)


def test_sets_are_shipped_as_hashes_and_bands_run_in_numpy(spark):
    from quillon.functions.kernels import sets as K

    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b"), (4, "A, b!")], "doc_id long, text string")
    members, sets = neardup.classes(docs)
    assert {r["class_id"]: len(r["sh"]) for r in sets.collect()} == {1: 3, 3: 1} and sets.schema["sh"].dataType.elementType.typeName() == "long"
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    x = K.shingled(range(9000), 5)
    assert len(x) == 8996 and len(set(K.bands(x, 32, 4))) == 32 and list(K.bands(x[::-1], 32, 4)) == list(K.bands(x, 32, 4))


def test_similar_sets_are_all_found_under_any_order(spark):
    import random

    rng = random.Random(5)
    sets = [(i, sorted({f"s{rng.randrange(7)}" for _ in range(rng.randrange(1, 25))})) for i in range(60)]
    for percent in (50, 80):
        got = {(r["a"], r["b"]): r["jaccard"] for r in neardup.similar_sets(spark.createDataFrame(sets, "class_id long, sh array<string>"), percent).collect()}
        want = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in sets for j, b in sets if i < j and 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))}
        assert got == pytest.approx(want) and len(want) > 0


def test_small_eval_sides_are_not_met_by_a_shuffle_of_the_corpus(spark):
    t = spark.createDataFrame([(i, f"the same long enough text number {i}") for i in range(9)] + [(9, "The same long-enough text number 3")], "key long, text string")
    e = spark.createDataFrame([(1, "the same long enough text number 3"), (2, "nothing of it occurs anywhere here")], "key long, text string")
    big = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = neardup.scan(t, e)
        got = {r["key"]: (r["verdict"], r["exact"], r["normalized"], r["near"]) for r in out.collect()}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", big)
    assert got == {1: ("exact", 1, 2, 2), 2: ("clean", 0, 0, 0)} and plan.count("rightHint=(strategy=broadcast)") >= 3
