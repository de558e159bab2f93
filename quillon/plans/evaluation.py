"""Catalogue, part 3: whole evaluations, data preparation, and lexicon measures over lexicons made of the tables' own words; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions.kernels import scope
from ..operators import features, lexicon, metrics, sampling
from .lexical import NORM, TOKENS, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


JUDGED_SQL = """d AS (SELECT doc_id, source, lang, n_chars, quality AS y, 1 / (1 + exp(-(n_chars % 1000 - 300) / 400.0)) AS p FROM documents JOIN labels USING (doc_id)),
o AS (SELECT *, greatest(p, 1 - p) AS conf, doc_id % 7 <> 6 AS valid, doc_id % 7 = 3 AS strict, CASE WHEN (p >= 0.5) = (y = 1) AND doc_id % 7 <> 6 THEN 1 ELSE 0 END AS correct,
  -ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12)) AS nll, 2 * (p - y) ** 2 AS brier, abs(p - (0.9 * y + 0.05)) AS tvd, abs(p - y) AS mae FROM d)"""


def judged(spark, sf) -> DataFrame:
    """Statements judged true with a probability that the document's size decides; one in seven answers is no distribution."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    d = d.select("doc_id", "source", "lang", "n_chars", F.col("quality").alias("y"), (1 / (1 + F.exp(-(F.col("n_chars") % 1000 - 300) / 400.0))).alias("p"))
    soft, m = 0.9 * F.col("y") + 0.05, F.col("doc_id") % 7
    return metrics.noul_metrics(d).withColumns({
        "valid": m != 6, "strict": m == 3, "mae": F.abs(F.col("p") - F.col("y")), "tvd": metrics.total_variation(F.array("p", 1 - F.col("p")), F.array(soft, 1 - soft)),
    })


MEASURES = "accuracy nll brier ece10 ece15 validity strict tvd mae selective auroc".split()


@query(f"""WITH {JUDGED_SQL}, c AS (SELECT 'group' AS cut, source AS name, * FROM o UNION ALL SELECT 'kind', lang, * FROM o UNION ALL SELECT 'all', '', * FROM o),
m AS (SELECT cut, name, count(*) AS n, avg(correct) AS accuracy, avg(nll) AS nll, avg(brier) AS brier, avg(valid::INT) AS validity, avg(strict::INT) AS strict, avg(tvd) AS tvd, avg(mae) AS mae FROM c GROUP BY ALL),
b10 AS (SELECT cut, name, least(floor(conf * 10), 9) AS b, count(*) AS n, sum(correct) AS k, sum(conf) AS s FROM c GROUP BY ALL), e10 AS (SELECT cut, name, sum(abs(k - s)) / sum(n) AS ece10 FROM b10 GROUP BY ALL),
b15 AS (SELECT cut, name, least(floor(conf * 15), 14) AS b, count(*) AS n, sum(correct) AS k, sum(conf) AS s FROM c GROUP BY ALL), e15 AS (SELECT cut, name, sum(abs(k - s)) / sum(n) AS ece15 FROM b15 GROUP BY ALL),
r AS (SELECT cut, name, correct, y, row_number() OVER (PARTITION BY cut, name ORDER BY conf DESC, doc_id) AS i, count(*) OVER (PARTITION BY cut, name) AS n,
  rank() OVER (PARTITION BY cut, name ORDER BY p) + (count(*) OVER (PARTITION BY cut, name, p) - 1) / 2.0 AS mid FROM c),
s AS (SELECT cut, name, avg(correct) FILTER (i <= greatest(n // 2, 1)) AS selective, sum(y) AS np, count(*) - sum(y) AS nn, sum(CASE WHEN y = 1 THEN mid ELSE 0 END) AS rp FROM r GROUP BY cut, name)
SELECT cut, name, n, {", ".join(f"round({m}, 6) AS {m}" for m in MEASURES[:-1])}, round(CASE WHEN np > 0 AND nn > 0 THEN (rp - np * (np + 1) / 2.0) / (np * nn) END, 6) AS auroc
FROM m JOIN e10 USING (cut, name) JOIN e15 USING (cut, name) JOIN s USING (cut, name)""")
def evaluation_full(spark, sf):
    e = metrics.evaluation(judged(spark, sf), "source", "lang", ["doc_id"])
    return e.select("cut", "name", "n", *(F.round(m, 6).alias(m) for m in MEASURES))


@query(f"""WITH {JUDGED_SQL}, s AS (SELECT source, avg(correct) AS accuracy, avg(brier) AS brier, avg(nll) AS nll FROM o GROUP BY source)
SELECT count(*) AS configs, round(avg(accuracy), 6) AS macro_accuracy, round(avg(nll), 6) AS macro_nll, round(avg(brier), 6) AS macro_brier FROM s""")
def macro_means(spark, sf):
    e = metrics.evaluation(judged(spark, sf), "source", "lang", ["doc_id"]).where("cut = 'group'")
    m = metrics.macro(e, ["accuracy", "nll", "brier"])
    return m.select("configs", *(F.round(f"macro_{c}", 6).alias(f"macro_{c}") for c in ("accuracy", "nll", "brier")))


@query(f"""WITH {JUDGED_SQL}, t AS (SELECT d.source, 2 + d.doc_id % 4 AS options, o.y, CASE WHEN d.doc_id % 9 <> 0 THEN (o.p >= 0.5)::INT END AS answer FROM documents d JOIN o USING (doc_id)),
s AS (SELECT source, count(*) AS planned, count(answer) AS attempted, avg(CASE WHEN answer = y THEN 1 ELSE 0 END) AS accuracy, avg(1.0 / options) AS chance FROM t GROUP BY source)
SELECT source, planned, attempted, round(accuracy, 6) AS accuracy, round(chance, 6) AS chance, round(greatest(0, least(100, 100 * (accuracy - chance) / (1 - chance))), 6) AS intelligence FROM s""")
def chance_intelligence(spark, sf):
    """Tasks joined with the answers there are; what was not answered is wrong."""
    j = judged(spark, sf)
    tasks = j.select("doc_id", "source", "y", (2 + F.col("doc_id") % 4).alias("options"))
    t = metrics.judged_tasks(tasks, j.where("doc_id % 9 <> 0").select("doc_id", (F.col("p") >= 0.5).cast("int").alias("answer")), ["doc_id"], "answer", "y")
    s = t.groupBy("source").agg(F.count("*").alias("planned"), F.count_if("attempted").alias("attempted"), F.avg("correct").alias("accuracy"), F.avg(1.0 / F.col("options")).alias("chance"))
    return s.select("source", "planned", "attempted", F.round("accuracy", 6).alias("accuracy"), F.round("chance", 6).alias("chance"), F.round(metrics.intelligence(F.col("accuracy"), F.col("chance")), 6).alias("intelligence"))


@query(f"""WITH {JUDGED_SQL}, g AS (SELECT doc_id // 5 * 2 + (doc_id % 5 >= 2)::INT AS grp, (p >= 0.5)::INT AS predicted, correct, valid FROM o),
t AS (SELECT grp, bool_and(valid) AS ok, min(predicted) = max(predicted) AS same, min(correct) = 1 AS right_ FROM g GROUP BY grp HAVING count(*) = 2)
SELECT count(*) AS pairs, count(*) FILTER (ok) AS both_valid, count(*) FILTER (ok AND same) AS agree, count(*) FILTER (ok AND right_) AS both_correct,
  round(count(*) FILTER (ok AND same) / nullif(count(*) FILTER (ok), 0), 6) AS agreement, round(count(*) FILTER (ok AND right_) / nullif(count(*), 0), 6) AS both_correct_rate FROM t""")
def paraphrase_agreement(spark, sf):
    j = judged(spark, sf).select(
        (F.floor(F.col("doc_id") / 5) * 2 + (F.col("doc_id") % 5 >= 2).cast("int")).alias("grp"), (F.col("p") >= 0.5).cast("int").alias("predicted"), (F.col("correct") * F.col("valid").cast("int")).alias("correct"), "valid"
    )
    a = metrics.pair_agreement(j, "grp", "predicted", "correct", "valid")
    return a.select("pairs", "both_valid", "agree", "both_correct", F.round("agreement", 6).alias("agreement"), F.round("both_correct_rate", 6).alias("both_correct_rate"))


@query("""WITH s AS (SELECT doc_id, ('0x' || substr(sha256(cast(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 AS h FROM documents)
SELECT CASE WHEN h < 60 THEN 'train' WHEN h < 80 THEN 'calib' ELSE 'dev' END AS split, count(*) FILTER (toxic = 0) AS label_0, count(*) FILTER (toxic = 1) AS label_1 FROM s JOIN labels USING (doc_id) GROUP BY 1""")
def label_counts(spark, sf):
    d = sampling.split(table(spark, sf, "documents").select("doc_id"), "doc_id").join(table(spark, sf, "labels"), "doc_id")
    return sampling.label_counts(d, "split", "toxic", [0, 1])


@query(f"""WITH n AS (SELECT doc_id, md5({NORM}) AS k FROM documents) SELECT doc_id FROM n WHERE doc_id % 10 <> 0 AND k NOT IN (SELECT k FROM n WHERE doc_id % 10 = 0)""")
def unseen_train(spark, sf):
    """Training texts that occur, normalised, in no development text."""
    n = table(spark, sf, "documents").select("doc_id", F.md5(S.normalized(F.col("text"))).alias("k"))
    return sampling.unseen(n.where("doc_id % 10 <> 0"), n.where("doc_id % 10 = 0"), "k").select("doc_id")


def last_sql(part: str) -> str:
    lit, back = ("(" + " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in x) + ")" for x in (part, part[::-1]))
    return f"CASE WHEN contains(cut, {lit}) THEN length(cut) - instr(reverse(cut), {back}) - {len(part) - 1} ELSE -1 END"


@query(f"""WITH c AS (SELECT doc_id, text, substr(text, 1, {300 - 12}) AS cut FROM documents), e AS (SELECT *, greatest({", ".join(map(last_sql, sampling.ENDS))}) AS a, {last_sql(" ")} AS b FROM c),
f AS (SELECT *, CASE WHEN a >= 150 THEN a WHEN b >= 150 THEN b ELSE length(cut) - 1 END AS z FROM e)
SELECT doc_id, md5(CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(substr(cut, 1, z + 1), '\\s+$', '') || ' [truncated]' END) AS digest FROM f""")
def truncated_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(sampling.truncated(F.col("text"), 300)).alias("digest"))


@query("""SELECT CASE WHEN p_size <= 2 THEN '2' WHEN p_size <= 4 THEN '3-4' WHEN p_size <= 8 THEN '5-8' WHEN p_size <= 16 THEN '9-16' ELSE '17+' END AS options,
CASE WHEN p_retailprice < 64 THEN '<64' WHEN p_retailprice < 256 THEN '64-256' WHEN p_retailprice < 1024 THEN '256-1k' ELSE '1k+' END AS length, count(*) AS n FROM part GROUP BY ALL""")
def analysis_buckets(spark, sf):
    p = table(spark, sf, "part")
    return p.groupBy(sampling.option_bucket(F.col("p_size")).alias("options"), sampling.length_bucket(F.col("p_retailprice")).alias("length")).agg(F.count("*").alias("n"))


# Lexicons made of the tables' own words by rules that both engines know, so that every join of the lexicon operators has something to find.


def vocabulary(df: DataFrame) -> DataFrame:
    return df.select(F.explode(S.words(F.col("text"))).alias("word")).distinct()


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS a FROM documents), w AS (SELECT doc_id, unnest(a) AS word, unnest([NULL] || a[:-2]) AS prev FROM t WHERE len(a) > 0),
x AS (SELECT doc_id, ((ascii(word) * 7 + length(word) * 3) % 21 - 10) / 10.0 AS raw, CASE WHEN ascii(word) % 7 = 0 THEN (length(word) % 10) / 10.0 END AS mag, coalesce(length(prev), 0) AS l FROM w),
y AS (SELECT doc_id, raw * CASE l WHEN 2 THEN -0.74 WHEN 3 THEN 1.3 WHEN 4 THEN 0.6 ELSE 1 END AS v, CASE WHEN mag IS NOT NULL THEN CASE WHEN l = 2 THEN 1 - mag ELSE mag END WHEN abs(raw) >= 0.6 THEN abs(raw) END AS m FROM x)
SELECT doc_id, round(greatest(-1, least(1, coalesce(sum(v) FILTER (v <> 0) / sqrt(count(*) FILTER (v <> 0)), 0))), 6) AS valence, round(avg(m), 6) AS intensity FROM y WHERE v <> 0 OR m IS NOT NULL GROUP BY doc_id""")
def document_tone(spark, sf):
    """Valence and intensity of documents; the word before a word sets its scope."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    vocab = vocabulary(d)
    code = F.ascii("word") * 7 + F.length("word") * 3
    lex = lexicon.Lexicon(valence=vocab.select("word", ((code % 21 - 10) / 10.0).alias("valence")), magnitude=vocab.where(F.ascii("word") % 7 == 0).select("word", ((F.length("word") % 10) / 10.0).alias("magnitude")))
    pairs = S.let(S.words(F.col("text")), lambda a: F.transform(a, lambda x, i: F.struct(x.alias("text"), F.when(i > 0, F.length(F.get(a, i - 1))).alias("before"))))
    flag = F.when(F.col("before") == 2, scope.NEGATED).when(F.col("before") == 3, scope.INTENSIFIED).when(F.col("before") == 4, scope.DIMINISHED).otherwise(0)
    t = d.select("doc_id", F.explode(pairs).alias("w")).select("doc_id", "w.text", F.col("w.text").alias("stem"), F.col("w.before").alias("before")).select("doc_id", "text", "stem", flag.alias("flags"))
    return lexicon.tone(lexicon.toned(t, lex), ["doc_id"]).select("doc_id", F.round("valence", 6).alias("valence"), F.round("intensity", 6).alias("intensity"))


IDF = "CASE WHEN length({0}) <= 2 THEN 0.2 WHEN length({0}) <= 4 THEN 0.45 WHEN length({0}) <= 7 THEN 0.6 ELSE 0.75 END"
GRAPH_SQL = f"""w AS (SELECT conv_id AS request_id, turn, unnest({TOKENS}) AS stem FROM conversations), here AS (SELECT request_id, stem, count(*) FILTER (turn % 2 = 1) / count(*) AS neg FROM w GROUP BY ALL),
bw AS (SELECT item_id, unnest({TOKENS}) AS stem FROM benchmark), bt AS (SELECT DISTINCT item_id, stem, 1.0 + length(stem) % 3 AS w FROM bw), items AS (SELECT count(*) AS k FROM benchmark),
conv AS (SELECT DISTINCT request_id FROM w), plus AS (SELECT request_id, item_id AS idx, stem, w FROM conv, items, bt WHERE item_id % 10 = request_id % 10),
vocab AS (SELECT DISTINCT stem FROM (SELECT stem FROM w UNION ALL SELECT stem FROM bw)), ant AS (SELECT stem AS a, lead(stem) OVER (ORDER BY stem) AS b FROM vocab),
opp AS (SELECT a AS stem, b AS other FROM ant WHERE b IS NOT NULL UNION SELECT b, a FROM ant WHERE b IS NOT NULL),
sense AS (SELECT stem, 's' || left(stem, 3) AS synset, 1 AS n FROM vocab UNION ALL SELECT stem, 't' || right(stem, 4), 2 FROM vocab)"""


def graph_tables(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("request_id"), "turn", F.explode(S.words(F.col("text"))).alias("stem"))
    stats = c.groupBy("request_id", "stem").agg(F.count("*").alias("n"), F.count_if(F.col("turn") % 2 == 1).alias("negated"))
    b = table(spark, sf, "benchmark").select("item_id", F.explode(S.words(F.col("text"))).alias("stem"))
    own = b.distinct().select(F.col("item_id").alias("idx"), "stem", (1.0 + F.length("stem") % 3).alias("w"), (F.col("item_id") % 10).alias("slot"))
    terms = c.select("request_id", (F.col("request_id") % 10).alias("slot")).distinct().join(F.broadcast(own), "slot").select("request_id", "idx", "stem", "w", F.lit(1).alias("polarity"), F.lit(False).alias("negated"))
    vocab = c.select("stem").union(b.select("stem")).distinct()
    lemmas = vocab.select(F.col("stem").alias("lemma"), F.concat(F.lit("s"), F.substring("stem", 1, 3)).alias("synset"), F.lit(0).alias("sense_rank"))
    lemmas = lemmas.union(vocab.select("stem", F.concat(F.lit("t"), F.right(F.col("stem"), F.lit(4))), F.lit(1)))
    first = lemmas.where("sense_rank = 0").select("synset").distinct()
    edges = first.select("synset", F.lit("hypernym").alias("rel"), F.concat(F.lit("h"), F.substring("synset", 2, 1)).alias("target"))
    edges = edges.union(first.select("synset", F.lit("domain"), F.concat(F.lit("d"), (F.ascii(F.substring("synset", 2, 1)) % 5).cast("string"))))
    return terms, stats, vocab, lexicon.Lexicon(lemmas=lemmas, edges=edges)


@query(f"""WITH {GRAPH_SQL}, absent AS (SELECT p.* FROM plus p WHERE NOT EXISTS (SELECT 1 FROM here h WHERE h.request_id = p.request_id AND h.stem = p.stem)),
o AS (SELECT a.stem, b.stem AS other, min(a.n) AS sense FROM sense a JOIN sense b ON a.synset = b.synset AND a.stem <> b.stem GROUP BY ALL),
c AS (SELECT a.request_id, a.idx, a.stem AS source, a.w, o.other, row_number() OVER (PARTITION BY a.request_id, a.idx, a.stem ORDER BY o.sense, o.other) AS n FROM absent a JOIN o ON o.stem = a.stem
  WHERE NOT EXISTS (SELECT 1 FROM plus p WHERE p.request_id = a.request_id AND p.idx = a.idx AND p.stem = o.other)),
f AS (SELECT c.request_id, c.idx, source, arg_min(0.6 * w * (1 - neg), n) AS x FROM c JOIN here h ON h.request_id = c.request_id AND h.stem = c.other WHERE n <= 12 GROUP BY ALL),
syn AS (SELECT request_id, idx, sum(x) AS syn FROM f GROUP BY ALL),
g AS (SELECT p.request_id, p.idx, e.other, max(p.w) AS w, max(h.neg) AS neg FROM plus p JOIN opp e ON e.stem = p.stem JOIN here h ON h.request_id = p.request_id AND h.stem = e.other GROUP BY ALL),
a AS (SELECT request_id, idx, sum(w * (1 - neg)) AS ant, sum(w * neg) AS ant_neg FROM g GROUP BY ALL), k AS (SELECT DISTINCT request_id, idx FROM plus)
SELECT k.request_id, k.idx, round(coalesce(syn, 0), 6) AS syn, round(coalesce(ant, 0), 6) AS ant, round(coalesce(ant_neg, 0), 6) AS ant_neg FROM k LEFT JOIN syn USING (request_id, idx) LEFT JOIN a USING (request_id, idx)""")
def synonym_antonym_terms(spark, sf):
    """Benchmark items as criteria of conversations: synonyms of terms that are absent, and opposites that occur."""
    terms, stats, vocab, lex = graph_tables(spark, sf)
    nxt = vocab.select("stem").join(_next_words(vocab), "stem")
    lex = lexicon.Lexicon(lemmas=lex.lemmas, antonyms=nxt.select(F.col("stem").alias("lemma_a"), F.col("following").alias("lemma_b")))
    m = lexicon.term_measures(terms, stats, ["request_id", "idx"], lex, features.rarity)
    return m.select("request_id", "idx", *(F.round(n, 6).alias(n) for n in ("syn", "ant", "ant_neg")))


def _next_words(vocab: DataFrame) -> DataFrame:
    from ..operators.ranking import ranked

    r = ranked(vocab.withColumn("len", F.ascii("stem")), [], "len", ["stem"], name="at").select("stem", "at")
    return r.join(r.select(F.col("stem").alias("following"), (F.col("at") - 1).alias("at")), "at").select("stem", "following")


@query(f"""WITH {GRAPH_SQL}, up AS (SELECT stem, synset, 1.0 AS decay FROM sense UNION SELECT stem, 'h' || left(stem, 1), 0.75 FROM vocab), topic AS (SELECT stem, 'd' || cast(ascii(stem) % 5 AS VARCHAR) AS topic FROM vocab),
wt AS (SELECT request_id, stem, {IDF.format("stem")} AS idf FROM here WHERE length(stem) >= 3), r AS (SELECT request_id, synset, max(idf * decay) AS weight FROM wt JOIN up USING (stem) GROUP BY ALL),
told AS (SELECT request_id, topic, max(idf) AS weight FROM wt JOIN topic USING (stem) GROUP BY ALL), fit AS (SELECT p.*, h.stem IS NOT NULL AS hit FROM plus p LEFT JOIN here h ON h.request_id = p.request_id AND h.stem = p.stem WHERE length(p.stem) >= 3),
u AS (SELECT f.request_id, f.idx, f.stem, least(1, max(decay * weight)) AS x FROM fit f JOIN up USING (stem) JOIN r ON r.request_id = f.request_id AND r.synset = up.synset WHERE NOT hit GROUP BY ALL),
d AS (SELECT f.request_id, f.idx, f.stem, least(1, max(weight)) AS x FROM fit f JOIN topic USING (stem) JOIN told ON told.request_id = f.request_id AND told.topic = topic.topic WHERE NOT hit GROUP BY ALL)
SELECT f.request_id, f.idx, round(sum(w), 6) AS graph_w, round(sum(w * CASE WHEN hit THEN 1 ELSE coalesce(u.x, 0) END), 6) AS hyper, round(sum(w * CASE WHEN hit THEN 1 ELSE coalesce(d.x, 0) END), 6) AS domain
FROM fit f LEFT JOIN u ON u.request_id = f.request_id AND u.idx = f.idx AND u.stem = f.stem LEFT JOIN d ON d.request_id = f.request_id AND d.idx = f.idx AND d.stem = f.stem GROUP BY ALL""")
def hypernym_domain_terms(spark, sf):
    """How much of each criterion's weight the conversation meets by the word itself, by something above both, or by a shared topic."""
    terms, stats, _, lex = graph_tables(spark, sf)
    m = lexicon.term_measures(terms, stats, ["request_id", "idx"], lex, features.rarity)
    return m.select("request_id", "idx", *(F.round(n, 6).alias(n) for n in ("graph_w", "hyper", "domain")))


@query("""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS idx, l_discount * 10 - 0.5 AS val, l_quantity / 50.0 AS inten FROM lineitem),
s AS (SELECT o_orderkey AS k, (o_orderkey % 21 - 10) / 10.0 AS sv, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 11) / 10.0 END AS si FROM orders), t AS (SELECT k, idx, val, inten, sv, si, idx / greatest(max(idx) OVER (PARTITION BY k), 1) AS place, max(idx) OVER (PARTITION BY k) AS top FROM l JOIN s USING (k)),
r AS (SELECT k, any_value(top) AS top, any_value(sv) AS sv, any_value(si) AS si, CASE WHEN any_value(si) IS NULL OR max(inten) - min(inten) < 1e-6 THEN 0 ELSE corr(place, inten) END AS ri, CASE WHEN max(val) - min(val) < 1e-6 THEN 0 ELSE corr(place, val) END AS rv FROM t GROUP BY k HAVING any_value(top) >= 1),
p AS (SELECT k, top, CASE WHEN round(abs(ri), 9) >= 0.5 THEN CASE WHEN ri > 0 THEN si ELSE 1 - si END END AS pi, CASE WHEN round(abs(rv), 9) >= 0.5 AND sv <> 0 THEN CASE WHEN rv > 0 THEN (sv + 1) / 2 ELSE 1 - (sv + 1) / 2 END END AS pv FROM r)
SELECT k AS l_orderkey, cast(t.idx AS INTEGER) AS idx, round(coalesce(1 - abs(pi - place), 0), 6) AS ord_pos_int, round(coalesce(1 - abs(pv - place), 0), 6) AS ord_pos_val FROM t JOIN p USING (k)""")
def ordinal_positions(spark, sf):
    """Order lines as levels of a scale: places on it from an intensity and a valence."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    l = table(spark, sf, "lineitem").select("l_orderkey", (F.row_number().over(w) - 1).alias("idx"), (F.col("l_discount") * 10 - 0.5).alias("valence"), (F.col("l_quantity") / 50.0).alias("intensity"))  # noqa: E741
    o = F.col("o_orderkey")
    s = table(spark, sf, "orders").select(o.alias("l_orderkey"), ((o % 21 - 10) / 10.0).alias("state_valence"), F.when(o % 5 > 0, (o % 11) / 10.0).alias("state_intensity"))
    p = lexicon.ordinal_positions(l.join(s, "l_orderkey"), ["l_orderkey"])
    return p.select("l_orderkey", "idx", F.round("ord_pos_int", 6).alias("ord_pos_int"), F.round("ord_pos_val", 6).alias("ord_pos_val"))
