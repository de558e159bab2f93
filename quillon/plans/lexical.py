"""Catalogue, part 1: lexical operators over documents, benchmark and conversations, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import neardup, retrieval

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


TOKENS = "regexp_extract_all(lower(text), '[a-z]+')"
NORM = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query("SELECT event_id, 'k' AS path, 'k' AS key, 'number' AS kind, json_extract_string(props, '$.k') AS text, cast(json_extract_string(props, '$.k') AS DOUBLE) AS number FROM events")
def flatten_props(spark, sf):
    from ..operators.state import flatten

    leaves = flatten(table(spark, sf, "events").select("event_id", "props"), "event_id", "props")
    return leaves.select("event_id", "path", "key", "kind", "text", "number")


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY doc_id, term")
def token_tf(spark, sf):
    return retrieval.postings(table(spark, sf, "documents"), "doc_id", S.words(F.col("text"))).select("doc_id", "term", "tf")


@query(f"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT doc_id, len(regexp_extract_all(lower(line), '[a-z]+')) AS n FROM s)
SELECT doc_id, count(*) AS segments, cast(sum(n) AS BIGINT) AS tokens, round(greatest(avg(n), 1.0), 6) AS average, cast(max(n) AS BIGINT) AS longest FROM w WHERE n > 0 GROUP BY doc_id""")  # noqa: F541
def segment_stats(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    n = lines.select("doc_id", F.size(S.words(F.col("line"))).cast("long").alias("n")).where("n > 0")
    return n.groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum("n").alias("tokens"), F.round(F.greatest(F.avg("n"), F.lit(1.0)), 6).alias("average"), F.max("n").alias("longest"))


IDF_SQL = f"""
c AS (SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS}) AS term FROM documents) GROUP BY term), m AS (SELECT max(n) AS hi, min(n) AS lo FROM c),
idf AS (SELECT term, n, CASE WHEN hi > lo THEN least(1.0, greatest(0.0, ln(cast(hi AS DOUBLE) / n) / ln(cast(hi AS DOUBLE) / lo))) ELSE 0.0 END AS idf FROM c, m)"""


@query(f"WITH {IDF_SQL} SELECT term AS word, n AS count, round(idf, 6) AS idf FROM idf")
def idf_prior(spark, sf):
    counts = word_counts(spark, sf)
    return counts.join(retrieval.idf(counts), "word").select("word", "count", F.round("idf", 6).alias("idf"))


def word_counts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode(S.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def weighted_items(spark, sf) -> tuple[DataFrame, DataFrame, float]:
    """Distinct benchmark terms weighted by corpus idf; document postings; mean document length."""
    terms = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(S.words(F.col("text")))).alias("term"))
    counts = word_counts(spark, sf)
    weights = retrieval.idf(counts).withColumnRenamed("word", "term")
    items = terms.join(weights, "term").where("idf > 0").select(F.col("item_id").alias("cid"), "term", F.col("idf").alias("weight"))
    posts = retrieval.postings(table(spark, sf, "documents"), "doc_id", S.words(F.col("text"))).withColumnRenamed("doc_id", "did")
    average = table(spark, sf, "documents").agg(F.avg(F.size(S.words(F.col("text"))))).first()[0] or 1.0
    return items, posts, max(average, 1.0)


ITEMS_SQL = f"""
WITH {IDF_SQL}, d AS (SELECT doc_id, {TOKENS} AS t FROM documents), a AS (SELECT greatest(avg(len(t)), 1.0) AS average FROM d),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark)),
w AS (SELECT item_id, term, idf FROM i JOIN idf USING (term) WHERE idf > 0), q AS (SELECT item_id, greatest(sum(idf), 1e-6) AS total FROM w GROUP BY item_id),
s AS (SELECT w.item_id AS item_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))) / any_value(total) AS bm25, sum(idf) / any_value(total) AS cov, sum(idf * (1 + ln(tf))) AS dot, count(*) AS shared
      FROM p JOIN w USING (term) JOIN q ON q.item_id = w.item_id, a GROUP BY w.item_id, doc_id)"""


@query(ITEMS_SQL + " SELECT item_id, doc_id, rank, score FROM (SELECT item_id, doc_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 5")
def bm25_top5(spark, sf):
    items, posts, average = weighted_items(spark, sf)
    e = retrieval.evidence(items, posts, average).select(F.col("cid").alias("item_id"), F.col("did").alias("doc_id"), F.round("bm25", 6).alias("score"))
    return retrieval.top_per(e, ["item_id"], "score", ["doc_id"], 5).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


@query(ITEMS_SQL + " SELECT item_id, round(max(cov), 6) AS cov_best, count(*) AS texts FROM s GROUP BY item_id")
def coverage(spark, sf):
    items, posts, average = weighted_items(spark, sf)
    return retrieval.evidence(items, posts, average).groupBy(F.col("cid").alias("item_id")).agg(F.round(F.max("cov"), 6).alias("cov_best"), F.count("*").alias("texts"))


@query(ITEMS_SQL + """, dn AS (SELECT doc_id, sqrt(sum(((1 + ln(tf)) * idf) ** 2)) AS norm FROM p JOIN idf USING (term) GROUP BY doc_id),
wn AS (SELECT item_id, sqrt(sum(idf ** 2)) AS norm FROM w GROUP BY item_id), x AS (SELECT item_id, doc_id, sum(idf * (1 + ln(tf)) * idf) AS dot FROM p JOIN w USING (term) GROUP BY item_id, doc_id)
SELECT x.item_id AS item_id, round(max(dot / (dn.norm * wn.norm)), 6) AS cos_best FROM x JOIN dn USING (doc_id) JOIN wn ON wn.item_id = x.item_id WHERE dn.norm > 0 GROUP BY x.item_id""")
def tfidf_cosine(spark, sf):
    items, posts, _ = weighted_items(spark, sf)
    weights = retrieval.idf(word_counts(spark, sf)).withColumnRenamed("word", "term")
    w = posts.join(weights, "term").withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    norms = w.groupBy("did").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("dn")).where("dn > 0")
    own = items.groupBy("cid").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("wn"))
    dots = w.join(items, "term").groupBy("cid", "did").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    return dots.join(norms, "did").join(own, "cid").groupBy(F.col("cid").alias("item_id")).agg(F.round(F.max(F.col("dot") / (F.col("dn") * F.col("wn"))), 6).alias("cos_best"))


@query(f"""
WITH d AS (SELECT doc_id, list_distinct({TOKENS}) AS t FROM documents), i AS (SELECT item_id, list_distinct({TOKENS}) AS t FROM benchmark),
dt AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d), it AS (SELECT item_id, len(t) AS n, unnest(t) AS term FROM i),
x AS (SELECT item_id, doc_id, count(*) AS shared, any_value(dt.n) AS dn, any_value(it.n) AS ino FROM dt JOIN it USING (term) GROUP BY item_id, doc_id)
SELECT item_id, round(max(cast(shared AS DOUBLE) / (dn + ino - shared)), 6) AS jaccard_best FROM x GROUP BY item_id""")
def token_jaccard(spark, sf):
    side = lambda t, k, n: table(spark, sf, t).select(k, F.array_distinct(S.words(F.col("text"))).alias("t")).select(k, F.size("t").alias(n), F.explode("t").alias("term"))
    x = side("documents", "doc_id", "dn").join(side("benchmark", "item_id", "ino"), "term").groupBy("item_id", "doc_id", "dn", "ino").agg(F.count("*").alias("both"))
    return x.groupBy("item_id").agg(F.round(F.max(F.col("both") / (F.col("dn") + F.col("ino") - F.col("both"))), 6).alias("jaccard_best"))


@query(f"""
WITH t AS (SELECT item_id AS id, 0 AS side, {TOKENS} AS t FROM benchmark UNION ALL SELECT doc_id, 1, {TOKENS} FROM documents),
g AS (SELECT DISTINCT id, side, t[i] AS a, t[i + 1] AS b FROM (SELECT id, side, t, unnest(range(1, len(t))) AS i FROM t)),
n AS (SELECT id AS item_id, count(*) AS bigrams FROM g WHERE side = 0 GROUP BY id), d AS (SELECT DISTINCT a, b FROM g WHERE side = 1),
h AS (SELECT g.id AS item_id, count(*) AS hits FROM g JOIN d USING (a, b) WHERE side = 0 GROUP BY g.id)
SELECT n.item_id AS item_id, bigrams, coalesce(hits, 0) AS hits FROM n LEFT JOIN h ON n.item_id = h.item_id""")
def bigram_hits(spark, sf):
    own = retrieval.bigrams(table(spark, sf, "benchmark"), "item_id", S.words(F.col("text")))
    state = retrieval.bigrams(table(spark, sf, "documents"), "doc_id", S.words(F.col("text"))).select("a", "b")
    wanted = own.select("a", "b").distinct()
    present = state.join(wanted, ["a", "b"], "left_semi").distinct().withColumn("hit", F.lit(1))
    return own.join(present, ["a", "b"], "left").groupBy("item_id").agg(F.count("*").alias("bigrams"), F.count("hit").alias("hits"))


@query("""
WITH n AS (SELECT DISTINCT p_name, ' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM part),
g AS (SELECT DISTINCT p_name, substr(t, i, 4) AS g FROM (SELECT p_name, t, unnest(range(1, len(t) - 2)) AS i FROM n)), c AS (SELECT p_name, count(*) AS n FROM g GROUP BY p_name),
x AS (SELECT a.p_name AS a, b.p_name AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.p_name < b.p_name GROUP BY 1, 2)
SELECT a, b, round(2.0 * shared / (ca.n + cb.n), 6) AS dice FROM x JOIN c ca ON ca.p_name = a JOIN c cb ON cb.p_name = b WHERE 2.0 * shared / (ca.n + cb.n) >= 0.8""")
def chargram_dice(spark, sf):
    """Pairs of distinct part names with a Dice coefficient of 0.8 or more, by prefix filtering on rare grams (J = D / (2 - D) = 2/3)."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("class_id")).distinct().select("class_id", S.char_grams(F.col("class_id")).alias("sh"))
    pairs = neardup.similar_sets(names, percent=66)
    dice = F.round(2 * F.col("jaccard") / (1 + F.col("jaccard")), 6)
    return pairs.select("a", "b", dice.alias("dice")).where("dice >= 0.8")


@query(r"""
WITH l AS (SELECT DISTINCT lower(p_type) AS lit FROM part UNION SELECT unnest(['the', 'with', 'in']) UNION SELECT DISTINCT lower(event_type) FROM events),
t AS (SELECT doc_id AS id, 'documents' AS tab, lower(text) AS text FROM documents UNION ALL SELECT conv_id * 1000 + turn, 'conversations', lower(text) FROM conversations)
SELECT tab, lit, count(*) AS texts FROM t JOIN l ON regexp_matches(text, '(^|[^a-z0-9])' || lit || '($|[^a-z0-9])') GROUP BY tab, lit""")
def literal_hits(spark, sf):
    """Texts in which a short literal stands alone.  The literals (a few dozen, counted first) are one array that each text is searched for in place."""
    lits = table(spark, sf, "part").select(F.lower("p_type").alias("lit")).union(table(spark, sf, "events").select(F.lower("event_type"))).distinct()
    known = sorted({r["lit"] for r in lits.limit(10_001).collect()} | {"the", "with", "in"})
    if len(known) > 10_000:
        raise ValueError("literal_hits searches 10,000 literals at most")
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("tab"), "text").union(table(spark, sf, "conversations").select(F.lit("conversations"), "text"))
    marked = docs.select("tab", F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), "[^a-z0-9]", " "), F.lit(" ")).alias("t"))
    found = F.filter(F.array(*map(F.lit, known)), lambda w: F.contains(F.col("t"), F.concat(F.lit(" "), F.regexp_replace(w, "[^a-z0-9]", " "), F.lit(" "))))
    return marked.select("tab", F.explode(found).alias("lit")).groupBy("tab", "lit").agg(F.count("*").alias("texts"))


@query("SELECT min(doc_id) AS class_id, count(*) AS copies, md5(text) AS digest FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dups(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h"), F.md5("text").alias("digest")).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return g.where("copies > 1").select("class_id", "copies", "digest")


@query(f"SELECT min(doc_id) AS class_id, count(*) AS copies FROM documents GROUP BY {NORM} HAVING count(*) > 1")
def normalized_dups(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.sha2(S.normalized(F.col("text")), 256).alias("h")).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return g.where("copies > 1").select("class_id", "copies")


SHINGLES = f"""
t AS (SELECT doc_id, list_filter(string_split({NORM}, ' '), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [array_to_string(w, ' ')] END) AS sh FROM t WHERE len(w) > 0),
k AS (SELECT doc_id, sh, min(doc_id) OVER (PARTITION BY sh) AS class_id FROM s), r AS (SELECT class_id, sh FROM k WHERE doc_id = class_id),
e AS (SELECT class_id, len(sh) AS n, unnest(sh) AS s FROM r),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.s = b.s AND a.class_id < b.class_id GROUP BY 1, 2),
j AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (na + nb - shared)), z AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM j UNION ALL SELECT b FROM j) GROUP BY id)
SELECT d.doc_id AS doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(z.links, 0) AS links FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN z ON z.id = k.class_id"""


@query("WITH " + SHINGLES.strip())
def shingle_neardup(spark, sf):
    docs = table(spark, sf, "documents")
    members, sets = neardup.classes(docs)
    return neardup.linked_classes(docs, neardup.similar_sets(sets), members)


@query()
def minhash_lsh(spark, sf):
    """The same links by MinHash bands; 32 bands of four rows miss a pair at the threshold with a probability below 1e-7, tests measure the recall."""
    docs = table(spark, sf, "documents")
    members, sets = neardup.classes(docs)
    keyed = sets.withColumnRenamed("class_id", "key")
    pairs = neardup.lsh_pairs(keyed, keyed).where("a < b")
    return neardup.linked_classes(docs, neardup.verified(pairs, sets, neardup.PERCENT), members)


UNIT_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [array_to_string(w, ' ')] END"


@query(f"""
WITH tr AS (SELECT doc_id AS key, text, {NORM} AS norm FROM documents), ev AS (SELECT item_id AS key, text, {NORM} AS norm FROM benchmark),
t AS (SELECT key, text, norm, string_split(norm, ' ') AS w FROM tr WHERE strlen(norm) >= 20), e AS (SELECT key, text, norm, string_split(norm, ' ') AS w FROM ev WHERE strlen(norm) >= 20),
ts AS (SELECT key, {UNIT_SHINGLES} AS sh FROM t), es AS (SELECT key, {UNIT_SHINGLES} AS sh FROM e),
tx AS (SELECT key, len(sh) AS n, unnest(sh) AS s FROM ts), ex AS (SELECT key, len(sh) AS n, unnest(sh) AS s FROM es),
p AS (SELECT ex.key AS key, tx.key AS a, count(*) AS shared, any_value(tx.n) AS na, any_value(ex.n) AS nb FROM tx JOIN ex USING (s) GROUP BY 1, 2),
b AS (SELECT key, max(cast(shared AS DOUBLE) / (na + nb - shared)) AS jaccard, max(cast(shared AS DOUBLE) / nb) AS containment, cast(sum(CASE WHEN 100 * shared >= 80 * (na + nb - shared) THEN 1 ELSE 0 END) AS BIGINT) AS near FROM p GROUP BY key),
x AS (SELECT e.key AS key, count(*) AS exact FROM e JOIN t ON e.text = t.text GROUP BY e.key), y AS (SELECT e.key AS key, count(*) AS normalized FROM e JOIN t ON e.norm = t.norm GROUP BY e.key)
SELECT e.key AS item_id, CASE WHEN exact > 0 THEN 'exact' WHEN normalized > 0 THEN 'normalized' WHEN near > 0 THEN 'near' WHEN containment >= 0.8 THEN 'contained' ELSE 'clean' END AS verdict,
       coalesce(exact, 0) AS exact, coalesce(normalized, 0) AS normalized, coalesce(near, 0) AS near, round(coalesce(jaccard, 0.0), 6) AS jaccard, round(coalesce(containment, 0.0), 6) AS containment
FROM e LEFT JOIN b ON b.key = e.key LEFT JOIN x ON x.key = e.key LEFT JOIN y ON y.key = e.key""")
def leakage_verdict(spark, sf):
    side = lambda t, k: table(spark, sf, t).select(F.col(k).alias("key"), "text")
    out = neardup.scan(side("documents", "doc_id"), side("benchmark", "item_id"))
    return out.select(F.col("key").alias("item_id"), "verdict", "exact", "normalized", "near", F.round("jaccard", 6).alias("jaccard"), F.round("containment", 6).alias("containment"))
