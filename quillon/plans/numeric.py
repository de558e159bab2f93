"""Catalogue, part 2: symbolic resolvers, probability vectors, metrics, sampling and closures, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graph, metrics, ranking, resolvers, sampling, validate
from .lexical import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LEVELS = ["Under $100", "$100 to $1,000", "$1,000 to $10,000", "$10,000 to $100,000", "Over $100,000"]
HIT_SQL = "CASE WHEN v < 100 THEN 0 WHEN v <= 1000 THEN 1 WHEN v <= 10000 THEN 2 WHEN v <= 100000 THEN 3 ELSE 4 END"


@query(f"""
WITH o AS (SELECT o_orderkey, round(o_totalprice, 2) AS v FROM orders), h AS (SELECT o_orderkey, v, {HIT_SQL} AS hit FROM o),
d AS (SELECT o_orderkey, hit, list_value(CASE WHEN v >= 100 THEN abs(v - 100) / 100 ELSE 0 END, CASE WHEN v < 100 THEN (100 - v) / 100 WHEN v > 1000 THEN (v - 1000) / 100 ELSE 0 END,
  CASE WHEN v < 1000 THEN (1000 - v) / 1000 WHEN v > 10000 THEN (v - 10000) / 1000 ELSE 0 END, CASE WHEN v < 10000 THEN (10000 - v) / 10000 WHEN v > 100000 THEN (v - 100000) / 10000 ELSE 0 END, CASE WHEN v <= 100000 THEN (100000 - v) / 100000 ELSE 0 END) AS d FROM h),
l AS (SELECT o_orderkey, hit, list_transform(range(5), lambda i: CASE WHEN i = hit THEN 6.0 ELSE -2.0 * least(1.0, d[i + 1]) END) AS z FROM d),
e AS (SELECT o_orderkey, hit, list_transform(z, lambda x: exp(x - 6.0)) AS e FROM l), p AS (SELECT o_orderkey, hit, list_transform(e, lambda x: (1 - 0.09090909090909091) * x / list_sum(e) + 0.09090909090909091 / 5) AS p FROM e),
s AS (SELECT o_orderkey, hit, list_transform(range(5), lambda k: list_sum(list_transform(range(5), lambda j: CASE WHEN abs(j - k) <= 2 THEN p[j + 1] * power(0.05, abs(j - k)) ELSE 0 END))) AS s FROM p)
SELECT o_orderkey, cast(hit AS INTEGER) AS level, round(list_sum(list_transform(range(5), lambda i: i * s[i + 1] / list_sum(s))), 6) AS score, round(s[hit + 1] / list_sum(s), 6) AS p_level FROM s""")
def numeric_levels(spark, sf):
    """How large is the order total?  The state is text; the levels are ranges; the answer is a smoothed distribution over levels."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Order total $"), F.format_number(F.round("o_totalprice", 2), 2)).alias("summary"))
    numbers = resolvers.currency_numbers(o, "o_orderkey", "summary")
    z = resolvers.range_levels(numbers, "o_orderkey", resolvers.ranges_of(LEVELS))
    p = V.ordinal_smoothed(V.mixed(V.softmax(F.col("logits")), 1 / 11), 0.05)
    out = z.withColumn("p", p)
    return out.select("o_orderkey", "level", F.round(V.expected_level(F.col("p")), 6).alias("score"), F.round(F.get("p", F.col("level")), 6).alias("p_level"))


@query("""
SELECT o_orderkey, round(CASE WHEN o_totalprice > 100000 THEN (1 - 0.008547) / (1 + exp(-4.8)) + 0.0042735 ELSE (1 - 0.008547) / (1 + exp(4.8)) + 0.0042735 END, 6) AS noul
FROM (SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders)""")
def numeric_comparison(spark, sf):
    """Is the order total over $100,000?"""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Order total $"), F.format_number(F.round("o_totalprice", 2), 2)).alias("summary"))
    z = resolvers.comparison(resolvers.currency_numbers(o, "o_orderkey", "summary"), "o_orderkey", *resolvers.comparator("Is the order total over $100,000?"))
    return z.select("o_orderkey", F.round(resolvers.noul(F.col("logit")), 6).alias("noul"))


@query("""
WITH d AS (SELECT l_orderkey, min(cast(l_shipdate AS DATE)) AS lo, max(cast(l_shipdate AS DATE)) AS hi FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY l_orderkey)
SELECT l_orderkey, round(CASE WHEN hi < DATE '1998-01-01' THEN (1 - 0.008547) / (1 + exp(-4.8)) + 0.0042735 ELSE (1 - 0.008547) / (1 + exp(4.8)) + 0.0042735 END, 6) AS noul FROM d WHERE hi < DATE '1998-01-01' OR lo >= DATE '1998-01-01'""")
def date_comparison(spark, sf):
    """Did all items ship before January 1, 1998?  Orders with dates on both sides are not answered."""
    days = table(spark, sf, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("day"))
    z = resolvers.date_comparison(days, "l_orderkey", "day", "Did everything ship before January 1, 1998?")
    return z.select("l_orderkey", F.round(resolvers.noul(F.col("logit")), 6).alias("noul"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderpriority, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'] AS keys FROM orders), w AS (SELECT o_orderkey, list_position(keys, o_orderpriority) AS spot FROM o)
SELECT o_orderkey, cast(spot - 1 AS INTEGER) AS choice, round((1 - 0.035714) * exp(6.0) / (exp(6.0) + 4) + 0.035714 / 5, 6) AS p FROM w WHERE spot > 0""")
def enum_extraction(spark, sf):
    """Which priority does the text name?"""
    keys = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Priority of this order: "), F.col("o_orderpriority"), F.lit(".")).alias("state"))
    z = resolvers.enum_winner(o, "o_orderkey", "state", keys)
    return z.select("o_orderkey", "choice", F.round(F.get(V.mixed(V.softmax(F.col("logits")), 0.035714), F.col("choice")), 6).alias("p"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'R' THEN (1 - 0.008547) / (1 + exp(-4.8)) + 0.0042735 ELSE (1 - 0.008547) / (1 + exp(4.8)) + 0.0042735 END, 6) AS noul FROM lineitem")
def boolean_field(spark, sf):
    """Was it returned?  The state's only boolean field whose path is covered by the question's terms answers."""
    s = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_json(F.struct((F.col("l_returnflag") == "R").alias("returned"), F.col("l_quantity").alias("quantity"))).alias("state"))
    s = s.withColumn("id", F.struct("l_orderkey", "l_linenumber", F.monotonically_increasing_id().alias("row")))  # line numbers repeat
    z = resolvers.boolean_field(s, "id", "state", "Was the item returned?")
    return z.select("id.l_orderkey", "id.l_linenumber", F.round(resolvers.noul(F.col("logit")), 6).alias("noul"))


@query("""
WITH d AS (SELECT l_orderkey, max(date_diff('day', cast(o_orderdate AS DATE), cast(l_shipdate AS DATE))) AS worst FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)
SELECT l_orderkey, cast(worst AS INTEGER) AS worst, CASE WHEN worst IS NULL THEN 0 WHEN worst <= 90 THEN 1 ELSE -1 END AS window_ok FROM d""")
def window_check(spark, sf):
    """Longest wait of an order against a window of 90 days: 1 inside, -1 beyond, 0 unknown."""
    j = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    w = j.groupBy("l_orderkey").agg(F.max(F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))).alias("worst"))
    return w.select("l_orderkey", "worst", F.when(F.col("worst").isNull(), 0).when(F.col("worst") <= 90, 1).otherwise(-1).alias("window_ok"))


LOGITS = "[p_size / 10.0, p_retailprice / 500.0, (p_partkey % 7) / 2.0, 1.0]"
SOFT = f"z AS (SELECT p_partkey, list_transform({LOGITS}, lambda x: cast(x AS DOUBLE) / 0.8) AS z FROM part), e AS (SELECT p_partkey, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z), p AS (SELECT p_partkey, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"


def part_softmax(spark, sf):
    z = F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 500.0, (F.col("p_partkey") % 7) / 2.0, F.lit(1.0))
    return table(spark, sf, "part").select("p_partkey", V.softmax(z, 0.8).alias("p"))


@query(f"WITH {SOFT}, r AS (SELECT p_partkey, list_transform(p, lambda x: round(x, 9)) AS p FROM p) SELECT p_partkey, cast(list_position(p, list_max(p)) - 1 AS INTEGER) AS choice, round(list_max(p), 6) AS p_max FROM r")
def softmax_argmax(spark, sf):
    p = part_softmax(spark, sf).withColumn("p", F.transform("p", lambda x: F.round(x, 9)))  # the first of entries that tie up to rounding
    return p.select("p_partkey", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("choice"), F.round(F.array_max("p"), 6).alias("p_max"))


@query(f"""WITH {SOFT}, s AS (SELECT p_partkey, list_transform(range(4), lambda k: list_sum(list_transform(range(4), lambda j: CASE WHEN abs(j - k) <= 2 THEN p[j + 1] * power(0.25, abs(j - k)) ELSE 0 END))) AS s FROM p)
SELECT p_partkey, round(list_sum(list_transform(range(4), lambda i: i * s[i + 1] / list_sum(s))), 6) AS score, round(s[1] / list_sum(s), 6) AS p0, round(s[4] / list_sum(s), 6) AS p3 FROM s""")
def ordinal_smooth(spark, sf):
    p = part_softmax(spark, sf).withColumn("s", V.ordinal_smoothed(F.col("p"), 0.25))
    return p.select("p_partkey", F.round(V.expected_level(F.col("s")), 6).alias("score"), F.round(F.get("s", F.lit(0)), 6).alias("p0"), F.round(F.get("s", F.lit(3)), 6).alias("p3"))


@query(f"""WITH {SOFT}, c AS (SELECT p_partkey, 1 + list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(4.0) AS conc, list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2] AS margin FROM p)
SELECT p_partkey, round(conc, 6) AS concentration, round(margin, 6) AS margin, round(1 / (1 + exp(-(2 * conc + 1.5 * margin - 1))), 6) AS confidence FROM c""")
def shape_confidence(spark, sf):
    p = part_softmax(spark, sf)
    c, m = V.concentration(F.col("p")), V.margin(F.col("p"))
    return p.select("p_partkey", F.round(c, 6).alias("concentration"), F.round(m, 6).alias("margin"), F.round(V.sigmoid(2 * c + 1.5 * m - 1), 6).alias("confidence"))


OUT_SQL = """o AS (SELECT doc_id, source, lang, quality AS y, p, CASE WHEN (p >= 0.5) = (quality = 1) THEN 1 ELSE 0 END AS correct, greatest(p, 1 - p) AS conf,
  -ln(greatest(CASE WHEN quality = 1 THEN p ELSE 1 - p END, 1e-12)) AS nll, 2 * (p - quality) ** 2 AS brier
  FROM (SELECT doc_id, source, lang, quality, 1 / (1 + exp(-(n_chars % 1000 - 300) / 400.0)) AS p FROM documents JOIN labels USING (doc_id)))"""


def outcomes(spark, sf):
    """Answers to judge: a deterministic probability from the document's size against the quality label."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    d = d.select("doc_id", "source", "lang", F.col("quality").alias("y"), (1 / (1 + F.exp(-(F.col("n_chars") % 1000 - 300) / 400.0))).alias("p"))
    return metrics.noul_metrics(d)


@query(f"WITH {OUT_SQL} SELECT source, lang, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier FROM o GROUP BY GROUPING SETS ((source), (lang), ())")
def metrics_grouped(spark, sf):
    s = metrics.summary(outcomes(spark, sf), "source", "lang")
    return s.select("source", "lang", "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "nll", "brier")))


def ece_sql(bins: int) -> str:
    return f"WITH {OUT_SQL}, b AS (SELECT source, least(floor(conf * {bins}), {bins - 1}) AS b, count(*) AS n, sum(correct) AS c, sum(conf) AS s FROM o GROUP BY 1, 2) SELECT source, round(sum(abs(c - s)) / sum(n), 6) AS ece FROM b GROUP BY source"


@query(ece_sql(10))
def ece10(spark, sf):
    return metrics.ece(outcomes(spark, sf), ["source"], 10).select("source", F.round("ece", 6).alias("ece"))


@query(ece_sql(15))
def ece15(spark, sf):
    return metrics.ece(outcomes(spark, sf), ["source"], 15).select("source", F.round("ece", 6).alias("ece"))


@query(f"""WITH {OUT_SQL}, r AS (SELECT source, y, rank() OVER (PARTITION BY source ORDER BY p) + (count(*) OVER (PARTITION BY source, p) - 1) / 2.0 AS r FROM o),
g AS (SELECT source, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS rp, sum(y) AS np, count(*) - sum(y) AS nn FROM r GROUP BY source)
SELECT source, round(CASE WHEN np > 0 AND nn > 0 THEN (rp - np * (np + 1) / 2.0) / (np * nn) END, 6) AS auroc FROM g""")
def auroc(spark, sf):
    return ranking.auroc(outcomes(spark, sf), ["source"], "p", "y").select("source", F.round("auroc", 6).alias("auroc"))


@query(f"""WITH {OUT_SQL}, r AS (SELECT source, correct, row_number() OVER (PARTITION BY source ORDER BY conf DESC, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM o)
SELECT source, round(avg(correct), 6) AS selective FROM r WHERE k <= greatest(floor(n / 2), 1) GROUP BY source""")
def selective50(spark, sf):
    return metrics.selective(outcomes(spark, sf), ["source"], "confidence", "correct", ["doc_id"]).select("source", F.round("selective", 6).alias("selective"))


@query(f"WITH {OUT_SQL} SELECT source, round(avg(abs(p - (0.9 * y + 0.05))), 6) AS tvd FROM o GROUP BY source")
def tvd(spark, sf):
    o = outcomes(spark, sf).withColumn("soft", 0.9 * F.col("y") + 0.05)
    d = metrics.total_variation(F.array("p", 1 - F.col("p")), F.array("soft", 1 - F.col("soft")))
    return o.groupBy("source").agg(F.round(F.avg(d), 6).alias("tvd"))


@query(f"""WITH {OUT_SQL}, g AS (SELECT doc_id // 3 AS grp, p, p >= 0.5 AS yes FROM o), m AS (SELECT grp, count(*) AS n, count(DISTINCT yes) = 1 AS same, avg(p) AS mean FROM g GROUP BY grp HAVING count(*) >= 2)
SELECT m.grp AS grp, any_value(n) AS n, any_value(same) AS same, round(avg(abs(p - mean)), 6) AS spread FROM m JOIN g ON g.grp = m.grp GROUP BY m.grp""")
def group_stability(spark, sf):
    o = outcomes(spark, sf).select(F.floor(F.col("doc_id") / 3).cast("long").alias("grp"), "p", (F.col("p") >= 0.5).alias("yes"))
    return metrics.stability(o, ["grp"], "yes", "p").select("grp", "n", "same", F.round("spread", 6).alias("spread"))


@query("""WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, max(CASE WHEN k = cast(floor((n - 1) * 0.5 + 0.5) AS BIGINT) THEN n_chars END) AS p50, max(CASE WHEN k = cast(floor((n - 1) * 0.95 + 0.5) AS BIGINT) THEN n_chars END) AS p95 FROM r GROUP BY source""")
def pctl_nearest(spark, sf):
    return ranking.nearest_rank(table(spark, sf, "documents").select("source", "n_chars"), ["source"], "n_chars", [0.5, 0.95])


@query("SELECT source, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents GROUP BY source")
def pctl_linear(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.round(F.percentile("n_chars", 0.5), 6).alias("p50"), F.round(F.percentile("n_chars", 0.95), 6).alias("p95"))


@query("""SELECT doc_id, CASE WHEN h < 60 THEN 'train' WHEN h < 80 THEN 'calib' ELSE 'dev' END AS split
FROM (SELECT doc_id, ('0x' || substr(sha256(source || ':' || (doc_id // 10)), 1, 8))::BIGINT % 100 AS h FROM documents)""")
def hash_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.col("source"), F.lit(":"), F.floor(F.col("doc_id") / 10)).alias("grp"))
    return sampling.split(d, "grp").select("doc_id", "split")


@query("SELECT md5(text) AS digest, doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("digest"), "doc_id", "lang", "source")
    return sampling.first_of(d, ["digest"], ["doc_id"])


@query("""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s' || doc_id), doc_id) AS turn FROM documents)
SELECT doc_id, lang, turn FROM r ORDER BY turn, lang LIMIT 200""")
def balanced_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.round_robin(d, "lang", "doc_id", 200, "s").select("doc_id", "lang", F.col("turn").cast("long").alias("turn"))


@query("""WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), k AS (SELECT lang, count(*) * 1.0 / sum(n) AS mean FROM s GROUP BY lang)
SELECT doc_id, round(1.0 / n / mean, 6) AS weight FROM documents d JOIN s ON s.lang = d.lang AND s.source = d.source JOIN k ON k.lang = d.lang""")
def loss_weights(spark, sf):
    return sampling.loss_weights(table(spark, sf, "documents").select("doc_id", "lang", "source"), "lang", "source").select("doc_id", F.round("weight", 6).alias("weight"))


@query("""WITH z AS (SELECT (n_chars % 1000 - 300) / 400.0 AS z, quality AS y FROM documents JOIN labels USING (doc_id)), g AS (SELECT 0.03 * power(8 / 0.03, i / 40.0) AS t FROM range(41) r(i)),
l AS (SELECT t, avg(-ln(greatest(1 / (1 + exp(-(CASE WHEN y = 1 THEN z ELSE -z END) / t)), 1e-12))) AS nll FROM z, g GROUP BY t)
SELECT round(t, 6) AS temperature, round(nll, 6) AS nll FROM l ORDER BY round(nll, 9), t LIMIT 1""")
def grid_temperature(spark, sf):
    """The best of 41 temperatures on a log grid; all losses are sums of one pass, so nothing is multiplied out."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id").select(((F.col("n_chars") % 1000 - 300) / 400.0).alias("z"), F.col("quality").alias("y"))
    s = F.when(F.col("y") == 1, F.col("z")).otherwise(-F.col("z"))
    grid = [0.03 * (8 / 0.03) ** (i / 40) for i in range(41)]
    losses = d.agg(*(F.avg(-F.log(F.greatest(1 / (1 + F.exp(-s / t)), F.lit(1e-12)))).alias(f"l{i}") for i, t in enumerate(grid)))
    pairs = F.array(*(F.struct(F.round(f"l{i}", 9).alias("r"), F.lit(t).alias("t"), F.col(f"l{i}").alias("nll")) for i, t in enumerate(grid)))
    return losses.select(F.array_min(pairs).alias("b")).select(F.round("b.t", 6).alias("temperature"), F.round("b.nll", 6).alias("nll"))


@query("SELECT lang, round((sum(CASE WHEN (n_chars % 1000 > 300) <> (quality = 1) THEN 1 ELSE 0 END) + 1.0) / (count(*) + 2), 6) AS epsilon FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def symbolic_epsilon(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    wrong = F.count_if((F.col("n_chars") % 1000 > 300) != (F.col("quality") == 1))
    return d.groupBy("lang").agg(F.round((wrong + 1.0) / (F.count("*") + 2), 6).alias("epsilon"))


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
w AS (SELECT child AS node, child AS ancestor, 0 AS depth FROM e WHERE child LIKE 'c%' UNION ALL SELECT w.node, e.parent, w.depth + 1 FROM w JOIN e ON e.child = w.ancestor WHERE w.depth < 3)
SELECT ancestor, min(depth) AS depth, count(*) AS nodes FROM w GROUP BY ancestor""")
def graph_closure(spark, sf):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf, "customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"))
    edges = edges.union(table(spark, sf, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"))).union(table(spark, sf, "region").select(name("r", "r_regionkey"), F.lit("world")))
    closed = graph.closure(edges, edges.select(F.col("child").alias("node")).where("node like 'c%'"))
    return closed.groupBy("ancestor").agg(F.min("depth").alias("depth"), F.count("*").alias("nodes"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'quillon-1' END AS model, event_id % 13 = 0 AS scalar, (event_id % 5) AS options, event_id % 7 = 0 AS no_text FROM events)
SELECT event_id, CASE WHEN model <> 'quillon-1' THEN 404 WHEN scalar OR options < 2 THEN 422 WHEN no_text AND options = 4 THEN 422 END AS status,
  CASE WHEN model <> 'quillon-1' THEN 'model' WHEN scalar THEN 'state' WHEN options < 2 THEN 'questions.q.criteria' WHEN no_text AND options = 4 THEN 'questions.q.instructions' END AS field FROM r""")
def validate_requests(spark, sf):
    """First problem of each of many assembled requests, in a fixed order of rules."""
    e = table(spark, sf, "events").select("event_id")
    options = (F.col("event_id") % 5).cast("int")
    keys = F.slice(F.array(*(F.lit(k) for k in "abcd")), F.lit(1), options)
    question = F.when((F.col("event_id") % 7 == 0) & (options == 4), F.lit('{"type":"noul"}')).otherwise(
        F.concat(F.lit('{"type":"choice","instructions":"Which one?","criteria":{'), F.array_join(F.transform(keys, lambda k: F.concat(F.lit('"'), k, F.lit('":null'))), ","), F.lit("}}"))
    )
    state = F.when(F.col("event_id") % 13 == 0, F.lit("17")).otherwise(F.lit('{"a":"b"}'))
    r = e.select("event_id", F.when(F.col("event_id") % 11 == 0, "other").otherwise("quillon-1").alias("model"), state.alias("state"), F.concat(F.lit('{"q":'), question, F.lit("}")).alias("questions"))
    return validate.first_problem(r, "event_id").select("event_id", "status", "field")
