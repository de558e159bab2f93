"""Document fingerprints: a Merkle tree over clauses, paragraphs and sections.

A text's lines are its paragraphs; a paragraph's leaves are its clauses (cut after ``.,;:!?|``, at most ``LEAF_CHARS`` code points each).  A section
ends after a paragraph whose digest starts with 0 or 1, so section borders move with the content, not with its position.  A leaf's digest is the SHA-256 of
its text, a paragraph's that of its leaves' digests, a section's that of its paragraphs', the root's that of its sections'.  So equal roots mean equal
texts, and below differing roots the nodes that the other tree lacks locate the edit (:func:`locate_edits`).

The fingerprint is the tree: ``root/section/section...``, a section being 16 digits of its digest, a colon, and its paragraphs, joined by semicolons; a paragraph is 16
digits of its digest and 8 of each leaf's.  The likeness of two fingerprints walks down from the roots: equal roots give 1; sections in both trees count whole
and aren't entered; of the others, paragraphs in both count whole; of the rest, equal leaves.  It is the Dice coefficient of the leaves so counted.
Equal nodes of one tree count once.

Only DataFrame functions are used.  Defined results: a null text counts as empty; an empty text has no leaves, likeness 1 to another empty text and
0 to anything else.  Rows without a doc_id have no place in the order: nothing replaces their last quarter (it is just cut) and near_next is
null.  Repeated ids are ordered by the text's hash.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, require, text_or_empty

LEAF_CHARS = 160
LEAF = rf"[^.,;:!?|\n]{{1,{LEAF_CHARS}}}[.,;:!?|]*|[.,;:!?|]+"


def paragraph_nodes(text: Column) -> Column:
    """Of each line: its digest (64 digits), then 8 digits of each leaf's."""

    def node(leaf_digests: Column) -> Column:
        return F.concat(F.sha2(F.array_join(leaf_digests, ""), 256), F.array_join(F.transform(leaf_digests, lambda d: F.substring(d, 1, 8)), ""))

    leaves = F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256)))
    return F.transform(leaves, node)


def paragraph_digests(text: Column) -> Column:
    return F.transform(paragraph_nodes(text), lambda p: F.substring(p, 1, 64))


def section_nodes(paragraphs: Column) -> Column:
    """Of each section: its digest (64 digits), a colon, and its paragraphs, with 16 digits of their digests."""
    marked = F.transform(paragraphs, lambda p: F.concat(p, F.when(F.substring(p, 1, 1).isin("0", "1"), F.lit("/")).otherwise(F.lit(";"))))
    sections = F.filter(F.split(F.array_join(marked, ""), "/"), lambda s: s != "")

    def node(members: Column) -> Column:
        short = F.transform(members, lambda p: F.concat(F.substring(p, 1, 16), F.substr(p, F.lit(65))))
        return F.concat(F.sha2(F.array_join(F.transform(members, lambda p: F.substring(p, 1, 64)), ""), 256), F.lit(":"), F.array_join(short, ";"))

    return F.transform(F.transform(sections, lambda s: F.split(F.rtrim(s, F.lit(";")), ";")), node)


def serialized(sections: Column) -> Column:
    root = F.sha2(F.array_join(F.transform(sections, lambda s: F.substring(s, 1, 64)), ""), 256)
    return F.concat(root, F.lit("/"), F.array_join(F.transform(sections, lambda s: F.concat(F.substring(s, 1, 16), F.substr(s, F.lit(65)))), "/"))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    return df.withColumn("__s", section_nodes(paragraph_nodes(F.col(text)))).withColumn(name, serialized(F.col("__s"))).drop("__s")


def total(nodes: Column, size) -> Column:
    return F.aggregate(F.transform(nodes, size), F.lit(0), lambda x, y: x + y)


def with_likeness(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """``df`` with the likeness of two columns of fingerprints; null where one is."""
    in_section = lambda s: ((F.length(s) - 17 - F.size(F.split(s, ";")) * 17 + 1) / 8).cast("int")
    in_paragraph = lambda p: ((F.length(p) - 16) / 8).cast("int")
    paragraphs = lambda c: F.flatten(F.transform(c, lambda s: F.split(F.substr(s, F.lit(18)), ";")))
    leaves = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda p: F.regexp_extract_all(F.substr(p, F.lit(17)), F.lit(".{8}"), F.lit(0)))))
    below = lambda c: F.slice(F.split(F.col(c), "/"), 2, 1 << 30)
    t = df.withColumns({"__a": below(left), "__b": below(right)})
    t = t.withColumns({"__pa": paragraphs(F.array_except("__a", "__b")), "__pb": paragraphs(F.array_except("__b", "__a")), "__n": total(F.array_intersect("__a", "__b"), in_section)})
    t = t.withColumns({"__la": leaves(F.array_except("__pa", "__pb")), "__lb": leaves(F.array_except("__pb", "__pa")), "__n": F.col("__n") + total(F.array_intersect("__pa", "__pb"), in_paragraph)})
    both = F.col("__n") + F.size(F.array_intersect("__la", "__lb"))
    all_ = 2 * F.col("__n") + F.size("__la") + F.size("__lb")
    same = F.substring(F.col(left), 1, 64) == F.substring(F.col(right), 1, 64)
    value = F.when(F.col(left).isNull() | F.col(right).isNull(), F.lit(None).cast("double")).when(same, F.lit(1.0)).when(all_ == 0, F.lit(0.0)).otherwise(2.0 * both / all_)
    return t.withColumn(name, value).drop("__a", "__b", "__pa", "__pb", "__la", "__lb", "__n")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint."""
    require(docs, "doc_id", "text")
    return with_fingerprint(docs.select("doc_id", text_or_empty().alias("text")), "text", "fingerprint").select("doc_id", "fingerprint")


def locate_edits(pairs: DataFrame) -> DataFrame:
    """For rows (id, left, right): ``equal``, and the numbers (from 0) of the left and right paragraphs whose digest the other text lacks.  Sections with
    equal digests are skipped as whole branches, so only paragraphs under differing sections are looked at."""
    require(pairs, "id", "left", "right")

    def branches(side: str) -> Column:
        # paragraphs as structs (section digest, paragraph digest, number)
        d = F.transform(paragraph_digests(F.coalesce(F.col(side), F.lit(""))), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        empty = F.array().cast("array<struct<p:string,i:int>>")
        folded = F.aggregate(
            d,
            F.struct(F.array().cast("array<array<struct<p:string,i:int>>>").alias("done"), empty.alias("open")),
            lambda acc, x: F.when(
                F.substring(x["p"], 1, 1).isin("0", "1"),
                F.struct(F.concat(acc["done"], F.array(F.concat(acc["open"], F.array(x)))).alias("done"), empty.alias("open")),
            ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x)).alias("open"))),
            lambda acc: F.concat(acc["done"], F.array(acc["open"])),
        )
        return F.transform(folded, lambda s: F.struct(F.sha2(F.array_join(F.transform(s, lambda x: x["p"]), ""), 256).alias("digest"), s.alias("ps")))

    def lacking(own: str, other: str) -> Column:
        theirs = F.transform(F.col(other), lambda s: s["digest"])
        open_ = F.flatten(F.transform(F.filter(F.col(own), lambda s: ~F.array_contains(theirs, s["digest"])), lambda s: s["ps"]))
        known = F.transform(F.flatten(F.transform(F.col(other), lambda s: s["ps"])), lambda x: x["p"])
        return F.transform(F.filter(open_, lambda x: ~F.array_contains(known, x["p"])), lambda x: x["i"])

    t = pairs.select("id", branches("left").alias("l"), branches("right").alias("r"))
    digests = lambda c: F.transform(F.col(c), lambda s: s["digest"])
    return t.select("id", (digests("l") == digests("r")).alias("equal"), lacking("l", "r").alias("left_paragraphs"), lacking("r", "l").alias("right_paragraphs"))


def with_next(docs: DataFrame, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Each row with ``columns`` of the next one by ascending doc_id (after the last: the first).

    The order is cut at quantiles of doc_id into even ranges; each range is one window, and the first row of a range is copied to the end of the
    range before it, so rows are shuffled once and no task sees more than a range."""
    spark = docs.sparkSession
    n = 2 * partitions(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] if n > 1 else []
    cuts = sorted(set(cuts or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    lows = {r["bucket"]: r["low"] for r in docs.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.min("doc_id").alias("low")).collect()}
    order = sorted(lows)  # two for each partition at most
    before = {b: order[i - 1] for i, b in enumerate(order)}
    at = lambda values, kind: F.array(*(F.lit(values.get(b)).cast(kind) for b in range(len(cuts) + 1)))[F.col("bucket")]
    here = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("lap"))
    again = F.struct(at(before, "int").alias("b"), F.lit(1).alias("lap"))
    rows = docs.withColumn("bucket", bucket).withColumn("place", F.explode(F.when(F.col("doc_id") == at(lows, "long"), F.array(here, again)).otherwise(F.array(here))))
    w = Window.partitionBy("place.b").orderBy("place.lap", "doc_id", "tie")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    return rows.select("*", *(F.lead(c).over(w).alias(prefix + c) for c in columns)).where("place.lap = 0").drop("bucket", "place", "tie")


def edited_twins(docs: DataFrame) -> DataFrame:
    """The digest of fingerprints against an edited copy and the next document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next."""
    require(docs, "doc_id", "text")
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    t = with_fingerprint(t, "text", "fingerprint")
    lone = t.where("doc_id is null").withColumns({f"next_{c}": F.lit(None).cast("string") for c in ("text", "fingerprint")})
    t = with_next(t.where("doc_id is not null"), ["text", "fingerprint"]).unionByName(lone)
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    t = t.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.coalesce(F.substring(F.col("next_text"), F.lit(1), k), F.lit(""))))
    t = with_fingerprint(t, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "next_text", "edited")
    t = with_likeness(with_likeness(t, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return t.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
