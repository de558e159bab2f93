"""Synonym and antonym expansion of criterion terms over lexicon tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def senses(lemma_synsets: DataFrame, most: int = 3) -> DataFrame:
    return lemma_synsets.where(F.col("sense_rank") < most)


def synonyms(terms: DataFrame, lemma_synsets: DataFrame, most: int = 12, weight: float = 0.6) -> DataFrame:
    """(cid, term, weight) -> (cid, source, term, weight): lemmas of the first three senses, at most ``most`` for each source, none that the criterion already has."""
    own = terms.join(senses(lemma_synsets).withColumnRenamed("lemma", "term"), "term").withColumnRenamed("term", "source")
    near = own.join(lemma_synsets.select("synset", F.col("lemma").alias("term")), "synset").where("term <> source")
    near = near.groupBy("cid", "source", "term", "weight").agg(F.min("sense_rank").alias("r"))
    near = near.join(terms.select("cid", "term"), ["cid", "term"], "left_anti")
    w = Window.partitionBy("cid", "source").orderBy("r", "term")
    return near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("cid", "source", "term", (F.col("weight") * weight).alias("weight"))


def antonyms(terms: DataFrame, pairs: DataFrame, most: int = 6) -> DataFrame:
    both = pairs.select(F.col("lemma_a").alias("term"), F.col("lemma_b").alias("opposite")).union(pairs.select("lemma_b", "lemma_a")).distinct()
    w = Window.partitionBy("cid", "source").orderBy("term")
    out = terms.join(both, "term").select("cid", F.col("term").alias("source"), F.col("opposite").alias("term"), "weight")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def synonym_only(expanded: DataFrame, present: DataFrame) -> DataFrame:
    """The first synonym that the state has, for each source that it lacks."""
    lacking = expanded.join(present.select("request_id", F.col("term").alias("source")), ["request_id", "source"], "left_anti")
    w = Window.partitionBy("request_id", "cid", "source").orderBy("n")
    return lacking.join(present, ["request_id", "term"]).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
