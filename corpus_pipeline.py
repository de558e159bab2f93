"""A corpus pipeline of five stages; each works on all that the one before kept, and its decisions take effect.

Texts that a stage deletes from stay as rows (a document that line dedup empties keeps an empty text); only quality and near-dedup drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import linededup, minhash, packing, quality, secrets
from quillon.llm.common import materialize, read


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secrets", redact_secrets), ("packing", pack_sequences)]

#: Hashed models and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
