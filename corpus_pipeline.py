"""From raw documents to token ids: language, near-duplicates, benchmark leaks, personal data, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept
and returns the columns of its input; the last returns token ids. Stages:

* language_id drops documents without a letter or with no language told at
  even odds, after training on the labelled documents outside the held-out fold;
* simhash_near_dedup keeps one document of each component of fingerprints;
* benchmark_decontamination drops documents with a benchmark item within its error budget;
* pii replaces personal data by its kind in brackets and counts the characters anew;
* sentencepiece returns doc_id, ids, n_ids, decoded_sha256 and round_trip.

A null or empty text has no letter, so language_id drops it; texts of any length
are taken whole. Of equal texts the row of the smallest id stays, a row without
an id only where no other of its group has one; rows that repeat id and text are
one. Columns beside those of documents pass through all stages but the last,
whatever their names. Empty tables give empty tables with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permrisk.llm import decontaminate, language_id, pii, sentencepiece_fst, simhash
from permrisk.llm.common import fold, materialize, table

LANG_MODULUS, LANG_HELD = 4, 2


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(fold("doc_id", LANG_MODULUS) != LANG_HELD))
    return language_id.confident(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("language_id", told_language),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("sentencepiece", to_ids),
]

#: The stages cannot be said in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
