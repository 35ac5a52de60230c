"""Training corpus from `documents`: toxicity, near-dedup, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; run() writes each stage's rows as Parquet and rereads them.

Every row is judged by itself: rows of null or repeated ids, null and empty texts
and repeated rows are defined in each stage. No stage but near-dedup drops a null
or empty text; of equal rows near-dedup keeps one, of texts without a word all.
Extra columns of documents go through to the last stage. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, neardup, packing, pii, toxicity
from tidemark.llm.core import keep, materialize, release, scratch, table
from tidemark.llm.queries import pii_key

TOXIC_AT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_AT. The model is fitted on labelled documents of the original table."""
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.filter_toxic(docs, model, TOXIC_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five words and 0.8; rows of null or repeated ids are judged one by one."""
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, pii_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_neardup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise_pii),
    ("best_fit_packing", pack),
]

#: Hashing, tokenizing and fitted models are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        with scratch():  # what a stage stores on its way goes when its rows are written
            docs = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if last is not None:
            release(last)
        last = docs
    return docs
