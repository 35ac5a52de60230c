"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, lines, neardup, packing, pii, quality, secrets, substrings, toxicity
from .core import table

#: In op1, a plain turn that is not the assistant's is a call for a reply; it refers to the call two turns before it.
CHAT_SCHEMA = {role: {"after": ("object", False), "text": ("string", True), "turn": ("integer", True)} for role in ("user", "system")}
#: Key of op4's pseudonyms where spark.tidemark.pii.key is unset: public, for results that can be repeated, not for use.
PII_KEY = "public-example-key"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.tidemark.pii.key", PII_KEY)


def held_out(folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls and results as they are marked up, and plain turns read as calls and results.

    A plain turn that is not the assistant's, a null role included, is a call "t<turn>"; the assistant's plain turn is
    the result of the call of the turn before.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked_calls, marked_results = chat.parse_calls(turns)
    mine = F.coalesce(F.col("role") == "assistant", F.lit(False))
    marked = (mine & F.coalesce(F.col("text").contains("<tool_call>"), F.lit(False))) | F.coalesce(F.col("role") == "tool", F.lit(False))
    name = lambda back: F.concat(F.lit("t"), (F.col("turn") - back).cast("string"))
    after = F.struct(name(2).alias("$ref"))
    calls = turns.where(~mine & ~marked).select("conv_id", "turn", name(0).alias("call_id"), F.col("role").alias("name"), F.to_json(F.struct("turn", "text", after.alias("after"))).alias("arguments"))
    results = turns.where(mine & ~marked).select("conv_id", "turn", name(1).alias("call_id"), F.col("text").alias("content"))
    out = chat.link(calls.unionByName(marked_calls), results.unionByName(marked_results), CHAT_SCHEMA)
    return out.select("conv_id", F.col("level").cast("int"), F.col("turn").cast("long"), F.col("step").cast("int"), "call_id", "linked", "valid", "record")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_words")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark), count_col="n_replaced")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_segments")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lines.fit_lines(docs, table(spark, sf_dir, "labels"))
    out = lines.label_lines(docs, model)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_quality_classifier,
        op3_best_fit_packing,
        op4_pii,
        op5_decontamination,
        op6_toxicity,
        op7_substring_dedup,
        op8_quality_rules,
        op9_minhash_neardup,
        op10_secret_scan,
    )
}
