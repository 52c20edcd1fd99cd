"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import (
    decontam,
    embedding_dedup,
    exact_dedup,
    importance,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    pii,
    token_align,
    token_counts,
    toxicity,
)
from palimpsest.session import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return cut.select(
        "doc_id", "removed_words", F.length(text).alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256")
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edit a document: up to twelve characters at a place given by its id make way for its source."""
    docs = table(spark, sf_dir, "documents")
    size = F.length(F.coalesce("text", F.lit("")))
    first = F.crc32(F.col("doc_id").cast("string")) % (size + 1)
    edits = docs.select(
        "doc_id",
        first.alias("first"),
        F.least(first + F.col("doc_id") % 13, size).alias("last"),
        F.concat(F.lit("["), F.col("source"), F.lit("]")).alias("replacement"),
    )
    return token_counts.edit_aware_counts(docs, edits)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_tokenizers(table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_license_scan": op2_license_scan,
    "op3_personal_data": op3_personal_data,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_token_alignment": op12_token_alignment,
    "op13_embedding_dedup": op13_embedding_dedup,
}

ORACLES: dict[str, str] = {
    "op1_source_mixing": mixing.ORACLE,
    "op3_personal_data": pii.ORACLE,
    "op4_decontamination": decontam.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op10_ngram_jaccard": ngram_join.ORACLE,
    "op11_importance_resampling": importance.ORACLE,
    "op13_embedding_dedup": embedding_dedup.ORACLE,
}
