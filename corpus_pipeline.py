"""The training-data pipeline: five stages over ``documents``, each written and reread.

A stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the
columns of ``documents``; the last one adds what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontam, line_dedup, mixing, ngram_join, toxicity
from palimpsest.llm.columns import unused
from palimpsest.session import stored, table

#: Neither the label model nor patience alignment can be expressed in SQL; tests compare run() with
#: a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text has the least score and stays; rows that repeat an id are judged each by
    their own text; an empty table stays empty; columns of any name are returned as they were.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; a document left without a word goes whole.

    A null or empty text stays as it is; equal rows that repeat an id are one document and stay
    alike, different ones are ordered by their texts' hashes; an empty table stays empty; columns of
    any name are returned as they were, but for n_chars, which follows the text.
    """
    removed = unused(docs, "removed_words")
    cut = line_dedup.line_dedup(docs, removed_col=removed)
    kept = cut.where(f"`{removed}` = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def dedup_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Texts without words are similar to none and stay, as do rows without an id; all rows with the id
    that stays do; an empty table stays empty; columns of any name are returned as they were.
    """
    return ngram_join.first_of_each_group(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Texts and items without words match nothing; rows that repeat an id are judged each by their own
    text; an empty table stays empty; columns of any name are returned as they were.
    """
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with size, source_size, target and taken words.

    A text without words is not taken; every row that repeats an id is a document of its own; an empty
    table stays empty; columns with the names of the four that are added are replaced by them.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_similar),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
