"""A training corpus from `documents`: language ID, toxicity, near duplicates, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vicinal.llm import bpe, langid, mixing, ngram_join, toxicity
from vicinal.llm.common import staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; those without letters and the ambiguous ones go."""
    columns = tuple(docs.columns)
    renamed = docs.toDF(*(f"k{i}" for i in range(len(columns))))
    at = {c: F.col(f"k{i}") for i, c in enumerate(columns)}
    d = langid.predict(renamed.select("*", at["text"].alias("text")), langid.train(docs), tuple(renamed.columns))
    return d.filter((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(columns)))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    columns = tuple(docs.columns)
    renamed = docs.toDF(*(f"k{i}" for i in range(len(columns))))
    at = {c: F.col(f"k{i}") for i, c in enumerate(columns)}
    d = toxicity.score(renamed.select("*", at["text"].alias("text")), toxicity.train(docs, table(spark, sf_dir, "labels")), tuple(renamed.columns))
    return d.filter(F.col("score") < 0.5).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(columns)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return ngram_join.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids, and of what they decode to, of each document of the mix."""
    return bpe.encode(docs, bpe.default_path())


STAGES = [
    ("language ID", language_id),
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_copies),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
