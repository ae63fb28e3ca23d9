"""Corpus pipeline: quality, language, near duplicates, benchmark passages, tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns a DataFrame that
is written as Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``, any extra ones included.

Defined results: rows with a null or blank text are dropped by the quality stage. A stage whose side table (``labels``,
``benchmark``) is empty drops nothing on its account. An empty ``documents`` gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import bpe, cotrain, decontam, langid, near_dup
from lexloom.session import ship, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the co-trained classifier, fitted on the labelled rows of ``docs``, keeps."""
    return cotrain.kept(docs, cotrain.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which a known language is found."""
    return langid.known(docs, langid.prototypes(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    return near_dup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents without a benchmark passage."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, tokens, n_tokens, round_trip`` of each document."""
    return bpe.encode(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]
#: No stage can be written in SQL: trained classifiers, hyperdimensional vectors, MinHash, SimHash and BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written into the shared folder."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
