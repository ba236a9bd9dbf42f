"""A training corpus from raw documents: quality, language, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import language, mixing, ngram_join, packing, quality
from strataloom.llm.common import Scratch, held_out


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = quality.rate_quality(docs, docs.where(~held_out(F.col("doc_id"))), labels)
    return rated.where(F.col("quality_score") >= quality.THRESHOLD).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence, whatever their label says."""
    told = language.identify(docs, docs.where(~held_out(F.col("doc_id"))))
    return told.where(language.confident(F.col("lang_pred"), F.col("lang_score"))).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more connect."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it."""
    return mixing.mixture(docs)


#: Pieces of text whose ids a worker keeps while it packs: fewer than a job of its own may, as executors have been through
#: four stages by then. It costs time only.
CACHE = 100_000


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, cache=CACHE)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Classifiers, tilts and packing have no SQL form; tests hold each stage's rows against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is stored and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = len(Scratch.opened)
        done = scratch.keep(stage(spark, docs, sf_dir), name)
        Scratch.clear_since(before)
        scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
