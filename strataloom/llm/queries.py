"""The operators applied to whole tables with production parameters, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, interpolation, language, merkle, mixing, near_vectors, ngram_join, packing, quality, sql, token_counts, token_files, url_filter
from .common import Scratch, held_out


#: Rows whose crc32 of doc_id this divides claim a wrong n_chars, to show that the manifest tells.
TAMPERED = 7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    told = language.identify(docs.select("doc_id", "text"), docs.where(~held_out(F.col("doc_id"))))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    scratch = Scratch(spark, "ann")
    index = scratch.keep(ann.build_index(vectors), "index")
    return ann.search(index, vectors.where(F.col("vec_id") % 50 == 0), scratch=scratch)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    seen = docs.where(~held_out(F.col("doc_id")))
    rated = quality.rate_quality(docs.select("doc_id", "text"), seen, _table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    return rated.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).drop("trust")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + hit.cast("int").cast("decimal(20,0)")).cast("string")
    claimed = {"n_chars": F.when(hit, more).otherwise(F.col("n_chars").cast("string"))}
    docs = _table(spark, sf_dir, "documents")
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", claimed, proofs=False)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return interpolation.score_texts(_table(spark, sf_dir, "documents"), held)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_mix_to_target_weights, op2_near_vectors, op3_language_id, op4_token_counts, op5_best_fit_packing, op6_token_files,
        op7_nearest_neighbours, op8_quality_classifier, op9_ngram_jaccard_join, op10_url_filter,
        op11_merkle_manifest, op12_phrase_collocations, op13_lm_scoring, pipeline,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_vectors": sql.near_vectors(near_vectors.THRESHOLD),
        "op7_nearest_neighbours": sql.nearest(50, 5),
        "op9_ngram_jaccard_join": sql.ngram_join(ngram_join.WORDS, ngram_join.THRESHOLD),
        "op10_url_filter": sql.url_filter(url_filter.RULES, url_filter.DAMPING, url_filter.STEPS, url_filter.THRESHOLD, url_filter.DIGITS),
        "op11_merkle_manifest": sql.manifest(TAMPERED),
        "op12_phrase_collocations": sql.collocations(collocations.MAX_WORDS, collocations.LEAST, collocations.SHARE, collocations.MOST),
    }
