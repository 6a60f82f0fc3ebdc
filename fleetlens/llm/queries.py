"""Queries of the subpackage, applied to whole tables with production parameters."""

from __future__ import annotations

import math
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontam, fingerprints, lm_score, mixing, near_dedup, quality, resampling, sharding, suffix_dedup, token_counts, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents")).drop("anchors")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), most_idf=math.inf).drop("text_key")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_captures(url_filter.pages_captures(pages), url_filter.pages_entries(pages))


def op11_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """model: where the driver finds the sentencepiece file; the public piece_bpe_32k.model unless given."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), Path(model).read_bytes())


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_mixing, op3_suffix_dedup, op4_near_dedup, op5_lm_score,
        op6_decontamination, op7_sharding, op8_quality, op9_toxicity, op10_url_filter,
        op11_token_counts, op12_importance_resampling, op13_collocations,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.MIX_SQL.format(docs="documents"),
    "op5_lm_score": lm_score.LM_SQL.format(docs="documents"),
    "op7_sharding": sharding.SHARD_SQL.format(docs="documents", limit=sharding.LIMIT_BYTES),
    "op10_url_filter": url_filter.URL_SQL,
    "op12_importance_resampling": resampling.RESAMPLE_SQL.format(docs="documents", target="benchmark", buckets=resampling.BUCKETS, seed=resampling.SEED, min_words=resampling.MIN_WORDS, percent=resampling.PERCENT),
    "op13_collocations": collocations.PHRASE_SQL.format(docs="documents", least=collocations.LEAST, inside=collocations.INSIDE_PERCENT, top=collocations.TOP),
}
