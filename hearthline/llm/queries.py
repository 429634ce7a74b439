"""Registered queries of this subpackage: each applies one operator, at production parameters, to a whole given table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embedding_dedup, langid, licenses, mixing, negatives, packing, periodic, simhash, suffixes, token_output, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), bits=4, width=4)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.blocks(_table(spark, sf_dir, "documents"), flatten=0.5, max_passes=4.0)
    return mixed.select("doc_id", "source", "mix_pass")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=1024)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.materialised(_table(spark, sf_dir, "documents"), length=1024)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, label = _table(spark, sf_dir, "embeddings"), F.col("label")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0, positives=5, negatives=5)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.planted(_table(spark, sf_dir, "documents"))
    return periodic.run_digests(periodic.collapse_runs(docs, ["doc_id"], least_words=6, least_roots=4))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.predict_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


_ALL = (
    op1_vector_search,
    op2_simhash,
    op3_warc,
    op4_mixing,
    op5_best_fit_packing,
    op6_licenses,
    op7_training_order,
    op8_language,
    op9_repeated_strings,
    op10_embedding_dedup,
    op11_hard_negatives,
    op12_periodic_runs,
    op13_toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: DuckDB SQL of the queries that SQL can express on whole tables; the others are tested against brute force.
ORACLES: dict[str, str] = {"op4_mixing": mixing.oracle(), "op6_licenses": licenses.oracle()}
