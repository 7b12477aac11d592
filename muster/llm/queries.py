"""One query for each operator, over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import (
    ann,
    chat,
    classifier,
    html,
    licenses,
    minhash,
    mix,
    packing,
    periodic,
    phrases,
    quality,
    shard,
    simhash,
)
from muster.llm.oracles import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Hashes XXH64 has, trained models and tokenizers are beyond SQL; the tests have brute force.
ORACLES: dict[str, str] = oracles()


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op2_license_sentences(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.array_join("sentences", ",").alias("sentences"),
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("rest", ",").alias("rest"),
        "n_licenses",
    )


@_query
def op5_quality_ngram_ratio(spark: SparkSession, folder: str) -> DataFrame:
    trusted = _table(spark, folder, "labels").where("quality = 1")
    return quality.judge(_table(spark, folder, "documents"), trusted)


@_query
def op6_perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rotate(_table(spark, folder, "conversations"))


@_query
def op8_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    assigned = shard.assign_shards(_table(spark, folder, "documents"), 8)
    return assigned.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op9_block_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mix_taken(_table(spark, folder, "documents"))


@_query
def op4_simhash_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query
def op10_bestfit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


@_query
def op7_positive_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.classify(
        _table(spark, folder, "documents"), _table(spark, folder, "labels")
    )


@_query
def op3_mincut_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(_table(spark, folder, "pages"))


@_query
def op1_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents"))


@_query
def op12_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


@_query
def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    planted = periodic.repeat_tails(_table(spark, folder, "documents"))
    return periodic.summary(periodic.runs(planted))
