"""Queries of the training-data operators over the shared tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.lexical import lexical_search, lexical_sql
from quern.llm.licenses import license_scan, license_sql
from quern.llm.media import media_round_trip
from quern.llm.merkle import merkle_manifest, merkle_sql
from quern.llm.mixing import mix
from quern.llm.packing import best_fit_packing
from quern.llm.quality import quality_rules, quality_sql
from quern.llm.repeats import remove_repeats
from quern.llm.sharding import lpt_shards
from quern.llm.simhash import simhash_components
from quern.llm.token_counts import token_counts
from quern.llm.token_store import token_store
from quern.llm.warc import warc_round_trip, warc_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_round_trip(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mix(docs, docs, _table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op8_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards(_table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(_table(spark, sf_dir, "documents"))


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_media_columns,
        op3_token_counts,
        op4_simhash,
        op5_quality_rules,
        op6_mixing,
        op7_warc,
        op8_lpt_sharding,
        op9_token_store,
        op10_remove_repeats,
        op11_license_scan,
        op12_merkle_manifest,
        op13_lexical_search,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": quality_sql(),
    "op7_warc": warc_sql(),
    "op11_license_scan": license_sql(),
    "op12_merkle_manifest": merkle_sql(),
    "op13_lexical_search": lexical_sql(),
}
