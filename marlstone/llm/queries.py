"""What this folder registers: one query for each operator, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, gif, license_scan, nn_descent, packing, range_coder, sharding, simhash, suffix_dedup, toxicity


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(common.read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(common.read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(common.read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_coder.read_tokens(range_coder.write_tokens(common.read(spark, sf_dir, "documents")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(common.read(spark, sf_dir, "documents"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(common.read(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.read(spark, sf_dir, "documents"))


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_columns(common.read(spark, sf_dir, "documents"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql():
    return {"op1_license_scan": license_scan.oracle()}
