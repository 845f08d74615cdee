"""Readers and writers for the file kinds that the queries meet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema; missing strings are blank (SRC06)."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).csv(path).na.fill("")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON documents (SRC07)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """The first PDF by name in each folder: (doc_id, path, length) (SRC10)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder).select("path", "length")
    named = files.withColumn("doc_id", F.element_at(F.split("path", "/"), -2)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.groupBy("doc_id").agg(F.min_by("path", "name").alias("path"), F.min_by("length", "name").alias("length"))


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with a header; with a byte-order mark, the first header name carries it (SNK01, SNK02)."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").option("header", True).csv(path)


def slug(assay: str) -> str:
    return re.sub(r"[ /]", "_", assay)


def write_assays(df: DataFrame, path: str, assay: str = "assay") -> None:
    """One JSON folder for each assay, named as the assay with blanks and slashes as "_" (SNK03)."""
    df.withColumn("assay_slug", F.regexp_replace(assay, "[ /]", "_")).write.mode("overwrite").partitionBy("assay_slug").json(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Append-only JSON lines (SNK04)."""
    df.write.mode("append").json(path)


def read_lists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of whole-file JSON lists; files with anything else at the top hold none (SRC07)."""
    whole = spark.read.option("wholetext", True).text(path).where(F.col("value").rlike(r"(?s)^\s*\[.*\]\s*$"))
    return whole.select(F.explode(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>")).alias("r")).select("r.*")


def write_named(files: DataFrame, path: str) -> None:
    """A file for each (name, body), by the executors and Hadoop's file system alone."""
    parts = files.withColumn("folder", F.element_at(F.split("name", "/"), 1)).withColumn("file", F.element_at(F.split("name", "/"), -1))
    fs = files.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    conf = files.sparkSession.sparkContext._jsc.hadoopConfiguration()
    target = fs.Path(path)
    system = target.getFileSystem(conf)
    for r in parts.distinct().toLocalIterator():  # a registry's folders: few, small files
        out = system.create(fs.Path(f"{path}/{r['folder']}/{r['file']}"))
        out.write(bytearray(r["body"], "utf-8"))
        out.close()


def replace_records(spark: SparkSession, path: str, edits: DataFrame, key: str) -> None:
    """A table with the records of the edits in place of those with the same key (SNK07): the new
    table is written whole beside the old one, which then gives way to it."""
    old = spark.read.parquet(path)
    new = old.join(edits.select(key), key, "left_anti").unionByName(edits.select(*old.columns))
    beside = f"{path}-new"
    new.write.mode("overwrite").parquet(beside)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(fs.Path(path), True)
    system.rename(fs.Path(beside), fs.Path(path))
