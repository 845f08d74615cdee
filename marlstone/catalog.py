"""All registered queries of the library and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import ids, merge, pages, rules, sequential, services, shipments, spatial, tables, tasks  # noqa: F401
from .plans.dialect import catalogue


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.queries()["jn01_pipeline_merge"](spark, sf_dir)


def queries():
    return catalogue.queries()


def oracle_sql():
    return catalogue.oracle_sql()
