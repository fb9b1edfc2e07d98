"""Registered queries of the general training-data operators (p1_...)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import units
from ..runtime import table


def p1_converted(spark: SparkSession, d: str) -> DataFrame:
    return units.to_usd_per_year(
        table(spark, d, "job_postings"), table(spark, d, "pay_units"), id_col="record_id",
        amount="salary.min_amount", currency="salary.currency", period="salary.period", text="salary_text").withColumnRenamed("id", "record_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.in_band(p1_converted(spark, d), table(spark, d, "pay_bands"), "usd_per_year").select("record_id", "band_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_converted)}
