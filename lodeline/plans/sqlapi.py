"""Functions for SQL: registered once for a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodeline.functions import calc, text


def register(spark: SparkSession) -> None:
    """safe_calc(expression) -> struct<value, error>, tokens(text) -> array, nfkc(text), and hide_stored(text) as SQL functions."""
    spark.udf.register("safe_calc", calc.safe_calc)
    spark.udf.register("tokens", text.tokens_exact)
    spark.udf.register("nfkc", text.nfkc)
    rules = "text"
    for pattern, mark in text.STORED_RULES:
        rules = f"regexp_replace({rules}, r'{pattern}', '{mark}')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hide_stored(text STRING) RETURNS STRING RETURN {rules}")
