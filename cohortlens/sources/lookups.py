"""Literal lookup tables (measure display names, mixture model names)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.schema import MEASURE_LABELS, MODEL_NAMES


def measure_lookup(spark: SparkSession) -> DataFrame:
    """(variable, variable_clean): 12 rows, safe to broadcast."""
    return spark.createDataFrame(MEASURE_LABELS, "variable string, variable_clean string")


def model_lookup(spark: SparkSession) -> DataFrame:
    """(model, model_name): 18 rows, safe to broadcast."""
    return spark.createDataFrame(MODEL_NAMES, "model string, model_name string")


def values_sql(rows, columns) -> str:
    """The same table as an SQL VALUES list (for SQL oracles)."""
    def q(v):
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(columns)})"
