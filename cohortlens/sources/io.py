"""CSV scans and sinks, catalog tables, saved result bundles.

Output folders live under the cluster's shared checkpoint folder unless a
path is given, never on a machine-local temporary disk.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortlens.session import checkpoint_dir

# Declared schema of the raw extract (no inference): the four text measures stay strings.
RAW_SCHEMA = T.StructType([
    T.StructField("person_id", T.LongType()),
    T.StructField("org_id_provider", T.StringType()),
    T.StructField("first_contact", T.DateType()),
    T.StructField("last_contact", T.DateType()),
    T.StructField("care_mid_date", T.DateType()),
    T.StructField("care_contacts", T.DoubleType()),
    T.StructField("referrals", T.DoubleType()),
    T.StructField("length_care", T.DoubleType()),
    T.StructField("average_daily_contacts", T.DoubleType()),
    T.StructField("contact_prop_aft_midpoint", T.DoubleType()),
    T.StructField("team_input_count", T.StringType()),
    T.StructField("intermittent_care_periods", T.StringType()),
    T.StructField("specialist_contact_prop", T.DoubleType()),
    T.StructField("remote_contact_prop", T.DoubleType()),
    T.StructField("avg_contact_duration", T.StringType()),
    T.StructField("acute_admissions_2223", T.StringType()),
])


def results_root(spark: SparkSession) -> str:
    """A fresh folder for this run's outputs, under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex[:12]}"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA,
             null_value: str = "NA") -> DataFrame:
    """Header CSV with a declared schema; split files are read in parallel."""
    return (spark.read.schema(schema).option("header", True).option("nullValue", null_value)
            .option("mode", "PERMISSIVE").csv(path))


def write_csv(df: DataFrame, path: str) -> str:
    """Header CSV, no row-number column (rows have no position in Spark)."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)
    return path


def use_schema(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.catalog.setCurrentDatabase(database)


def write_table(df: DataFrame, name: str, path: str) -> None:
    """Register a temp view of the same name and save an external table at ``path``."""
    df.createOrReplaceTempView(name.split(".")[-1] + "_view")
    df.write.mode("overwrite").option("path", path).saveAsTable(name)


def save_bundle(frames: dict[str, DataFrame], path: str) -> str:
    """Save a named set of result tables (labels, metrics, centres) as parquet."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def load_bundle(spark: SparkSession, path: str, names) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
