"""Scans and sinks: CSV and Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.labels import Failure, failure_table
from tidemark.schema import SensorSchema, micros


def read_naive(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with inferred types, for comparison only."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_raw(spark: SparkSession, path: str, schema: SensorSchema | None = None) -> DataFrame:
    """Typed CSV scan: explicit time format, digital channels as bytes, index column dropped, canonical order. A row that
    doesn't parse, or a digital channel without value, stops the job."""
    schema = schema or SensorSchema()
    raw = spark.read.schema(schema.raw_type()).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").option("timestampNTZFormat", schema.timestamp_format).csv(path)
    digital = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} has no value")).cast("byte")).otherwise(F.col(c).cast("byte")) for c in schema.digital}
    analog = {c: F.when(~F.isnan(c), F.col(c)) for c in schema.analog}
    return raw.withColumns(digital | analog).select(*schema.columns)


def sensor_rows(readings: DataFrame, schema: SensorSchema | None = None, series: str = "S1") -> DataFrame:
    """Readings with the engine's own columns: series_id, us and a sequence number."""
    schema = schema or SensorSchema()
    return readings.select(F.lit(series).alias("series_id"), micros(F.col(schema.timestamp)).alias("us"), F.monotonically_increasing_id().alias("event_id"), "*")


def write_parquet(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Overwrites; the path must say what it is."""
    if not path.rstrip("/").endswith(".parquet"):
        raise ValueError(f"not a .parquet path: {path}")
    (df.write.mode("overwrite").partitionBy(*partition) if partition else df.write.mode("overwrite")).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


_TIMES = ("start", "end", "maintenance")


def write_failures(spark: SparkSession, failures: list[Failure], path: str) -> DataFrame:
    """The known failures as CSV, times as dates; returns the typed table."""
    out = failure_table(spark, failures)
    write_report(out.withColumns({c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss") for c in _TIMES}), path)
    return out


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of failures with dates, as microseconds."""
    raw = spark.read.schema(", ".join(["failure_id string", "fault_type string", *[f"{c} timestamp_ntz" for c in _TIMES]])).option("header", True).option("mode", "FAILFAST").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return raw.withColumns({c: micros(F.col(c)) for c in _TIMES})


def read_if_there(spark: SparkSession, path: str, order: str) -> DataFrame | None:
    """A Parquet table in order, or None where there is none."""
    try:
        return spark.read.parquet(path).orderBy(order)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
