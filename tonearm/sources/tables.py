"""Readers of the parquet tables; each read names its columns, so the scan is pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def has_column(df: DataFrame, name: str) -> bool:
    """Plan-time schema probe, case-insensitive."""
    return name.lower() in {c.lower() for c in df.columns}


def present(column: Column | str) -> Column:
    """True where a string is neither NULL nor empty; both mean "missing" in this data."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & (c != F.lit(""))


def present_any(df: DataFrame, column: str) -> Column:
    """``present`` for strings, not-null for every other type."""
    kind = dict(df.dtypes)[column]
    return present(column) if kind == "string" else F.col(f"`{column}`").isNotNull()


def epoch_seconds(column: str) -> Column:
    """Whole seconds since 1970 of a zone-less or zoned timestamp read as UTC."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{column}` AS TIMESTAMP_NTZ))")


def utc(seconds: str) -> Column:
    """Zone-less UTC timestamp of epoch seconds, whatever the session's zone."""
    return F.expr(f"timestampadd(SECOND, `{seconds}`, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
