"""Sinks: tables, JSON payloads and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratefield.operators.audit import EVENTS


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; nested columns are left out, as CSV has none."""
    flat = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def payload(df: DataFrame, out: str = "payload") -> DataFrame:
    """Each row as compact JSON."""
    return df.select(F.to_json(F.struct("*")).alias(out))


def append_audit(events: DataFrame, path: str) -> None:
    """Events of a run as JSON lines; runs append. A run has a few events, so they are one file."""
    events.coalesce(1).write.mode("append").json(path)


def read_audit(spark, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).json(path)
