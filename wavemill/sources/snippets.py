"""Adapters from the shared tables to the library's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snippet_id, w, unit_id, class_label) from the vector table; unit 0 is noise."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("snippet_id"),
        F.col("embedding").cast("array<double>").alias("w"),
        F.col("label").alias("unit_id"),
        (F.col("label") > 0).cast("int").alias("class_label"),
    )


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, unit_id, ts, t, event_type, value): event trains with time in seconds."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("unit_id"), "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_type", "value"
    )
