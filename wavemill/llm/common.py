"""Shared helpers: scratch tables in the shared checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/wavemill-checkpoints"
    return f"{base.rstrip('/')}/wavemill-{spark.sparkContext.applicationId}"


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, the one place all executors share.

    Without the setting a cluster run raises an error; only a single-process
    session (tests) falls back to a folder of its own machine.
    """
    return f"{_scratch(spark)}/{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results that were not written out cannot be read after it."""
    delete(spark, _scratch(spark))


def materialize(df: DataFrame, path: str | None = None, *, block_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: later stages restart from files that survive a lost executor.
    ``block_bytes`` bounds the row groups, and so what a reader of long arrays holds at once.
    """
    path = path or work_dir(df.sparkSession)
    (df.write.option("parquet.block.size", block_bytes) if block_bytes else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that no later step reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if a count shows at most ``max_rows`` rows; else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= max_rows else df


def utf8(column: str) -> Column:
    """The text as UTF-8 bytes; null is kept."""
    return F.col(column).cast("string").cast("binary")


def fresh(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` is called so (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
