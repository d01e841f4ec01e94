"""Static operation counts and measured throughput of the kernels, as stored records."""

from __future__ import annotations

import platform
import time
from collections.abc import Callable
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions import blocks

#: Arithmetic and memory operations per sample of every kernel.
OPERATIONS = {"amplitude": (0, 2), "first_derivative": (1, 3), "second_derivative": (3, 4), "absolute_window_sum": (1, 2), "short_window_energy": (2, 2), "teager_energy": (3, 4)}

RECORD = (
    "kernel string, backend string, n_snippets long, n_samples long, arith_per_sample int, mem_per_sample int, arith_total long, mem_total long, seconds double, "
    "snippets_per_s double, samples_per_s double, run_at string, python_version string, numpy_version string, spark_version string, notes string"
)


def operation_counts(spark: SparkSession, snippets: DataFrame, *, w_col: str = "w") -> DataFrame:
    """Per kernel: operations per sample times the samples of the table."""
    table = spark.createDataFrame([(k, a, m) for k, (a, m) in OPERATIONS.items()], "kernel string, arith_per_sample int, mem_per_sample int")
    n = snippets.agg(F.sum(F.size(w_col)).alias("samples"))
    return table.crossJoin(n).select("kernel", "arith_per_sample", "mem_per_sample", (F.col("arith_per_sample") * F.col("samples")).alias("arith_total"), (F.col("mem_per_sample") * F.col("samples")).alias("mem_total"))


def profile_kernel(snippets: DataFrame, name: str, kernel: Callable[[Column], Column], *, repeats: int = 3, w_col: str = "w", backend: str = "spark", notes: str = "") -> dict:
    """The record of one kernel: best wall time over the whole table into a sink that discards, and what it read.

    ``kernel`` takes the waveform column and gives any column. Rows and samples
    are Spark's own observation of the measured run, so the table is not counted
    beforehand. A kernel without known operations has none in its record.
    """
    best, seen = float("inf"), {}
    for _ in range(max(1, repeats)):
        told = Observation()
        rows = snippets.observe(told, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(w_col)), F.lit(0)).cast("long").alias("samples"))
        began = time.perf_counter()
        rows.select(kernel(F.col(w_col))).write.format("noop").mode("overwrite").save()
        best, seen = min(best, time.perf_counter() - began), told.get
    n, samples = seen["rows"], seen["samples"]
    arith, mem = OPERATIONS.get(name, (None, None))
    return {
        "kernel": name, "backend": backend, "n_snippets": n, "n_samples": samples, "arith_per_sample": arith, "mem_per_sample": mem,
        "arith_total": None if arith is None else arith * samples, "mem_total": None if mem is None else mem * samples, "seconds": best,
        "snippets_per_s": n / best, "samples_per_s": samples / best, "run_at": datetime.now(timezone.utc).isoformat(), "python_version": platform.python_version(),
        "numpy_version": np.__version__, "spark_version": snippets.sparkSession.version, "notes": notes,
    }


def profile(snippets: DataFrame, *, repeats: int = 3, window: int = 16, w_col: str = "w", notes: str = "", path: str | None = None) -> list[dict]:
    """Records of all kernels; with ``path`` they are appended there as a table."""
    rows = [profile_kernel(snippets, n, lambda w, n=n: blocks.kernel(n, w, window), repeats=repeats, w_col=w_col, notes=notes) for n in blocks.KERNELS]
    if path:
        records(snippets.sparkSession, rows).write.mode("append").parquet(path)
    return rows


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in RECORD.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RECORD)


def profile_block(name: str, block: np.ndarray, *, repeats: int = 5, window: int = 16) -> dict:
    """Snippets and samples per second of the numpy kernel alone, on a block (snippets x samples) in memory."""
    best = float("inf")
    for _ in range(repeats):
        began = time.perf_counter()
        blocks.KERNELS[name](block, window)
        best = min(best, time.perf_counter() - began)
    return {"kernel": name, "backend": "block", "n_snippets": len(block), "n_samples": block.size, "seconds": best, "snippets_per_s": len(block) / best, "samples_per_s": block.size / best}
