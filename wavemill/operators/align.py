"""Snippet cutting and alignment by the trough, and per-unit mean shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cut_window(w: Column, center: Column, length: int) -> Column:
    """``length`` samples that begin a quarter of the length before 0-based ``center``, kept inside the snippet."""
    start = F.greatest(center - length // 4, F.lit(0))
    start = F.greatest(F.lit(0), F.least(start, F.size(w) - length))
    return F.slice(w, start.cast("int") + 1, F.lit(length))


def trough_index(w: Column) -> Column:
    """0-based place of the first minimum."""
    return (F.array_position(w, F.array_min(w)) - 1).cast("int")


def align_each(df: DataFrame, length: int, *, w_col: str = "w", out_col: str = "aligned") -> DataFrame:
    w = F.col(w_col)
    return df.withColumn(out_col, cut_window(w, trough_index(w), length))


def mean_waveform(df: DataFrame, by: list[str], *, w_col: str = "w") -> DataFrame:
    """Element-wise mean and deviation per group: (by, pos, mean, std), aggregated partially before the shuffle."""
    rows = df.select(*by, F.posexplode(w_col).alias("pos", "x"))
    return rows.groupBy(*by, "pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("n"))


def align_to_mean(df: DataFrame, length: int, *, w_col: str = "w", out_col: str = "aligned") -> DataFrame:
    """As ``align_each``, at the trough of the mean of all snippets."""
    low = mean_waveform(df, [], w_col=w_col).agg(F.min_by("pos", F.struct(F.round("mean", 12), F.col("pos"))).alias("__center"))
    return df.crossJoin(F.broadcast(low)).withColumn(out_col, cut_window(F.col(w_col), F.col("__center"), length)).drop("__center")


def cut_around_trough(df: DataFrame, before: int, after: int, *, search_from: int = 0, flat_above: float = -0.01, w_col: str = "w", out_col: str = "aligned") -> DataFrame:
    """Samples around the trough found from ``search_from`` on, zero-padded at the end; flat traces are dropped."""
    w = F.col(w_col)
    tail = F.slice(w, F.lit(search_from + 1), F.size(w))
    at = search_from + trough_index(tail)
    start = F.greatest(F.lit(0), at - before)
    end = F.least(F.size(w), at + after)
    part = F.slice(w, start + 1, end - start)
    padded = F.concat(part, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(before + after) - F.size(part))))
    return df.where((F.size(w) > search_from) & (F.array_min(tail) <= flat_above)).withColumn(out_col, padded)


def curated(df: DataFrame, *, w_col: str = "w", scale_col: str = "scale", file_col: str = "file", ts_col: str = "ts_us") -> DataFrame:
    """Samples to microvolts and epoch microseconds to seconds since the file's first event."""
    from pyspark.sql import Window as W

    first = F.min(ts_col).over(W.partitionBy(file_col))
    return df.withColumns({"uv": F.transform(w_col, lambda x: x * F.col(scale_col) * 1e6), "t_rel": (F.col(ts_col) - first) / 1e6})
