"""Checks of data and of stored results, as small tables of (check, passed, value)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import align


def _check(df: DataFrame, name: str, value: Column, passed) -> DataFrame:
    return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("check"), "value", F.coalesce(passed(F.col("value")), F.lit(False)).alias("passed"))


def plausibility(df: DataFrame, *, n_units: int = 10, deepest: float = -5.0) -> DataFrame:
    """Morphology, class balance, unit count and amplitude range of a snippet table."""
    means = align.mean_waveform(df.where(F.col("class_label") == 1), ["unit_id"]).groupBy("unit_id").agg(F.min("mean").alias("trough"))
    low = F.array_min("w")
    spread = F.stddev_pop(F.when(F.col("class_label") == 0, low)) - F.stddev_pop(F.when(F.col("class_label") == 1, low))
    checks = [
        _check(means, "morphology", F.max("trough"), lambda v: v < deepest),
        _check(df, "class_balance", F.avg(F.col("class_label").cast("double")), lambda v: v.between(0.25, 0.75)),
        _check(df, "unit_count", F.countDistinct(F.when(F.col("class_label") == 1, F.col("unit_id"))), lambda v: v == n_units),
        _check(df, "amplitude_range", spread, lambda v: v >= 0),
    ]
    return reduce(DataFrame.unionByName, checks)


def roll_up(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if("passed").alias("n_passed"), F.bool_and("passed").alias("all_passed"))


def hard_negatives(df: DataFrame, *, file_col: str = "source", kind_col: str = "kind") -> DataFrame:
    """Per file: depth of excluded over accepted mean troughs; files that lack either are skipped. ``df`` has (file, kind, depth)."""
    mean = df.groupBy(file_col, kind_col).agg(F.avg("depth").alias("d"))
    a = mean.where(F.col(kind_col) == "EXCL").select(file_col, F.col("d").alias("excluded"))
    b = mean.where(F.col(kind_col) == "SU").select(file_col, F.col("d").alias("accepted"))
    return a.join(b, file_col).select(file_col, (F.col("excluded") / F.col("accepted")).alias("depth_ratio"))


def compare_metrics(stored: DataFrame, computed: DataFrame, *, tolerance: float = 1e-4) -> DataFrame:
    """(metric, stored, computed, delta, matches) for two tables (metric, value); a missing side does not match."""
    s, c = stored.select("metric", F.col("value").alias("stored")), computed.select("metric", F.col("value").alias("computed"))
    both = s.join(c, "metric", "full").withColumn("delta", F.abs(F.col("stored") - F.col("computed")))
    return both.withColumn("matches", F.coalesce(F.col("delta") < tolerance, F.lit(False)))


def feature_stats(long: DataFrame, *, label_col: str = "class_label", digits: int = 4) -> DataFrame:
    """Mean, sample deviation, min and max of every feature by class."""
    return long.groupBy("feature", label_col).agg(
        F.round(F.avg("value"), digits).alias("mean"), F.round(F.stddev_samp("value"), digits).alias("std"), F.round(F.min("value"), digits).alias("min"), F.round(F.max("value"), digits).alias("max")
    )


def checksums(spark, path: str, *, chunk: int = 1 << 20) -> DataFrame:
    """SHA-256 and size of every file under ``path``, each read by a task in chunks, so that size does not matter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    schema = "path string, length long, sha256 string"

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            rows = []
            for name, length in zip(batch["path"], batch["length"]):
                system, place = FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                digest = hashlib.sha256()
                with system.open_input_stream(place, compression=None) as stream:
                    while data := stream.read(chunk):
                        digest.update(data)
                rows.append((name, length, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "length", "sha256"])

    return files.mapInPandas(hashes, schema)


def csv_round_trip(df: DataFrame, path: str, *, key: str, tolerance: float = 1e-5) -> DataFrame:
    """Write as CSV, read back and compare all double columns: (column, worst relative difference, n_lost, matches).

    A value that is missing on one side only, or a row that is, counts as lost;
    any loss fails the column. ``key`` must be unique and not null.
    """
    names = [c for c, t in df.dtypes if t == "double"]
    df.write.mode("overwrite").option("header", True).csv(path)
    back = df.sparkSession.read.schema(df.schema).option("header", True).csv(path)
    a = df.select(key, F.lit(1).alias("here__a"), *names)
    b = back.select(key, F.lit(1).alias("here__b"), *[F.col(c).alias(f"{c}__b") for c in names])
    pairs = a.join(b, key, "full")
    missing = F.col("here__a").isNull() | F.col("here__b").isNull()
    stats = []
    for c in names:
        lost = missing | (F.col(c).isNull() != F.col(f"{c}__b").isNull())
        worst = F.max(F.abs(F.col(c) - F.col(f"{c}__b")) / F.greatest(F.abs(c), F.lit(1e-12)))
        stats.append(F.struct(F.lit(c).alias("column"), worst.alias("worst"), F.count_if(lost).alias("n_lost")))
    rows = pairs.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return rows.withColumn("matches", (F.col("n_lost") == 0) & F.coalesce(F.col("worst") <= tolerance, F.lit(True)))


def evaluate(features: DataFrame, bank, *, by_source: str | None = None) -> dict[str, DataFrame]:
    """Apply a stored code to new features: overall metrics, recall per unit, accuracy per source.

    Raises ValueError for features the model needs and the table lacks.
    """
    from . import codebank, metrics

    missing = [f for f in bank.features if f not in features.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    scored = codebank.apply(features, bank).withColumn("predicted", F.col("is_spike").cast("int"))
    a, p = F.col("class_label"), F.col("predicted")
    out = {
        "overall": scored.agg(*[c.alias(n) for n, c in metrics.confusion(a, p).items()], metrics.f1(a, p).alias("f1"), F.avg("score").alias("mean_score")),
        "auc": metrics.roc_auc(scored),
        "per_unit": scored.where(a == 1).groupBy("unit_id").agg(F.avg(p.cast("double")).alias("recall"), F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n")),
    }
    if by_source:
        out["per_source"] = scored.groupBy(by_source).agg(
            F.avg((a == p).cast("double")).alias("accuracy"), F.avg(F.when(a == 1, F.col("score"))).alias("mean_spike_score"), F.avg(F.when(a == 0, F.col("score"))).alias("mean_noise_score")
        )
    return out
