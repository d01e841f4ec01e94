"""Quantile population code: fit, score, gate, project, store."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.scratch import exact_quantiles

MODEL_SCHEMA = "feature string, feature_index int, weight double, centers array<double>, widths array<double>"


@dataclass(frozen=True)
class CodeBank:
    """A fitted code: per feature the centers and widths of its tuning curves. Small by construction: features x bins."""

    features: tuple[str, ...]
    centers: tuple[tuple[float, ...], ...]
    widths: tuple[tuple[float, ...], ...]
    weights: tuple[float, ...]
    n_bins: int = 10
    sigma_scale: float = 1.0
    threshold: float = 0.5

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> CodeBank:
        d = json.loads(text)
        rows = {k: tuple(map(tuple, d[k])) for k in ("centers", "widths")}
        return CodeBank(tuple(d["features"]), rows["centers"], rows["widths"], tuple(d["weights"]), d["n_bins"], d["sigma_scale"], d["threshold"])

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(f, i, w, list(c), list(s)) for i, (f, c, s, w) in enumerate(zip(self.features, self.centers, self.widths, self.weights))]
        return spark.createDataFrame(rows, MODEL_SCHEMA)

    def describe(self, spark: SparkSession) -> DataFrame:
        """feature, weight, lowest and highest center, mean width."""
        width = F.aggregate("widths", F.lit(0.0), lambda s, x: s + x) / F.size("widths")
        return self.to_frame(spark).select("feature", "feature_index", "weight", F.array_min("centers").alias("low"), F.array_max("centers").alias("high"), width.alias("mean_width"))


def widths_of(centers: list[float], sigma_scale: float = 1.0) -> list[float]:
    """Half the mean spacing to both neighbours (edges repeat the nearest spacing), at least 1e-6."""
    gap = [b - a for a, b in zip(centers, centers[1:])]
    left, right = [gap[0], *gap], [*gap, gap[-1]]
    return [max(0.5 * sigma_scale * (a + b) / 2, 1e-6) for a, b in zip(left, right)]


def quantile_centers(df: DataFrame, features: list[str], n_bins: int, *, approximate: float | None = None) -> dict[str, list[float]]:
    """Evenly spaced quantiles of every feature, exact and interpolated at any size.

    Only with ``approximate``, a relative rank error such as 1e-4, a bounded
    summary is used instead; it does not interpolate.
    """
    if n_bins < 2:
        raise ValueError("n_bins must be at least 2")
    levels = [b / (n_bins - 1) for b in range(n_bins)]
    if approximate is not None:
        row = df.agg(*[F.percentile_approx(f, levels, int(1 / approximate)).alias(f) for f in features]).first()
        found = {f: row[f] for f in features if row[f] is not None}
    else:
        long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "value")
        found = {r["feature"]: r["quantiles"] for r in exact_quantiles(long, levels, by=["feature"], value="value").collect()}  # a row per feature
    if len(found) < len(features):
        raise ValueError("no rows to fit")
    return {f: [float(x) for x in found[f]] for f in features}


def fit(df: DataFrame, features: list[str], *, n_bins: int = 10, sigma_scale: float = 1.0, threshold: float = 0.5, weights: list[float] | None = None) -> CodeBank:
    """Fit on all rows of ``df`` (pass the positive class only). Null values are ignored; no rows raises an error."""
    return from_centers(features, quantile_centers(df, features, n_bins), sigma_scale=sigma_scale, threshold=threshold, weights=weights)


def from_centers(features: list[str], centers: dict[str, list[float]], *, sigma_scale: float = 1.0, threshold: float = 0.5, weights: list[float] | None = None) -> CodeBank:
    """A code from the centers of its features."""
    if set(features) - set(centers):
        raise ValueError("no rows to fit")
    rows = [tuple(float(x) for x in centers[f]) for f in features]
    return CodeBank(tuple(features), tuple(rows), tuple(tuple(widths_of(list(r), sigma_scale)) for r in rows), tuple(weights) if weights is not None else (1.0,) * len(features), len(rows[0]), sigma_scale, threshold)


def _array(values: tuple[float, ...]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def activation(x: Column, centers: tuple[float, ...], widths: tuple[float, ...]) -> Column:
    """Gaussian activations of one feature value, one per bin."""

    def curve(c: Column, s: Column) -> Column:
        dx = (x - c) / (s + 1e-10)
        return F.exp(-0.5 * dx * dx)

    return F.zip_with(_array(centers), _array(widths), curve)


def _largest_activation(x: Column, centers: tuple[float, ...], widths: tuple[float, ...]) -> Column:
    """The activation of the bin whose scaled distance is least, without arrays, so that it is compiled."""
    scaled = [(x - float(c)) / (float(s) + 1e-10) for c, s in zip(centers, widths)]
    return F.exp(-0.5 * F.least(*[d * d for d in scaled]))


def score(bank: CodeBank) -> Column:
    """Weighted mean over features of the largest activation; 0 if the weights sum to 0."""
    total = sum(bank.weights)
    if total <= 0:
        return F.lit(0.0)
    parts = [_largest_activation(F.col(f), c, s) * float(w) for f, c, s, w in zip(bank.features, bank.centers, bank.widths, bank.weights)]
    return sum(parts[1:], parts[0]) / total


def block_score(bank: CodeBank) -> Column:
    """``score`` as a numpy pass over Arrow batches; a row with a null feature has no score."""
    weights, total = np.array(bank.weights, float), sum(bank.weights)
    if total <= 0:
        return F.lit(0.0)
    centers, widths = np.array(bank.centers), np.array(bank.widths) + 1e-10

    @F.arrow_udf("double")
    def scores(values: pa.Array) -> pa.Array:
        flat, n = values.flatten(), len(bank.features)
        x = flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, n)
        out = np.zeros(len(x))
        for j in range(n):
            out += weights[j] * np.exp(-0.5 * (((x[:, [j]] - centers[j]) / widths[j]) ** 2).min(axis=1))
        gone = ~flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n).all(axis=1)
        return pa.array(out / total, pa.float64(), mask=gone)

    return scores(F.array(*[F.col(f).cast("double") for f in bank.features]))


def apply(df: DataFrame, bank: CodeBank, *, score_col: str = "score", gate_col: str = "is_spike", engine: str = "blocks") -> DataFrame:
    """``df`` with score and gate (score at or over the threshold), by numpy blocks or by column expressions."""
    if engine not in ("blocks", "expressions"):
        raise ValueError(f"unknown engine {engine!r}")
    made = block_score(bank) if engine == "blocks" else score(bank)
    return df.withColumn(score_col, made).withColumn(gate_col, F.col(score_col) >= bank.threshold)


def project(df: DataFrame, bank: CodeBank, features: list[str] | None = None, *, out_col: str = "activations") -> DataFrame:
    """``df`` with the flattened activations of the given features, feature by feature."""
    wanted = set(features or bank.features)
    parts = [activation(F.col(f), c, s) for f, c, s in zip(bank.features, bank.centers, bank.widths) if f in wanted]
    return df.withColumn(out_col, F.flatten(F.array(*parts)))


def classify_positive_fit(train: DataFrame, test: DataFrame, features: list[str], *, label_col: str = "class_label", **options) -> DataFrame:
    """The code as a classifier: fitted on the positive rows of ``train``, applied to ``test``."""
    return apply(test, fit(train.where(F.col(label_col) == 1), features, **options), gate_col="predicted").withColumn("predicted", F.col("predicted").cast("int"))

