"""What each feature and metric means, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import kernels

#: Feature -> (tier, formula, unit, meaning, why it tells spikes from noise).
GUIDE = {
    "peak_amplitude": (2, "max x[t]", "uV", "largest sample", "a unit's positive lobe has a height of its own"),
    "trough_amplitude": (2, "min x[t]", "uV", "smallest sample", "the trough is the largest and steadiest part of a spike"),
    "max_slope": (2, "max x[t] - x[t-1]", "uV/sample", "largest first difference, at least 0", "spikes rise at a repeatable speed"),
    "min_slope": (2, "min x[t] - x[t-1]", "uV/sample", "smallest first difference, at most 0", "spikes fall sharply into the trough"),
    "max_abs_curvature": (2, "max |x[t] - 2 x[t-1] + x[t-2]|", "uV/sample^2", "largest magnitude of the second difference", "a spike turns sharply at one place"),
    "abs_window_sum_peak": (2, "max over t of sum |x| of the last samples", "uV samples", "largest sum of magnitudes over the trailing window", "a spike's energy lies within few samples"),
    "ev_trough_amplitude": (3, "min x[t]", "uV", "smallest sample", "as trough_amplitude"),
    "ev_peak_amplitude": (3, "max x[t]", "uV", "largest sample", "as peak_amplitude"),
    "ev_trough_to_peak_time_samples": (3, "argmax after argmin - argmin", "samples", "samples from the first minimum to the largest later sample", "narrow and broad cells differ in this delay"),
    "ev_half_width_samples": (3, "count x[t] <= min / 2", "samples", "samples at or under half the minimum", "the trough's width depends on the cell type"),
    "ev_full_width_samples": (3, "count x[t] <= min / 10", "samples", "samples at or under a tenth of the minimum", "the whole depolarisation has a typical length"),
    "ev_biphasic_ratio": (3, "|max| / (|min| + 1e-12)", "1", "magnitude of the maximum over that of the minimum", "the balance of both lobes is a unit's own"),
    "ev_signed_area": (3, "sum x[t]", "uV samples", "sum of samples", "noise tends to cancel out, spikes do not"),
    "ev_absolute_area": (3, "sum |x[t]|", "uV samples", "sum of magnitudes", "total energy separates events from background"),
    "ev_max_rising_slope": (3, "max(0, max x[t] - x[t-1])", "uV/sample", "largest first difference, at least 0", "as max_slope"),
    "ev_max_falling_slope": (3, "min(0, min x[t] - x[t-1])", "uV/sample", "smallest first difference, at most 0", "as min_slope"),
    "ev_baseline_rms": (3, "sqrt(mean x[t]^2) of the first 8", "uV", "root mean square of the first samples", "spikes begin from a quiet baseline"),
    "ev_zero_crossing_count": (3, "count of sign changes", "1", "sign changes, zero counted as positive", "noise crosses zero more often"),
}
FEATURES = {name: entry[3] for name, entry in GUIDE.items()}
METRICS = {
    "fisher_score": "squared difference of class means over the sum of class variances",
    "mutual_info": "mutual information of the binned feature and the class, in nats",
    "auc": "chance that a positive scores over a negative, ties half",
    "balanced_accuracy": "mean of the per-class recalls",
    "ari": "adjusted Rand index",
    "nmi": "mutual information over the mean entropy",
    "matched_accuracy": "share of rows on the best one-to-one matching of clusters to units",
    "knn_purity": "share of nearest neighbours with the same unit",
    "silhouette": "mean of (b - a) / max(a, b) over rows",
}


def catalog(spark: SparkSession, n_bins: int = 8) -> DataFrame:
    rows = [("feature", n, t) for n, t in FEATURES.items()]
    rows += [("feature", n, "largest distance from the window's median") for n in kernels.temporal_bin_names(n_bins)]
    rows += [("metric", n, t) for n, t in METRICS.items()]
    return spark.createDataFrame(rows, "kind string, name string, meaning string")


def guide(spark: SparkSession, n_bins: int = 8) -> DataFrame:
    """One row per feature: name, tier, formula, unit, meaning, reason."""
    rows = [(n, *g) for n, g in GUIDE.items()]
    rows += [(n, 2, "max |x - median| in the window", "uV", "largest distance from the window's median", "where in time an event stands out from its surroundings") for n in kernels.temporal_bin_names(n_bins)]
    return spark.createDataFrame(rows, "name string, tier int, formula string, unit string, meaning string, reason string")
