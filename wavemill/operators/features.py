"""Feature matrix of snippets: scalar, temporal and event blocks as one projection."""

from __future__ import annotations

from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import blocks, kernels as k


@dataclass(frozen=True)
class TemporalConfig:
    """Overlapping-window features: number of bins, overlap, and how noise scales them."""

    enabled: bool = True
    n_bins: int = 8
    overlap: float = 0.5
    noise_mode: str = "none"
    global_noise_mad: float | None = None
    edge_samples: int = 8
    scale_factor: float = 1.4826


@dataclass(frozen=True)
class FeatureConfig:
    window: int = 16
    n_samples: int = 64
    temporal: TemporalConfig = field(default_factory=TemporalConfig)


def temporal_features(w: Column, n_samples: int, config: TemporalConfig) -> tuple[dict[str, Column], dict]:
    """Columns and their description. Values are divided by the noise scale where that exceeds 1e-8."""
    if config.noise_mode not in ("none", "global", "snippet_edges"):
        raise ValueError(f"unknown noise mode {config.noise_mode!r}")
    bounds = k.window_bounds(n_samples, config.n_bins, config.overlap)
    if config.noise_mode == "none":
        scale = F.lit(1.0)
    elif config.noise_mode == "global":
        if config.global_noise_mad is None:
            raise ValueError("the global mode needs global_noise_mad")
        scale = F.lit(float(config.global_noise_mad) * config.scale_factor)
    else:
        if config.edge_samples <= 0:
            raise ValueError("edge_samples must be positive")
        scale = k.edge_noise_mad(w, config.edge_samples) * config.scale_factor
    divisor = F.when(scale > 1e-8, scale).otherwise(F.lit(1.0))
    columns = {n: k.window_wta(w, s, e) / divisor for n, (s, e) in zip(k.temporal_bin_names(config.n_bins), bounds)}
    return columns, {"names": list(columns), "bounds": bounds, "noise_mode": config.noise_mode, "scale_factor": config.scale_factor}


def build_features(df: DataFrame, config: FeatureConfig = FeatureConfig(), *, tier: int = 2, w_col: str = "w", only: list[str] | None = None, engine: str = "blocks") -> DataFrame:
    """``df`` without its waveform, with the features of the tier: scalar, temporal if enabled, event from tier 3.

    ``only`` computes the named features alone. The engine "blocks" makes one
    numpy pass per Arrow batch; "expressions" stays in the JVM, where the
    derivative arrays are computed in a projection of their own and Catalyst
    drops features nobody reads. Both give the same features.
    """
    if tier not in (1, 2, 3, 4):
        raise ValueError("tier must be 1 to 4")
    if engine not in ("blocks", "expressions"):
        raise ValueError(f"unknown engine {engine!r}")
    keep = [c for c in df.columns if c != w_col]
    names = [n for n in feature_names(config, tier=tier) if only is None or n in only]
    t = config.temporal
    if engine == "expressions":
        w = F.col(w_col)
        staged = df.withColumns({"__d1": k.first_derivative(w), "__d2": k.second_derivative(w)})
        d1, d2 = F.col("__d1"), F.col("__d2")
        columns = k.scalar_features(w, d1, d2, config.window)
        if t.enabled:
            columns |= temporal_features(w, config.n_samples, t)[0]
        if tier >= 3:
            columns |= k.event_features(w, d1)
        return staged.select(*keep, *[columns[n].alias(n) for n in names])
    if t.enabled:
        temporal_features(F.col(w_col), config.n_samples, t)  # checks the configuration
    bounds = k.window_bounds(config.n_samples, t.n_bins, t.overlap) if t.enabled else []
    scale = {"none": 1.0, "global": (t.global_noise_mad or 0.0) * t.scale_factor}.get(t.noise_mode, "edges")
    told = blocks.features(F.col(w_col).cast("array<double>"), names, window=config.window, bounds=bounds, scale=scale, edge=t.edge_samples, factor=t.scale_factor)
    made = df.select(*keep, told.alias("__features"))
    return made.select(*keep, *[F.col(f"__features.{n}").alias(n) for n in names])


def feature_names(config: FeatureConfig = FeatureConfig(), *, tier: int = 2) -> list[str]:
    names = list(k.SCALAR_FEATURES)
    if config.temporal.enabled:
        names += k.temporal_bin_names(config.temporal.n_bins)
    return names + (list(k.EVENT_FEATURES) if tier >= 3 else [])


def to_long(features: DataFrame, names: list[str], *, id_cols: list[str]) -> DataFrame:
    """One row per snippet and feature."""
    return features.unpivot(id_cols, names, "feature", "value")


def resolve_names(available: list[str], wanted: list[str]) -> list[str]:
    """Column names for a list of names and patterns, each once, in order of first mention.

    An exact name also matches with or without the event prefix, the column that
    comes first if several do. A pattern (with * ? or [) gives the names it fits
    as written, then those it fits with the prefix toggled. White space around a
    name does not count; unknown exact names are left out.
    """

    def toggled(name: str) -> str:
        return name[3:] if name.startswith("ev_") else f"ev_{name}"

    alias: dict[str, str] = {}
    for name in available:
        for form in (name, toggled(name)):
            alias.setdefault(form, name)
    out: dict[str, None] = {}
    for spec in map(str.strip, wanted):
        if any(c in spec for c in "*?[]"):
            plain = spec[3:] if spec.startswith("ev_") else spec
            events = [a for a in available if a.startswith("ev_") and fnmatchcase(a[3:], plain)]
            hits = [a for a in available if fnmatchcase(a, spec)] + ([a for a in available if fnmatchcase(a, plain)] if spec.startswith("ev_") else events)
        else:
            hits = [alias[spec]] if spec in alias else []
        out.update(dict.fromkeys(hits))
    return list(out)


def families(names: list[str]) -> dict[str, list[str]]:
    """Feature families by prefix; empty ones are left out."""
    event = [n for n in names if n.startswith("ev_")]
    temporal = [n for n in names if n.startswith("mad_wta_bin_")]
    scalar = [n for n in names if n not in event and n not in temporal]
    found = {"scalar": scalar, "temporal_mad": temporal, "event": event, "full": list(names)}
    return {k_: v for k_, v in found.items() if v}


# The named sets of features that rankings refer to.
FEATURE_SETS = {
    "set_A_ultra_fast": ["peak_amplitude", "trough_amplitude", "max_slope", "min_slope", "max_abs_curvature"],
    "set_B_fast_plus_shape": ["peak_amplitude", "trough_amplitude", "max_slope", "min_slope", "max_abs_curvature", "abs_window_sum_peak"],
    "set_B_temporal_mad": ["mad_wta_bin_*"],
    "set_C_refined_discrimination": ["peak_amplitude", "trough_amplitude", "trough_to_peak_time_samples", "half_width_samples", "biphasic_ratio", "baseline_rms", "signed_area"],
    "set_D_combined": [
        "peak_amplitude", "trough_amplitude", "max_slope", "min_slope", "max_abs_curvature", "abs_window_sum_peak",
        "trough_to_peak_time_samples", "half_width_samples", "biphasic_ratio", "baseline_rms", "signed_area", "absolute_area", "zero_crossing_count",
    ],
    "set_E_combined_plus_temporal_mad": [
        "peak_amplitude", "trough_amplitude", "max_slope", "min_slope", "max_abs_curvature", "abs_window_sum_peak",
        "trough_to_peak_time_samples", "half_width_samples", "biphasic_ratio", "baseline_rms", "signed_area", "absolute_area", "zero_crossing_count", "mad_wta_bin_*",
    ],
}
