"""Array expressions over one snippet: time-series kernels and scalar reducers.

Every function takes and returns a Spark column. Arrays are ARRAY<DOUBLE>; a
null array gives null, an empty one an empty array or a null reducer (counts and
sums give 0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _zero() -> Column:
    return F.lit(0.0)


def amplitude(w: Column) -> Column:
    return w


def first_derivative(w: Column) -> Column:
    """x[t] - x[t-1], and 0 at the first sample."""
    return F.transform(w, lambda x, i: F.when(i == 0, _zero()).otherwise(x - F.get(w, i - 1)))


def second_derivative(w: Column) -> Column:
    """x[t] - 2 x[t-1] + x[t-2], and 0 at the first two samples."""
    return F.transform(w, lambda x, i: F.when(i < 2, _zero()).otherwise(x - 2 * F.get(w, i - 1) + F.get(w, i - 2)))


def _trailing(w: Column, window: int, term) -> Column:
    if window < 1:
        raise ValueError("window must be at least 1")

    def at(_x: Column, i: Column) -> Column:
        part = F.slice(w, F.greatest(i - (window - 2), F.lit(1)), F.least(i + 1, F.lit(window)))
        return F.aggregate(part, _zero(), lambda s, x: s + term(x))

    return F.transform(w, at)


def absolute_window_sum(w: Column, window: int = 16) -> Column:
    """Sum of magnitudes of the last ``window`` samples, fewer at the start."""
    return _trailing(w, window, F.abs)


def short_window_energy(w: Column, window: int = 16) -> Column:
    """Sum of squares of the last ``window`` samples, fewer at the start."""
    return _trailing(w, window, lambda x: x * x)


def teager_energy(w: Column) -> Column:
    """x[t]^2 - x[t-1] x[t+1], and 0 at both ends."""
    last = F.size(w) - 1
    return F.transform(w, lambda x, i: F.when((i == 0) | (i == last), _zero()).otherwise(x * x - F.get(w, i - 1) * F.get(w, i + 1)))


#: Name -> kernel(w, window).
KERNELS = {
    "amplitude": lambda w, window: amplitude(w),
    "first_derivative": lambda w, window: first_derivative(w),
    "second_derivative": lambda w, window: second_derivative(w),
    "absolute_window_sum": absolute_window_sum,
    "short_window_energy": short_window_energy,
    "teager_energy": lambda w, window: teager_energy(w),
}


def abs_max(w: Column) -> Column:
    return F.array_max(F.transform(w, F.abs))


def total(w: Column) -> Column:
    return F.aggregate(w, _zero(), lambda s, x: s + x)


def median(w: Column) -> Column:
    """Mean of the two middle order statistics; null for an empty array."""
    s, n = F.sort_array(w), F.size(w)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a one-element array binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mad(w: Column) -> Column:
    """Median of absolute deviations from the median."""
    return _let(median(w), lambda m: median(F.transform(w, lambda x: F.abs(x - m))))


def window_wta(w: Column, start: int, end: int) -> Column:
    """Largest |x - median| within samples [start, end)."""
    part = F.slice(w, start + 1, end - start)
    return _let(median(part), lambda m: F.array_max(F.transform(part, lambda x: F.abs(x - m))))


def edge_noise_mad(w: Column, edge: int = 8) -> Column:
    """MAD of the leading and trailing samples, at most half the snippet from either side."""
    k = F.least(F.lit(edge), F.greatest(F.lit(1), F.floor(F.size(w) / 2).cast("int")))
    return mad(F.concat(F.slice(w, F.lit(1), k), F.slice(w, F.greatest(F.size(w) - k + 1, F.lit(1)), k)))


def window_bounds(n_samples: int, n_bins: int, overlap: float = 0.5) -> list[tuple[int, int]]:
    """[start, end) of equally long overlapping windows that cover the snippet."""
    if n_samples <= 0 or n_bins <= 0:
        raise ValueError("samples and bins must be positive")
    if not 0 <= overlap < 0.95:
        raise ValueError("overlap must be in [0, 0.95)")
    if n_bins == 1:
        return [(0, n_samples)]
    length = min(n_samples, max(1, math.ceil(n_samples / (1 + (n_bins - 1) * (1 - overlap)))))
    room, out = n_samples - length, []
    for b in range(n_bins):
        end = min(round(room * b / (n_bins - 1)) + length, n_samples)  # round half to even
        out.append((max(0, end - length), end))
    out[0], out[-1] = (0, out[0][1]), (out[-1][0], n_samples)
    return out


def temporal_bin_names(n_bins: int, prefix: str = "mad_wta_bin") -> list[str]:
    if n_bins <= 0:
        raise ValueError("bins must be positive")
    return [f"{prefix}_{b:02d}" for b in range(n_bins)]


# --- event features -------------------------------------------------------------------------------


def trough_to_peak(w: Column) -> Column:
    """Samples from the first minimum to the first largest sample at or after it."""
    p = F.array_position(w, F.array_min(w)).cast("int")
    return _let(p, lambda q: _let(F.slice(w, q, F.size(w)), lambda rest: F.array_position(rest, F.array_max(rest)) - 1)).cast("double")


def width_below(w: Column, share: float) -> Column:
    """Number of samples at or under ``share`` of the minimum."""
    return _let(F.array_min(w) * share, lambda limit: F.size(F.filter(w, lambda x: x <= limit))).cast("double")


def biphasic_ratio(w: Column) -> Column:
    return F.abs(F.array_max(w)) / (F.abs(F.array_min(w)) + 1e-12)


def baseline_rms(w: Column, n: int = 8) -> Column:
    k = F.least(F.lit(n), F.size(w))
    return F.when(k > 0, F.sqrt(total(F.transform(F.slice(w, F.lit(1), k), lambda x: x * x)) / k))


def zero_crossings(w: Column) -> Column:
    """Sign changes between neighbours; zero counts as positive."""
    flips = F.transform(w, lambda x, i: F.when((i > 0) & ((x >= 0) != (F.get(w, i - 1) >= 0)), 1).otherwise(0))
    return F.aggregate(flips, F.lit(0), lambda s, x: s + x).cast("double")


SCALAR_FEATURES = ("peak_amplitude", "trough_amplitude", "max_slope", "min_slope", "max_abs_curvature", "abs_window_sum_peak")
# Event feature names and their order are part of the data contract.
EVENT_FEATURES = (
    "ev_trough_amplitude",
    "ev_peak_amplitude",
    "ev_trough_to_peak_time_samples",
    "ev_half_width_samples",
    "ev_full_width_samples",
    "ev_biphasic_ratio",
    "ev_signed_area",
    "ev_absolute_area",
    "ev_max_rising_slope",
    "ev_max_falling_slope",
    "ev_baseline_rms",
    "ev_zero_crossing_count",
)


def scalar_features(w: Column, d1: Column, d2: Column, window: int = 16) -> dict[str, Column]:
    values = (F.array_max(w), F.array_min(w), F.array_max(d1), F.array_min(d1), abs_max(d2), F.array_max(absolute_window_sum(w, window)))
    return dict(zip(SCALAR_FEATURES, values))


def event_features(w: Column, d1: Column, baseline: int = 8) -> dict[str, Column]:
    values = (
        F.array_min(w),
        F.array_max(w),
        trough_to_peak(w),
        width_below(w, 0.5),
        width_below(w, 0.1),
        biphasic_ratio(w),
        total(w),
        total(F.transform(w, F.abs)),
        F.when(F.array_max(d1).isNotNull(), F.greatest(_zero(), F.array_max(d1))),
        F.when(F.array_min(d1).isNotNull(), F.least(_zero(), F.array_min(d1))),
        baseline_rms(w, baseline),
        zero_crossings(w),
    )
    return dict(zip(EVENT_FEATURES, values))
