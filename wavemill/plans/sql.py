"""Common table expressions of the comparison SQL."""

from __future__ import annotations

from ..functions import kernels as k

SNIPPETS = """s AS (
  SELECT vec_id AS snippet_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w, label AS unit_id, CAST(label > 0 AS INTEGER) AS class_label
  FROM embeddings)"""

TRAINS = """e AS (
  SELECT event_id, user_id AS unit_id, ts, epoch_us(ts) / 1e6 AS t, event_type, value FROM events)"""

#: Per-sample kernels by name, over ``w``.
KERNEL = {
    "amplitude": "w",
    "first_derivative": "list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 THEN 0.0 ELSE w[i] - w[i - 1] END)",
    "second_derivative": "list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i < 3 THEN 0.0 ELSE w[i] - 2 * w[i - 1] + w[i - 2] END)",
    "absolute_window_sum": "list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(w[greatest(i - 15, 1):i], lambda x: abs(x))))",
    "short_window_energy": "list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(w[greatest(i - 15, 1):i], lambda x: x * x)))",
    "teager_energy": "list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 OR i = len(w) THEN 0.0 ELSE w[i] * w[i] - w[i - 1] * w[i + 1] END)",
}


def median(x: str) -> str:
    """Mean of the two middle values of a list expression."""
    return f"(list_sort({x})[(len({x}) + 1) // 2] + list_sort({x})[len({x}) // 2 + 1]) / 2"


def mad(x: str) -> str:
    inner = f"list_transform({x}, lambda v: abs(v - ({median(x)})))"
    return median(inner)


def wta(start: int, end: int) -> str:
    part = f"w[{start + 1}:{end}]"
    return f"list_max(list_transform({part}, lambda v: abs(v - ({median(part)}))))"


SCALARS = {
    "peak_amplitude": "list_max(w)",
    "trough_amplitude": "list_min(w)",
    "max_slope": "list_max(d1)",
    "min_slope": "list_min(d1)",
    "max_abs_curvature": "list_max(list_transform(d2, lambda x: abs(x)))",
    "abs_window_sum_peak": "list_max(aws)",
}
EVENTS = {
    "ev_trough_amplitude": "list_min(w)",
    "ev_peak_amplitude": "list_max(w)",
    "ev_trough_to_peak_time_samples": "CAST(list_position(w[p:len(w)], list_max(w[p:len(w)])) - 1 AS DOUBLE)",
    "ev_half_width_samples": "CAST(len(list_filter(w, lambda x: x <= list_min(w) * 0.5)) AS DOUBLE)",
    "ev_full_width_samples": "CAST(len(list_filter(w, lambda x: x <= list_min(w) * 0.1)) AS DOUBLE)",
    "ev_biphasic_ratio": "abs(list_max(w)) / (abs(list_min(w)) + 1e-12)",
    "ev_signed_area": "list_sum(w)",
    "ev_absolute_area": "list_sum(list_transform(w, lambda x: abs(x)))",
    "ev_max_rising_slope": "greatest(0.0, list_max(d1))",
    "ev_max_falling_slope": "least(0.0, list_min(d1))",
    "ev_baseline_rms": "sqrt(list_sum(list_transform(w[1:8], lambda x: x * x)) / least(8, len(w)))",
    "ev_zero_crossing_count": "CAST(len(list_filter(range(2, len(w) + 1), lambda i: (w[i] >= 0) <> (w[i - 1] >= 0))) AS DOUBLE)",
}
STAGED = f"""d AS (
  SELECT *, list_position(w, list_min(w)) AS p, {KERNEL['first_derivative']} AS d1, {KERNEL['second_derivative']} AS d2, {KERNEL['absolute_window_sum']} AS aws FROM s)"""


def temporal(n_bins: int = 8, n_samples: int = 64, scale: str = "1.0") -> dict[str, str]:
    bounds = k.window_bounds(n_samples, n_bins)
    return {n: f"({wta(a, b)}) / (CASE WHEN {scale} > 1e-8 THEN {scale} ELSE 1.0 END)" for n, (a, b) in zip(k.temporal_bin_names(n_bins), bounds)}


def features(*, event: bool = True, bins: int | None = 8) -> str:
    """CTEs s, d and f: f has ids, labels and features."""
    columns = dict(SCALARS) | (temporal(bins) if bins else {}) | (EVENTS if event else {})
    return f"{SNIPPETS}, {STAGED}, f AS (SELECT snippet_id, unit_id, class_label, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM d)"


def long_features(names: list[str], source: str = "f") -> str:
    """CTE l: one row per snippet and feature."""
    return "l AS (" + " UNION ALL ".join(f"SELECT snippet_id, unit_id, class_label, '{n}' AS feature, {n} AS value FROM {source}" for n in names) + ")"


def code_bank(names: list[str], bins: int = 10, fit: str = "class_label = 1") -> str:
    """CTEs q (centers), m (widths) and a (activations per snippet, feature, bin) over l."""
    levels = ", ".join(str(b / (bins - 1)) for b in range(bins))
    return f"""q AS (SELECT feature, quantile_cont(value, [{levels}]) AS c FROM l WHERE {fit} GROUP BY feature),
m AS (SELECT feature, c, list_transform(range(1, {bins} + 1), lambda i: greatest(1e-6,
   0.5 * ((c[greatest(i, 2)] - c[greatest(i, 2) - 1]) + (c[least(i + 1, {bins})] - c[least(i + 1, {bins}) - 1])) / 2)) AS s FROM q),
a AS (SELECT snippet_id, unit_id, class_label, feature,
   list_transform(range(1, {bins} + 1), lambda i: exp(-0.5 * ((value - c[i]) / (s[i] + 1e-10)) * ((value - c[i]) / (s[i] + 1e-10)))) AS act
   FROM l JOIN m USING (feature)),
sc AS (SELECT snippet_id, unit_id, class_label, sum(list_max(act)) / count(*) AS score FROM a GROUP BY ALL)"""
