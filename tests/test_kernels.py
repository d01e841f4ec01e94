"""Analytic identities of kernels and reducers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import kernels as k
from wavemill.operators.features import FEATURE_SETS, FeatureConfig, TemporalConfig, build_features, families, feature_names, resolve_names, temporal_features, to_long


def arrays(spark, *rows):
    return spark.createDataFrame([(i, list(map(float, r)) if r is not None else None) for i, r in enumerate(rows)], "snippet_id long, w array<double>")


def one(spark, row, column):
    return arrays(spark, row).select(column.alias("v")).first()["v"]


W = "w"
RAMP, ONES = list(range(64)), [1.0] * 64


def test_derivatives_of_a_ramp(spark):
    assert one(spark, RAMP, k.first_derivative(W)) == [0.0] + [1.0] * 63
    assert one(spark, RAMP, k.second_derivative(W)) == [0.0] * 64


def test_window_sums_warm_up(spark):
    s = one(spark, ONES, k.absolute_window_sum(W, 8))
    assert s[:8] == [1, 2, 3, 4, 5, 6, 7, 8] and s[8:] == [8.0] * 56
    assert one(spark, [1, 2, 3, 0, 0, 0, 0, 0], k.short_window_energy(W, 4))[3] == 14


def test_teager_is_zero_at_the_ends(spark):
    v = one(spark, [3, 1, 4, 1, 5], k.teager_energy(W))
    assert v == [0.0, 1 - 12, 16 - 1, 1 - 20, 0.0]


def test_zero_crossings_of_a_float32_sine(spark):
    x = np.sin(np.linspace(0, 4 * np.pi, 100, dtype=np.float32))
    assert one(spark, x.tolist(), k.zero_crossings(W)) == 4


def test_median_and_mad(spark):
    assert one(spark, [5, 1, 3, 2], k.median(W)) == 2.5
    assert one(spark, [1, 1, 2, 2, 4, 6, 9], k.mad(W)) == 1


def test_widths(spark):
    assert one(spark, [0.0] * 64, k.width_below(W, 0.5)) == 64
    assert one(spark, ONES, k.width_below(W, 0.5)) == 0
    assert one(spark, [0, -10, -6, -2, 0], k.width_below(W, 0.5)) == 2


def test_trough_to_peak_uses_the_later_maximum(spark):
    assert one(spark, [9, 0, -5, 1, 3, 3, 0], k.trough_to_peak(W)) == 2


@pytest.mark.parametrize("row", [None, [], [1], [1, 2], [1, 2, 3], [0.0] * 8, [2.0] * 8])
def test_short_and_empty_rows_do_not_fail(spark, row):
    df = arrays(spark, row)
    assert df.select(*[f(F.col(W), 16).alias(n) for n, f in k.KERNELS.items()]).count() == 1
    d1 = k.first_derivative(W)
    out = df.select(*[c.alias(n) for n, c in (k.scalar_features(W, d1, k.second_derivative(W)) | k.event_features(W, d1)).items()]).first()
    assert (out["peak_amplitude"] is None) == (not row)


def test_null_elements_give_nulls_not_errors(spark):
    df = spark.createDataFrame([(0, [1.0, None, 3.0])], "snippet_id long, w array<double>")
    assert df.select(k.first_derivative(W).alias("d")).first()["d"] == [0.0, None, None]


def test_bounds_of_windows():
    starts = {3: [0, 16, 32], 5: [0, 10, 21, 32, 42], 8: [0, 7, 14, 21, 28, 35, 42, 49], 12: [0, 5, 10, 15, 20, 25, 29, 34, 39, 44, 49, 54]}
    for bins, want in starts.items():
        b = k.window_bounds(64, bins)
        assert [s for s, _ in b] == want and b[-1][1] == 64 and len({e - s for s, e in b}) == 1
    for bad in ((0, 3, 0.5), (64, 0, 0.5), (64, 3, 0.95)):
        with pytest.raises(ValueError):
            k.window_bounds(*bad)


def test_noise_modes(spark):
    df = arrays(spark, [0, 0, 0, 8, 8, 0, 0, 0])
    raw, _ = temporal_features(W, 8, TemporalConfig(n_bins=3))
    scaled, meta = temporal_features(W, 8, TemporalConfig(n_bins=3, noise_mode="global", global_noise_mad=2.0, scale_factor=1.0))
    a, b = df.select(*[c.alias(n) for n, c in raw.items()]).first(), df.select(*[c.alias(n) for n, c in scaled.items()]).first()
    assert [x / 2 for x in a] == list(b) and meta["noise_mode"] == "global"
    flat, _ = temporal_features(W, 8, TemporalConfig(n_bins=3, noise_mode="snippet_edges"))
    assert arrays(spark, [0.0] * 8).select(*[c.alias(n) for n, c in flat.items()]).first()[0] == 0
    with pytest.raises(ValueError):
        temporal_features(W, 8, TemporalConfig(noise_mode="other"))
    with pytest.raises(ValueError):
        temporal_features(W, 8, TemporalConfig(noise_mode="global"))


def test_scaling_and_negation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=64)
    df = arrays(spark, x, 3 * x, -x)
    rows = {r["snippet_id"]: r for r in build_features(df, tier=3).collect()}
    for n in ("peak_amplitude", "max_slope", "abs_window_sum_peak", "ev_absolute_area", "mad_wta_bin_03"):
        assert rows[1][n] == pytest.approx(3 * rows[0][n])
    for n in ("ev_half_width_samples", "ev_trough_to_peak_time_samples", "ev_zero_crossing_count"):
        assert rows[1][n] == rows[0][n]
    assert rows[2]["peak_amplitude"] == -rows[0]["trough_amplitude"]


def test_matrix_columns_and_pruning(spark):
    df = arrays(spark, RAMP)
    assert build_features(df, tier=3).columns == ["snippet_id", *feature_names(tier=3)]
    assert build_features(df, tier=1).columns == build_features(df, tier=2).columns
    with pytest.raises(ValueError):
        build_features(df, tier=9)
    assert to_long(build_features(df), feature_names(), id_cols=["snippet_id"]).count() == 14
    off = FeatureConfig(temporal=TemporalConfig(enabled=False))
    assert len(feature_names(off)) == 6


def test_name_resolution():
    names = feature_names(tier=3)
    assert resolve_names(names, ["half_width_samples", "ev_half_width_samples", "nothing", "mad_wta_bin_*"]) == ["ev_half_width_samples", *k.temporal_bin_names(8)]
    assert resolve_names(names, ["baseline_*"]) == ["ev_baseline_rms"]
    assert resolve_names(names, [" peak* ", ""]) == ["peak_amplitude", "ev_peak_amplitude"]
    assert [len(resolve_names(names, FEATURE_SETS[s])) for s in FEATURE_SETS] == [5, 6, 8, 7, 13, 21]
    f = families(names)
    assert list(f) == ["scalar", "temporal_mad", "event", "full"] and len(f["full"]) == 26
    assert "event" not in families(feature_names(tier=1))


def test_sine_of_pi():
    assert math.isclose(sum(b - a for a, b in k.window_bounds(64, 1)), 64)


def test_blocks_equal_expressions(spark):
    """Both engines give the same features and series, for odd, empty and null snippets too."""
    from wavemill.functions import blocks

    rows = [(0, [1.0, -2.0, 3.0, 0.0] * 16), (1, None), (2, []), (3, [0.0] * 64), (4, [float(i % 7) - 3 for i in range(50)]), (5, [-1.0, 2.0, 0.5]), (6, [0.5])]
    df = spark.createDataFrame(rows, "snippet_id long, w array<double>")
    for mode, options in (("none", {}), ("global", {"global_noise_mad": 0.05}), ("snippet_edges", {})):
        config = FeatureConfig(temporal=TemporalConfig(noise_mode=mode, **options))
        a, b = (build_features(df, config, tier=3, engine=e).orderBy("snippet_id").collect() for e in ("blocks", "expressions"))
        for x, y in zip(a, b):
            for name, value in x.asDict().items():
                assert (value is None and y[name] is None) or value == pytest.approx(y[name], abs=1e-9), (mode, x["snippet_id"], name)
    for name in blocks.KERNELS:
        for r in df.select(blocks.kernel(name, F.col("w"), 16).alias("a"), k.KERNELS[name](F.col("w"), 16).alias("b")).collect():
            assert r["a"] == (None if r["b"] is None else pytest.approx(r["b"], abs=1e-9))
