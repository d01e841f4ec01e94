"""Deterministic synthetic snippets: every random number is a hash of seed, row and place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash that any engine can repeat; the same on every run and partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number by the Box-Muller transform of two hashes."""
    u, v = uniform(seed, F.lit(1), *keys), uniform(seed, F.lit(2), *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def time_axis(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double"))


def gaussian(t: Column, mu: Column, sigma: Column) -> Column:
    z = (t - mu) / sigma
    return F.exp(-0.5 * z * z)


def peak_offset(rise: Column, fall: Column) -> Column:
    return F.when(fall <= rise, F.lit(0.0)).otherwise(rise * fall / (fall - rise) * F.log(fall / rise))


def double_exponential(axis: Column, t0: Column, rise: Column, fall: Column) -> Column:
    """exp(-dt/fall) - exp(-dt/rise) after ``t0``, scaled to a largest sample of 1."""

    def pulse(t: Column) -> Column:
        dt = F.greatest(t - t0, F.lit(0.0))
        return F.when(t >= t0, F.exp(-dt / fall) - F.exp(-dt / rise)).otherwise(F.lit(0.0))

    raw = F.transform(axis, pulse)
    return F.get(F.transform(F.array(raw), lambda r: F.transform(r, lambda x: F.when(F.array_max(r) > 1e-12, x / F.array_max(r)).otherwise(x))), F.lit(0))


#: Default shape: trough, repolarisation, after-potential and pre-potential (amplitude, place, width).
SHAPE = {"pre_peak": 20, "amp_neg": -100.0, "tau_rise": 3.0, "tau_fall": 12.0, "amp_pos": 40.0, "delay_pos": 14, "width_pos": 7.0, "amp_ahp": 8.0, "delay_ahp": 28, "width_ahp": 10.0, "amp_pre": 5.0, "pre_offset": -6, "width_pre": 3.0}


def waveform(n: int = 64, **shape: Column | float) -> Column:
    """A spike shape; parameters may be columns. Humps of amplitude 0 or less are left out."""
    unknown = set(shape) - set(SHAPE)
    if unknown:
        raise ValueError(f"unknown shape parameters: {sorted(unknown)}")
    p = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in (SHAPE | shape).items()}
    axis = time_axis(n)
    trough = double_exponential(axis, p["pre_peak"] - peak_offset(p["tau_rise"], p["tau_fall"]), p["tau_rise"], p["tau_fall"])

    def sample(t: Column, k: Column) -> Column:
        hump = p["amp_neg"] * k + p["amp_pos"] * gaussian(t, p["pre_peak"] + p["delay_pos"], p["width_pos"])
        hump = hump + F.greatest(p["amp_ahp"], F.lit(0.0)) * gaussian(t, p["pre_peak"] + p["delay_ahp"], p["width_ahp"])
        return hump + F.greatest(p["amp_pre"], F.lit(0.0)) * gaussian(t, p["pre_peak"] + p["pre_offset"], p["width_pre"])

    return F.zip_with(axis, trough, sample)


def biphasic(n: int = 64, *, width_neg: float = 5.0, **shape: Column | float) -> Column:
    """``waveform`` with the defaults of the simpler two-phase form; ``width_neg`` has no effect."""
    del width_neg
    return waveform(n, **({"delay_pos": 12, "width_pos": 8.0, "amp_pre": 10.0, "pre_offset": -8, "width_pre": 4.0} | shape))


NOISE_TYPES = ("gaussian", "colored", "clipped", "irregular")


def noise(kind: str, row: Column, *, n: int = 64, amplitude: float | Column = 50.0, seed: int = 42) -> Column:
    """A noise snippet of one of the known types, from the row's key."""
    axis = time_axis(n)
    if kind == "gaussian":
        return F.transform(axis, lambda t: normal(seed, row, t) * (amplitude / 3))
    if kind == "colored":
        steps = F.transform(axis, lambda t: (normal(seed, row, t + 1) - normal(seed, row, t)) * (amplitude / 3))

        def scaled(s: Column) -> Column:
            mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n
            var = F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
            return F.transform(s, lambda x: x * amplitude / (F.sqrt(var) + 1e-12))

        return F.get(F.transform(F.array(steps), scaled), F.lit(0))
    if kind == "clipped":
        period = F.floor(8 + 12 * uniform(seed, row, F.lit(3)))
        level = amplitude * (0.3 + 0.7 * uniform(seed, row, F.lit(4)))
        return F.transform(axis, lambda t: F.signum(F.sin(2 * math.pi * t / period)) * level)
    if kind == "irregular":
        bumps = F.sequence(F.lit(1), (3 + F.floor(4 * uniform(seed, row, F.lit(5)))).cast("int"))

        def sample(t: Column) -> Column:
            def bump(s: Column, b: Column) -> Column:
                mu, sigma = n * uniform(seed, row, b, F.lit(6)), 2 + 8 * uniform(seed, row, b, F.lit(7))
                return s + amplitude * (2 * uniform(seed, row, b, F.lit(8)) - 1) * gaussian(t, mu, sigma)

            return F.aggregate(bumps, F.lit(0.0), bump)

        return F.transform(axis, sample)
    raise ValueError(f"unknown noise type {kind!r}; choose from {NOISE_TYPES}")


# Ranges (low, high) of the shape parameters of three cell types; units cycle through them.
CELL_TYPES = {
    "fast-spiking": {
        "tau_rise": (2.0, 3.5), "tau_fall": (7.0, 11.0), "amp_neg": (-150.0, -100.0), "amp_pos": (40.0, 70.0), "delay_pos": (8, 12),
        "width_pos": (5.0, 8.0), "amp_ahp": (3.0, 10.0), "delay_ahp": (20, 26), "amp_pre": (2.0, 8.0),
    },
    "regular-spiking": {
        "tau_rise": (4.0, 6.5), "tau_fall": (14.0, 22.0), "amp_neg": (-90.0, -50.0), "amp_pos": (20.0, 40.0), "delay_pos": (14, 20),
        "width_pos": (7.0, 11.0), "amp_ahp": (6.0, 16.0), "delay_ahp": (28, 36), "amp_pre": (4.0, 14.0),
    },
    "intermediate": {
        "tau_rise": (3.0, 4.5), "tau_fall": (11.0, 15.0), "amp_neg": (-120.0, -70.0), "amp_pos": (30.0, 55.0), "delay_pos": (11, 15),
        "width_pos": (6.0, 9.5), "amp_ahp": (4.0, 13.0), "delay_ahp": (24, 32), "amp_pre": (3.0, 10.0),
    },
}
#: Range of the amplitude that each noise type draws.
NOISE_AMPLITUDE = (30.0, 120.0)


def unit_parameters(unit: Column, seed: int = 42) -> dict[str, Column]:
    """Shape parameters of a unit (from 1): drawn from its cell type's ranges, whole numbers where the ranges are."""
    names, out = list(CELL_TYPES), {}
    kind = cell_type(unit)
    for parameter in CELL_TYPES[names[0]]:
        value, u = None, uniform(seed, unit, F.lit(parameter))
        for name in names:
            low, high = CELL_TYPES[name][parameter]
            draw = F.floor(low + (high + 1 - low) * u).cast("double") if isinstance(low, int) else low + (high - low) * u
            value = F.when(kind == name, draw) if value is None else value.when(kind == name, draw)
        out[parameter] = value
    return out


def cell_type(unit: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in CELL_TYPES]), (F.pmod(unit - 1, F.lit(len(CELL_TYPES))) + 1).cast("int"))


def generate(spark: SparkSession, *, n_units: int = 3, per_unit: int = 300, n_noise: int = 300, n_samples: int = 64, noise_std: tuple[float, float] = (0.0, 10.0), noise_types: tuple[str, ...] = NOISE_TYPES, seed: int = 42) -> DataFrame:
    """Spikes of all units, then noise of every type: (snippet_id, w, unit_id, class_label, source, kind, noise_std, amplitude, shape parameters).

    Each spike draws its noise level from the range ``noise_std``; each noise
    type draws one amplitude and gets max(1, n_noise // types) rows. Columns that
    do not apply are null. Rows are made where they are read; nothing is built
    on the driver.
    """
    row, unit = F.col("id"), F.col("unit_id")
    parameters = unit_parameters(unit, seed)
    level = noise_std[0] + (noise_std[1] - noise_std[0]) * uniform(seed, row, F.lit("noise_std"))
    made = spark.range(n_units * per_unit).select(row, (F.floor(row / per_unit) + 1).cast("int").alias("unit_id"), level.alias("noise_std"))
    made = made.withColumns(parameters)
    shape = waveform(n_samples, **{p: F.col(p) for p in parameters})
    noisy = F.transform(shape, lambda x, i: x + F.col("noise_std") * normal(seed, row, i))
    spikes = made.select(
        row.alias("snippet_id"), noisy.alias("w"), "unit_id", F.lit(1).alias("class_label"), F.lit("procedural_spike").alias("source"), cell_type(unit).alias("kind"),
        "noise_std", F.lit(None).cast("double").alias("amplitude"), *parameters,
    )
    each, out = max(1, n_noise // len(noise_types)), spikes
    for i, name in enumerate(noise_types):
        first = n_units * per_unit + i * each
        amplitude = NOISE_AMPLITUDE[0] + (NOISE_AMPLITUDE[1] - NOISE_AMPLITUDE[0]) * uniform(seed, F.lit(name))
        part = spark.range(first, first + each).select(
            row.alias("snippet_id"), noise(name, row, n=n_samples, amplitude=amplitude, seed=seed).alias("w"), F.lit(0).alias("unit_id"), F.lit(0).alias("class_label"),
            F.lit(f"noise_{name}").alias("source"), F.lit(name).alias("kind"), amplitude.alias("amplitude"),
        )
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def distance_grid(spark: SparkSession, distances: list[float], n_angles: int, noise_levels: list[float]) -> DataFrame:
    """Recording grid: every distance, angle (degrees, evenly spaced) and noise level."""
    d = spark.createDataFrame([(float(x),) for x in distances], "distance_um double")
    a = spark.range(n_angles).select((F.col("id") * 360.0 / n_angles).alias("angle_deg"))
    n = spark.createDataFrame([(float(x),) for x in noise_levels], "noise_uv_rms double")
    return d.crossJoin(a).crossJoin(n)


def stressed(df: DataFrame, scales: list[float], noise_levels: list[float], *, id_col: str = "snippet_id", w_col: str = "w", seed: int = 42) -> DataFrame:
    """Every snippet at every amplitude scale and noise level (fixed small lists)."""
    levels = df.sparkSession.createDataFrame([(float(s), float(n)) for s in scales for n in noise_levels], "scale double, noise double")
    changed = F.transform(w_col, lambda x, i: x * F.col("scale") + F.col("noise") * normal(seed, F.col(id_col), F.col("scale"), F.col("noise"), i))
    return df.crossJoin(F.broadcast(levels)).withColumn(w_col, changed)
