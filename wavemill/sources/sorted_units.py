"""Sorted-unit input: field probing, length alignment, unit filters and the curation sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import numbered

# Field names under which sorters store the same content, by preference.
FIELD_NAMES = {
    "spike_times": ("newSpikeTimes", "spikeTimes", "times", "timestamps", "spike_times", "ts"),
    "waveforms": ("waveforms", "waves", "snippets", "spikeWaveforms", "Waveforms", "Waves", "snips"),
    "unit_ids": ("unitIDs", "unit_ids", "unitIds", "clusterIDs", "cluster_ids", "labels", "assigns"),
    "noise": ("noiseWaveforms", "noiseSnippets", "noise_waveforms", "rejected", "noise"),
}
# Field names of the raw sorter output, which the curated loader reads.
RAW_FIELD_NAMES = {"spike_times": ("newTimestampsNegative",), "waveforms": ("newSpikesNegative",), "unit_ids": ("assignedNegative",)}
SENTINEL_CLUSTER = 99999999


def probe(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The first column with one of the names: as written, then ignoring case."""
    for n in names:
        if n in df.columns:
            return n
    lower = {c.lower(): c for c in df.columns}
    return next((lower[n.lower()] for n in names if n.lower() in lower), None)


def load_units(df: DataFrame, *, lowest: int = 1, highest: int = 999, raw: bool = False) -> DataFrame:
    """Canonical (file, spike_index, t, w, unit_id, class_label) from a table of sorter fields.

    Rows with any of the fields missing are cut, as a sorter's arrays are cut to
    their common length. Units outside the range are noise (unit 0); without
    unit ids all rows are. With a field of noise snippets, its rows are the
    noise, without times, and rows outside the range are left out; else rows of
    id 0 are the noise. ``raw`` takes the names of the raw output.
    """
    names = FIELD_NAMES | (RAW_FIELD_NAMES if raw else {})
    found = {k: probe(df, v) for k, v in names.items()}
    missing = [k for k in ("spike_times", "waveforms") if found[k] is None]
    if missing:
        raise ValueError(f"no column for {missing}; the table has {df.columns[:30]}")
    given = F.coalesce(F.col(found["unit_ids"]).cast("int"), F.lit(0)) if found["unit_ids"] else F.lit(0)
    unit = F.when(given.between(lowest, highest), given).otherwise(F.lit(0))
    own = df.select("file", "spike_index", F.col(found["spike_times"]).cast("double").alias("t"), F.col(found["waveforms"]).cast("array<double>").alias("w"), unit.alias("unit_id"), given.alias("given"))
    rows = own.where("t is not null and w is not null")
    if found["noise"]:
        rejected = df.select("file", "spike_index", F.lit(None).cast("double").alias("t"), F.col(found["noise"]).cast("array<double>").alias("w"), F.lit(0).alias("unit_id")).where("w is not null")
        rows = rows.where("unit_id > 0").drop("given").unionByName(rejected)
    else:
        rows = rows.where("unit_id > 0 or given = 0").drop("given")
    return rows.withColumn("class_label", (F.col("unit_id") > 0).cast("int"))


def unit_means(units: DataFrame) -> DataFrame:
    """(file, unit_id, n_spikes, mean_waveform) of the units of ``load_units``; sample means are aggregated partially."""
    rows = units.where("unit_id > 0").select("file", "unit_id", F.posexplode("w").alias("pos", "x"))
    per = rows.groupBy("file", "unit_id", "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("file", "unit_id").agg(F.max("n").alias("n_spikes"), F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("x"))  # one entry per sample
    return whole.select("file", "unit_id", "n_spikes", F.transform("x", lambda s: s["m"]).alias("mean_waveform"))


def align_by_position(left: DataFrame, right: DataFrame, *, by: str, order: str) -> DataFrame:
    """Rows of two tables joined by their position within ``by``; the longer side is cut.

    Both tables must carry the order column. Positions are numbered within each
    group, never over the whole table.
    """
    n, key = "__n", "__by"
    a, b = numbered(left, n, by=[by], order=[order]), numbered(right, n, by=[by], order=[order]).drop(order).withColumnRenamed(by, key)
    return a.join(b, (a[by] == b[key]) & (a[n] == b[n])).drop(b[n]).drop(n, key)


def cluster_label(cluster: Column, accepted: list[int], excluded: list[int]) -> Column:
    """SU, EXCL, NOISE (the sentinel) or OTHER."""
    return F.when(cluster.isin(accepted), "SU").when(cluster.isin(excluded), "EXCL").when(cluster == SENTINEL_CLUSTER, "NOISE").otherwise("OTHER")


def curation_sheet(df: DataFrame) -> DataFrame:
    """Typed rows of a sheet read as text: channel, quality_code, n_sua, cluster_ids.

    Rows whose channel is not a number are headers and left out; numbers that
    cannot be read become 0; of ids joined by a plus sign the first is kept.
    """
    def number(c: str) -> Column:
        return F.coalesce(F.expr(f"try_cast(trim({c}) AS int)"), F.lit(0))

    parts = F.transform(F.split(F.coalesce("cluster_ids_raw", F.lit("")), ","), lambda s: F.regexp_extract(F.trim(s), "^([0-9]+)", 1))
    ids = F.transform(F.filter(parts, lambda s: s != ""), lambda s: s.cast("int"))
    return df.where(F.trim("channel").rlike("^[0-9]+$")).select(
        F.trim("channel").cast("int").alias("channel"), number("quality_code").alias("quality_code"), number("n_sua").alias("n_sua"), ids.alias("cluster_ids")
    )


def positive_onsets(df: DataFrame, *, value_col: str = "value") -> DataFrame:
    return df.where(F.col(value_col) > 0)


def explode_trains(units: DataFrame, *, times_col: str = "spike_times", keep: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """One row (keys, t) per event of units that hold their times in an array; units without events give none."""
    return units.select(*keep, F.explode(times_col).alias("t"))


def without_columns(df: DataFrame, excluded: list[str]) -> DataFrame:
    """``df`` without the listed columns; names it lacks are ignored."""
    return df.drop(*excluded)
