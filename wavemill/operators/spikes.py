"""Event trains: intervals, rates, refractory checks, bursts and detection thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.scratch import exact_quantiles, fresh, materialize, numbered, running_sums


def intervals(trains: DataFrame, *, unit_col: str = "unit_id", t_col: str = "t", tie_col: str = "event_id", block_s: float = 3600.0) -> DataFrame:
    """``trains`` with the seconds since the unit's previous event (null for the first).

    A unit is cut into blocks of ``block_s`` seconds, each a window of its own;
    a block's first event meets the last one of the block before, which a small
    table holds. A busy unit is thus spread over many tasks.
    """
    block, last, key = fresh("block", trains), fresh("last", trains), fresh("key", trains)
    rows = trains.withColumn(block, F.floor(F.col(t_col) / block_s))
    ends = rows.groupBy(unit_col, block).agg(F.max(t_col).alias(last))
    # a row per unit and block
    before = ends.select(F.col(unit_col).alias(key), F.col(block).alias(f"{block}_"), F.lag(last).over(W.partitionBy(unit_col).orderBy(block)).alias(last))
    w = W.partitionBy(unit_col, block).orderBy(t_col, tie_col)
    inside = rows.withColumn("isi", F.col(t_col) - F.lag(t_col).over(w))
    met = inside.join(before, F.col(unit_col).eqNullSafe(F.col(key)) & F.col(block).eqNullSafe(F.col(f"{block}_")), "left")
    first = F.row_number().over(w) == 1
    return met.withColumn("isi", F.when(first, F.col(t_col) - F.col(last)).otherwise(F.col("isi"))).select(*trains.columns, "isi")


def train_summary(trains: DataFrame, *, unit_col: str = "unit_id", t_col: str = "t") -> DataFrame:
    """Per unit: count, duration, mean rate, median interval (ms) and variation of the intervals.

    A unit with one event has duration 0 and statistics 0. The median is exact
    by ranks, so that a busy unit fills no buffer.
    """
    i = materialize(intervals(trains, unit_col=unit_col, t_col=t_col).select(unit_col, t_col, "isi"))
    duration = F.max(t_col) - F.min(t_col)
    stats = i.groupBy(unit_col).agg(
        F.count(F.lit(1)).alias("n_spikes"),
        duration.alias("duration_s"),
        F.when(duration > 0, F.count(F.lit(1)) / duration).otherwise(0.0).alias("mean_fr_hz"),
        F.when((F.count("isi") > 1) & (F.avg("isi") > 0), F.stddev_pop("isi") / F.avg("isi")).otherwise(0.0).alias("cv_isi"),
    )
    middle = exact_quantiles(i.withColumn("ms", F.col("isi") * 1000), [0.5], by=[unit_col], value="ms").select(F.col(unit_col).alias("__u"), F.get("quantiles", F.lit(0)).alias("m"))
    out = stats.join(middle, F.col(unit_col).eqNullSafe(F.col("__u")), "left")
    return out.select(unit_col, "n_spikes", "duration_s", "mean_fr_hz", F.coalesce("m", F.lit(0.0)).alias("median_isi_ms"), "cv_isi")


def train_checks(trains: DataFrame, *, refractory_s: float = 0.001, gap_s: float = 60.0, unit_col: str = "unit_id") -> DataFrame:
    """Per unit: share of intervals under the refractory time, repeated times, and gaps."""
    i = intervals(trains, unit_col=unit_col)
    return i.groupBy(unit_col).agg(
        F.coalesce(F.avg((F.col("isi") < refractory_s).cast("double")), F.lit(0.0)).alias("refractory_share"),
        F.count(F.when(F.col("isi") == 0, 1)).alias("n_duplicates"),
        F.count(F.when(F.col("isi") > gap_s, 1)).alias("n_gaps"),
    )


def bursts(trains: DataFrame, gap_s: float, *, unit_col: str = "unit_id", t_col: str = "t") -> DataFrame:
    """Runs of events with gaps under ``gap_s``: (unit, burst, n, start, end)."""
    i = intervals(trains, unit_col=unit_col, t_col=t_col)
    starts = F.when(F.col("isi").isNull() | (F.col("isi") >= gap_s), 1).otherwise(0).cast("long")
    marked = running_sums(i.select(unit_col, t_col, "event_id", "isi"), {"burst": starts}, by=[unit_col], order=[t_col, "event_id"])
    return marked.groupBy(unit_col, "burst").agg(F.count(F.lit(1)).alias("n"), F.min(t_col).alias("start_t"), F.max(t_col).alias("end_t"))


def rolling_threshold(signal: DataFrame, *, channel_col: str, order_col: str, value_col: str, window: int = 512, multiplier: float = 4.5, block_rows: int | None = None) -> DataFrame:
    """``signal`` with the rolling RMS of the last ``window`` samples and a flag for values under minus the threshold.

    Samples are numbered in their channel's order by range partitions and cut
    into blocks; each block also gets the last ``window`` - 1 samples of the block
    before, so a channel is spread over as many tasks as it has blocks.
    """
    size = max(block_rows or 65_536, window)
    place, block, home = (fresh(n, signal) for n in ("place", "block", "home"))
    rows = numbered(signal, place, by=[channel_col], order=[order_col]).withColumn(block, F.floor((F.col(place) - 1) / size))
    tail = (F.col(place) - 1) % size > size - window
    spread = rows.withColumn(home, F.explode(F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn(block, F.col(block) + F.col(home))
    w = W.partitionBy(channel_col, block).orderBy(place).rowsBetween(-(window - 1), 0)
    rms = spread.withColumn("rms", F.sqrt(F.avg(F.col(value_col) * F.col(value_col)).over(w)))
    return rms.where(F.col(home) == 0).drop(place, block, home).withColumn("crossing", F.col(value_col) < -multiplier * F.col("rms"))


def peri_event(trains: DataFrame, onsets: DataFrame, before_s: float, after_s: float, *, unit_col: str = "unit_id", bucket_s: float | None = None) -> DataFrame:
    """Events within a window around onsets of the same unit: an interval join on time buckets.

    Times are cut into buckets as long as the window, so an onset meets two or
    three buckets by an equality join instead of every event of the unit.
    """
    size = bucket_s or max(before_s + after_s, 1e-9)
    left = trains.withColumn("__b", F.floor(F.col("t") / size))
    first, last = F.floor((F.col("onset_t") - before_s) / size), F.floor((F.col("onset_t") + after_s) / size)
    right = onsets.withColumn("__b", F.explode(F.sequence(first, last)))
    lag = F.col("t") - F.col("onset_t")
    return left.join(right, [unit_col, "__b"]).where((lag >= -before_s) & (lag <= after_s)).drop("__b").withColumn("lag_s", lag)
