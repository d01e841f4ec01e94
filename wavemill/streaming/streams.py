"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import codebank
from ..operators.features import FeatureConfig, build_features


def read_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def score_stream(stream: DataFrame, bank: codebank.CodeBank, config: FeatureConfig = FeatureConfig(), *, tier: int = 2) -> DataFrame:
    """Features, score and gate of arriving snippets: the batch projection, no state."""
    return codebank.apply(build_features(stream, config, tier=tier), bank)


def rates(events: DataFrame, *, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", ts_col: str = "ts", unit_col: str = "unit_id") -> DataFrame:
    """Events per unit and tumbling or sliding window; in a stream, rows older than the watermark are dropped."""
    return (
        events.withWatermark(ts_col, late)
        .groupBy(F.window(ts_col, length, slide) if slide else F.window(ts_col, length), unit_col)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(unit_col, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")
    )


def sessions(events: DataFrame, *, gap: str = "5 minutes", late: str = "10 minutes", ts_col: str = "ts", unit_col: str = "unit_id") -> DataFrame:
    """Bursts: events of a unit grouped until a gap of inactivity."""
    return (
        events.withWatermark(ts_col, late)
        .groupBy(F.session_window(ts_col, gap), unit_col)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(unit_col, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def deduplicated(events: DataFrame, keys: list[str], *, late: str = "10 minutes", ts_col: str = "ts") -> DataFrame:
    """The first row of every key among those within the watermark of each other."""
    if events.isStreaming:
        return events.withWatermark(ts_col, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


DETECTED = "channel string, trough_index long, snippet array<double>"


class Detector:
    """Threshold crossings of a sampled signal with refractory time and snippet cutting.

    State between calls: the squares of the last ``window`` samples, the samples
    that a pending or future snippet needs, and the last accepted crossing.
    """

    def __init__(self, window: int = 512, multiplier: float = 4.5, before: int = 20, after: int = 44, refractory: int = 30) -> None:
        self.window, self.multiplier, self.before, self.after, self.refractory = window, multiplier, before, after, refractory

    def step(self, state: tuple, index: np.ndarray, value: np.ndarray) -> tuple[tuple, list[tuple[int, list[float]]]]:
        """(new state, found snippets) for the next samples in order. State: (indexes, values, last, pending).

        Samples that are not newer than the newest seen are late and dropped:
        what was decided with them missing stays.
        """
        old_i, old_v, last, pending = state
        if len(old_i):
            fresh = index > old_i[-1]
            index, value = index[fresh], value[fresh]
        if not len(index):
            return state, []
        i, v = np.concatenate([np.array(old_i, np.int64), index]), np.concatenate([np.array(old_v, float), value])
        cum = np.concatenate([[0.0], np.cumsum(v * v)])
        at = np.arange(len(old_i), len(i))
        begin = np.maximum(0, at - self.window + 1)
        rms = np.sqrt((cum[at + 1] - cum[begin]) / (at + 1 - begin))
        pending = list(pending)
        for k in at[v[at] < -self.multiplier * rms].tolist():  # crossings only
            if i[k] - last >= self.refractory:
                last = int(i[k])
                pending.append(last)
        found, waiting = [], []
        for p in pending:
            if i[-1] - p < self.after - 1 + self.before:
                waiting.append(p)
                continue
            near = np.flatnonzero((i >= p) & (i < p + self.before))
            trough = int(near[np.argmin(v[near])])
            if trough - self.before >= 0 and trough + self.after <= len(i):
                found.append((int(i[trough]), v[trough - self.before : trough + self.after].tolist()))
        keep = max(self.window, self.before + self.after + 2 * self.before)
        return (i[-keep:].tolist(), v[-keep:].tolist(), last, waiting), found


class _Reordering(StatefulProcessor):
    """Holds a channel's samples until the watermark passes them, then feeds them to the detector in sample order.

    List state has the samples that wait, value state the detector's own. A
    timer stands at the newest sample of every batch. A row without a sample
    index marks the end of its channel: all that waits is taken at once.
    """

    def __init__(self, detector: Detector) -> None:
        self.detector = detector

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "sample_index bigint, value double, at bigint")
        self.state = handle.getValueState("state", "i array<bigint>, v array<double>, last bigint, pending array<bigint>")

    def _taken(self, key: tuple, until: int | None, new: list[tuple] = ()) -> pd.DataFrame:  # type: ignore[assignment]
        """Snippets found in what is no newer than ``until`` (all without it); the rest waits on."""
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rows += new
        ready = sorted({r for r in rows if until is None or r[2] <= until})
        rest = [r for r in rows if until is not None and r[2] > until]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        held = self.state.get() if self.state.exists() else ([], [], -(1 << 60), [])
        held, found = self.detector.step((list(held[0]), list(held[1]), held[2], list(held[3])), np.array([r[0] for r in ready], np.int64), np.array([r[1] for r in ready], float))
        self.state.update((list(held[0]), list(held[1]), held[2], list(held[3])))
        return pd.DataFrame([(key[0], i, s) for i, s in found], columns=["channel", "trough_index", "snippet"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        new, ended = [], False
        for pdf in rows:
            ended |= bool(pdf["sample_index"].isna().any())
            own = pdf[pdf["sample_index"].notna()]
            at = own["ts"].to_numpy("datetime64[ms]").astype(np.int64)
            new += list(zip(own["sample_index"].astype(np.int64).tolist(), own["value"].astype(float).tolist(), at.tolist()))
        if ended:
            yield self._taken(key, None, new)
        else:
            if new:
                self.waiting.appendList(new)
                self.handle.registerTimer(max(r[2] for r in new))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._taken(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def detect(signal: DataFrame, detector: Detector = Detector(), *, late: str = "10 seconds") -> DataFrame:
    """Snippets around threshold crossings of a stream (channel, sample_index, value, ts), per channel.

    Samples may come in any order within ``late`` of the newest one: each waits
    until the watermark has passed it. Rows with a null sample_index end their
    channel. The state store must be the RocksDB one (``state_store``).
    """
    return signal.withWatermark("ts", late).groupBy("channel").transformWithStateInPandas(_Reordering(detector), DETECTED, "Append", "EventTime")


def state_store(spark: SparkSession) -> None:
    """Use the state store that stateful processors need in this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_table(stream: DataFrame, name: str, *, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Process everything available into a memory table and return it (tests, small results)."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append-mode file sink with exactly-once commits; restarts go on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
