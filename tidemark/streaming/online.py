"""Streaming rollup, scoring, live thresholds and stateful SPOT."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.anomaly import Spot, zscore_predict
from tidemark.operators.joins import residual_join
from tidemark.schema import KPI_LONG, SERIES


def read_stream(spark: SparkSession, path: str, schema: T.StructType = KPI_LONG) -> DataFrame:
    """Files arriving under ``path``, oldest first, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into Parquet; the checkpoint makes it restartable."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_hourly_kpi(events: DataFrame, dim: str, delay: str = "10 minutes") -> DataFrame:
    """Hourly sum, mean and count per dimension value; an hour is emitted once it is closed
    by the watermark, later rows for it are dropped."""
    return (
        events.withColumn("_t", F.col("ts").cast("timestamp"))
        .withWatermark("_t", delay)
        .groupBy(F.window("_t", "1 hour").alias("_w"), F.col(dim).alias("dim_key"))
        .agg(
            F.sum("value").alias("value_sum"),
            F.avg("value").alias("value_wmean"),
            F.count(F.lit(1)).cast("double").alias("value_sample"),
        )
        .select(
            "dim_key", F.col("_w.start").cast("timestamp_ntz").alias("ts"),
            "value_sum", "value_wmean", "value_sample",
        )
    )


def stream_score_ad(
    stream: DataFrame,
    forecast: DataFrame,
    zparams: DataFrame,
    threshold: Column | float = 3.0,
    keys: list[str] = SERIES,
) -> DataFrame:
    """Join a KPI stream with the static forecast and z parameters; keep the anomalies."""
    residual = residual_join(stream, forecast, [*keys, "ts"], y="value")
    scored = zscore_predict(residual, zparams, keys, threshold=threshold)
    return scored.filter("is_anomaly")


def score_with_live_threshold(
    stream: DataFrame,
    forecast: DataFrame,
    zparams: DataFrame,
    thresholds: Callable[[SparkSession], DataFrame],
    out: str,
    checkpoint: str,
    keys: list[str] = SERIES,
) -> None:
    """Score micro-batches with the threshold that holds when the batch starts.

    ``thresholds`` re-reads the small control table (kpi, threshold) for every batch, so a
    change applies from the next batch on. Batches are written under their id; a replayed
    batch overwrites its own output, which keeps the sink exactly-once.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        live = thresholds(batch.sparkSession)
        residual = residual_join(batch, forecast, [*keys, "ts"], y="value").join(live, "kpi")
        scored = zscore_predict(residual, zparams, keys, threshold=F.col("threshold"))
        scored.filter("is_anomaly").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SpotProcessor(StatefulProcessor):
    """SPOT of one series: a value state (t, n, z) and two lists, the calibration values and the
    peaks. A micro-batch appends the new entries of a list and reads the peaks only if one is added;
    a series whose last row lies ``idle_hours`` behind the watermark loses its state."""

    def __init__(self, keys: list[str], n_init: int, q: float, level: float, with_alarm: bool, idle_hours: float | None):
        self.keys, self.n_init, self.q = keys, n_init, q
        self.level, self.with_alarm, self.idle_hours = level, with_alarm, idle_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.limits = handle.getValueState("limits", "t double, n long, z double")
        self.peaks = handle.getListState("peaks", "peak double")
        self.first = handle.getListState("first", "value double")
        self.waiting = handle.getValueState("waiting", "n long")

    def _spot(self) -> Spot | None:
        if not self.limits.exists():
            return None
        spot = Spot.__new__(Spot)
        spot.t, spot.n, spot.z = self.limits.get()
        spot.q, spot.with_alarm, spot.peaks = self.q, self.with_alarm, None
        return spot

    def _calibrated(self, fresh: list[float]) -> Spot | None:
        """The calibration of the waiting and the given values, once they are enough."""
        held = self.waiting.get()[0] if self.waiting.exists() else 0
        if held + len(fresh) < self.n_init:
            if fresh:
                self.first.appendList([(x,) for x in fresh])
                self.waiting.update((held + len(fresh),))
            return None
        values = [x for (x,) in self.first.get()] if held else []
        self.first.clear()
        self.waiting.clear()
        spot = Spot.calibrate(np.asarray([*values, *fresh]), self.q, self.level, self.with_alarm)
        if spot.peaks:
            self.peaks.appendList([(float(p),) for p in spot.peaks])
        return spot

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("ts")
        times, values = batch["ts"].tolist(), [float(x) for x in batch["value"]]
        spot, at = self._spot(), 0
        if spot is None:
            held = self.waiting.get()[0] if self.waiting.exists() else 0
            at = min(len(values), self.n_init - held)
            spot = self._calibrated(values[:at])
        done, fresh = [], []
        for ts, x in zip(times[at:], values[at:], strict=True):
            if spot.peaks is None and x > spot.t and not (x > spot.z and self.with_alarm):
                spot.peaks = [p for (p,) in self.peaks.get()]
            known = len(spot.peaks or ())
            done.append((ts, x, *spot.step(x)))
            fresh += (spot.peaks or ())[known:]
        if spot is not None:
            self.limits.update((float(spot.t), int(spot.n), float(spot.z)))
        if fresh:
            self.peaks.appendList([(float(p),) for p in fresh])
        if self.idle_hours is not None:
            ends = int(batch["ts"].max().timestamp() * 1000 + self.idle_hours * 3_600_000)
            known = list(self.handle.listTimers())
            for old in known:
                if old < ends:
                    self.handle.deleteTimer(old)
            if ends > max(known, default=0):
                self.handle.registerTimer(ends)
        out = pd.DataFrame(done, columns=["ts", "value", "threshold", "alarm"])
        for name, part in zip(reversed(self.keys), reversed(key), strict=True):
            out.insert(0, name, part)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.limits, self.peaks, self.first, self.waiting):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_spot(
    stream: DataFrame,
    n_init: int = 168,
    q: float = 1e-4,
    level: float = 0.98,
    with_alarm: bool = True,
    keys: list[str] = SERIES,
    idle_hours: float | None = None,
    delay: str = "1 day",
) -> DataFrame:
    """SPOT with keyed state: one threshold and alarm per row after the ``n_init`` calibration rows.

    Rows of a series are taken in time order inside a micro-batch; batches are expected in time
    order. State grows by the peaks, a small tail of the rows, and is kept in RocksDB, which this
    sets as the session's state store. ``idle_hours``: a series without rows for so long, as the
    watermark (``delay`` behind the latest row) sees it, loses its state and calibrates anew when it
    returns; rows behind the watermark are dropped. None: state is kept for good, no row is late.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = ", ".join(
        [f"{k} string" for k in keys]
        + ["ts timestamp_ntz, value double, threshold double, alarm boolean"]
    )
    rows = stream.filter(F.col("value").isNotNull()).select(*keys, "ts", "value")
    if idle_hours is not None:
        rows = rows.withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", delay)
    processor = SpotProcessor(list(keys), n_init, q, level, with_alarm, idle_hours)
    return rows.groupBy(*keys).transformWithStateInPandas(
        processor, schema, "append", "none" if idle_hours is None else "eventTime"
    )
