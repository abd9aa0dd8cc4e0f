"""Streams: ingestion to bronze, deduplication, scoring with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import EARTH_KM
from ..functions.risk import FIXED_INTERCEPT, FIXED_WEIGHTS, probability
from ..sources.kafka import messages


def deduplicated(stream: DataFrame, keys: list[str], event_time: str = "timestamp", delay: str = "10 minutes", latest: str | None = None) -> DataFrame:
    """One row per key (which includes the event time); state leaves with the watermark. `latest` is an SQL
    expression: rows beyond it are held out, so that one wrong clock doesn't push the watermark past all others."""
    if latest is not None:
        stream = stream.where(f"`{event_time}` <= {latest}")
    return stream.withWatermark(event_time, delay).dropDuplicates(keys)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, by: list[str] | None = None, every: str | None = "10 seconds") -> DataStreamWriter:
    """Exactly-once file sink. every=None takes what is there and ends."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if by:
        w = w.partitionBy(*by)
    return w.trigger(processingTime=every) if every else w.trigger(availableNow=True)


def to_console(stream: DataFrame) -> DataStreamWriter:
    return stream.writeStream.format("console").option("truncate", False).outputMode("append")


STATE = "last_s bigint, lat double, lon double, v1 double, v2 double, seen bigint"
MOTION = "icao24 string, evt_ts bigint, latitude double, longitude double, delta_t bigint, movement_score double"


def _haversine(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(h)))


def _motion(policy: str, smooth: bool, emit_first: bool) -> Callable:
    """The keyed state function. Rows of a batch are taken in order of time; policy `event_time` leaves out rows that
    aren't later than the last one seen, `arrival` takes them with no time passed and lets the state go back."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        if policy == "event_time":
            rows = rows.sort_values(["evt_ts", "tie"], kind="stable")
        last, lat, lon, v1, v2, seen = state.get if state.exists else (None, None, None, 0.0, 0.0, 0)
        out = []
        for t, a, o in rows[["evt_ts", "latitude", "longitude"]].itertuples(index=False):
            t, there = int(t), not (pd.isna(a) or pd.isna(o))
            if last is not None and policy == "event_time" and t <= last:
                continue
            delta = None if last is None else max(0, t - last)
            v = 0.0
            if delta and there and lat is not None and not pd.isna(lat):
                v = float(_haversine(lat, lon, a, o)) / max(1, delta)
            n = min(seen, 2)
            score = (v + (v1 if n >= 1 else 0.0) + (v2 if n >= 2 else 0.0)) / (n + 1) if smooth else v
            if delta is not None or emit_first:
                out.append((key[0], t, a, o, delta or 0, score))
            last, v1, v2, seen = t, v, v1, seen + 1
            if there:
                lat, lon = float(a), float(o)
        state.update((last, lat, lon, v1, v2, seen))
        if out:
            yield pd.DataFrame(out, columns=["icao24", "evt_ts", "latitude", "longitude", "delta_t", "movement_score"])

    return step


def moving(stream: DataFrame, policy: str = "event_time", smooth: bool = True, emit_first: bool = False) -> DataFrame:
    """Motion features of a stream (icao24, evt_ts, latitude, longitude, tie): the state of a key is its last position
    and its last two speeds, in Spark's state store, so it lives and fails with the checkpoint. Equal to the batch
    features for input that is in order across batches. Rows with null coordinates should be cleaned away before."""
    rows = stream.where("icao24 IS NOT NULL AND icao24 <> '' AND evt_ts IS NOT NULL")
    return rows.groupBy("icao24").applyInPandasWithState(
        _motion(policy, smooth, emit_first), MOTION, STATE, "append", GroupStateTimeout.NoTimeout
    )


def scored(motion: DataFrame, weights=FIXED_WEIGHTS, intercept: float = FIXED_INTERCEPT) -> DataFrame:
    p = probability([F.col("delta_t"), F.col("movement_score")], weights, intercept)
    out = motion.withColumn("risk_probability", p).withColumn("predicted_risk", (F.col("risk_probability") > 0.5).cast("int"))
    return out.select("icao24", "evt_ts", "delta_t", "movement_score", "risk_probability", "predicted_risk", "latitude", "longitude")


def two_sinks(path: str, publish: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that writes a micro-batch to files and to a second sink from one persisted frame. The files of a
    batch are one partition that a replay overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            if publish is not None:
                publish(messages(batch))
        finally:
            batch.unpersist()

    return write


def score_stream(stream: DataFrame, path: str, checkpoint: str, publish: Callable | None = None, every: str | None = "10 seconds", **kw) -> DataStreamWriter:
    w = scored(moving(stream, **kw)).writeStream.foreachBatch(two_sinks(path, publish)).option("checkpointLocation", checkpoint).outputMode("append")
    return w.trigger(processingTime=every) if every else w.trigger(availableNow=True)


def until_stopped(query) -> None:
    """Waits; an interrupt stops the query after its batch."""
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()
