"""Streaming variants: event-time windows, sessions, de-duplication, and change points with state.

A stream has event_id, ts (timestamp), user_id, event_type and value. Rows
later than the watermark are dropped by the windowed operators.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from intervalis.operators.timeseries import CHANGE_SCORE, MIN_ROWS


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of events below ``path``; ts becomes an instant (UTC session zone)."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Count and sum by window and type; sliding windows if ``slide`` is given."""
    span = F.window("ts", width, slide or width)
    rows = events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: runs of events with gaps below ``gap``."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One row of each event_id."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


#: A waiting row, and how many are packed into one value of the state at most.
_ROWS, _PACKED = np.dtype([("at", "i8"), ("id", "i8"), ("motion", "f8"), ("direction", "f8"), ("brightness", "f8")]), 65_536


class OpenSegments(StatefulProcessor):
    """Segments of each video's frames between change points, by event time.

    Rows wait until the watermark has passed them, so files may come in any order; those that
    come later than that are dropped before they get here. State is the waiting rows, packed by
    batches, and the open segment: its start, number of rows and the sums of three metrics. A timer
    wakes a video for its next waiting row, or, when it has been silent for ``idle_ms``, to close it:
    its last row ends the last segment, and its state goes. Rows without a time are never passed.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open = handle.getValueState("open", "start long, first long, n int, motion double, direction double, brightness double, row long, last long")

    def _advance(self, key, watermark_ms: int) -> list[tuple]:
        """Takes the rows that the watermark has passed, in order; returns the segments they close."""
        parts = [np.frombuffer(r[0], _ROWS) for r in self.waiting.get()]
        rows = np.concatenate(parts) if parts else np.empty(0, _ROWS)
        late = rows["at"] > watermark_ms * 1000
        ripe, rest = rows[~late], rows[late]
        ripe = ripe[np.lexsort([ripe[c] for c in reversed(_ROWS.names)])]
        state, out = (self.open.get() if self.open.exists() else None), []
        metrics = [np.nan_to_num(ripe[c], nan=default, posinf=np.inf, neginf=-np.inf).tolist() for c, default in (("motion", 0.0), ("direction", 0.0), ("brightness", 0.5))]
        if state is not None:
            start, first, n, sm, sd, sb, row, last = state
        for at, m, d, b in zip(ripe["at"].tolist(), *metrics, strict=True):
            last = at
            if state is None:
                state = start, first, n, sm, sd, sb, row = at, 0, 1, m, d, b, 0
                continue
            row += 1
            if n + 1 >= MIN_ROWS:
                am, ad, ab = sm / n, sd / n, sb / n
                if 0.4 * abs(m - am) / (am + 0.1) + 0.4 * abs(d - ad) / (math.pi + 0.1) + 0.2 * abs(b - ab) > CHANGE_SCORE:
                    out.append((key[0], first, row, start / 1e6, at / 1e6, n + 1))
                    start, first, n, sm, sd, sb = at, row, 1, m, d, b
                    continue
            n, sm, sd, sb = n + 1, sm + m, sd + d, sb + b
        if state is not None and not len(rest) and last + self.idle_ms * 1000 <= watermark_ms * 1000:
            if n >= MIN_ROWS:
                out.append((key[0], first, row, start / 1e6, last / 1e6, n))
            state = None
            self.open.clear()
        elif state is not None and len(ripe):
            self.open.update((start, first, n, sm, sd, sb, row, last))
        if len(ripe):
            if len(rest):
                self.waiting.put([(rest[k : k + _PACKED].tobytes(),) for k in range(0, len(rest), _PACKED)])
            else:
                self.waiting.clear()
        if len(rest):
            self.handle.registerTimer(-(-int(rest["at"].min()) // 1000))
        elif state is not None:
            self.handle.registerTimer(-(-last // 1000) + self.idle_ms)
        return out

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["video_id", "first_row", "last_row", "start_time", "end_time", "n_rows"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least, watermark = None, timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            batch = batch[batch["at"].notna()]
            if not len(batch):
                continue
            packed = np.empty(len(batch), _ROWS)
            packed["at"], packed["id"] = batch["at"], batch["frame_idx"].fillna(np.iinfo(np.int64).min)
            for c, name in (("motion", "motion_magnitude"), ("direction", "motion_direction"), ("brightness", "brightness")):
                packed[c] = batch[name]
            self.waiting.appendList([(packed[k : k + _PACKED].tobytes(),) for k in range(0, len(packed), _PACKED)])
            low = int(packed["at"].min())
            least = low if least is None else min(least, low)
        if least is None:
            return
        if least > watermark * 1000:  # the rows before have timers of their own
            self.handle.registerTimer(-(-least // 1000))
        elif out := self._advance(key, watermark):
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if out := self._advance(key, timerValues.getCurrentWatermarkInMs()):
            yield self._frame(out)

    def close(self) -> None:
        pass


def change_points(frames: DataFrame, late: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """(video_id, first_row, last_row, start_time, end_time, n_rows) of closed segments (needs the RocksDB state store).

    ``frames``: video_id, frame_idx, ts (timestamp), motion_magnitude, motion_direction, brightness. Rows are
    taken in the order of (ts, frame_idx), whatever files they come in, if they come within ``late``. A video
    that has been silent for ``idle_ms`` of event time is closed; should it go on, it counts as a new one.
    """
    rows = frames.withWatermark("ts", late).select(F.col("video_id").cast("string").alias("video_id"), "ts", F.unix_micros("ts").alias("at"), F.col("frame_idx").cast("long").alias("frame_idx"), *(F.col(c).cast("double").alias(c) for c in ("motion_magnitude", "motion_direction", "brightness")))
    return rows.groupBy("video_id").transformWithStateInPandas(OpenSegments(idle_ms), "video_id string, first_row long, last_row long, start_time double, end_time double, n_rows int", "append", "eventTime")


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result, written as Parquet beside its checkpoint.

    Appended rows go to a file sink, which keeps each batch once; in complete mode every batch writes the whole
    result anew, and the last one counts.
    """
    spark, out = stream.sparkSession, f"{checkpoint}-result"
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if mode == "append":
            writer.format("parquet").option("path", out).start().awaitTermination()
            return spark.read.schema(stream.schema).parquet(out)
        last: list[int] = []

        def written(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/{number}")
            last.append(number)

        writer.foreachBatch(written).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/{last[-1]}") if last else spark.createDataFrame([], stream.schema)
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
