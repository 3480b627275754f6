import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from intervalis.operators.timeseries import fold_change_points
from intervalis.streaming import streams


@pytest.fixture
def folder(spark, tmp_path):
    """Three files of events in the order of their times."""
    rows = [(i, f"2024-01-0{1 + i // 40} {i % 24:02d}:00:00", i % 3, "view" if i % 2 else "click", float(i % 7 + (20 if i % 40 > 20 else 0))) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "cast(t as timestamp_ntz) ts", "user_id", "event_type", "value", "'{}' props")
    for k in range(3):
        df.filter((F.col("event_id") >= 40 * k) & (F.col("event_id") < 40 * (k + 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return f"{tmp_path}/events"


def test_windows_equal_the_batch(spark, folder, tmp_path):
    found = streams.drained(streams.tumbling(streams.read_events(spark, folder), "1 day"), f"{tmp_path}/c1")
    batch = spark.read.parquet(folder).groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    assert sorted(map(tuple, found.select("start", "event_type", "n", "total").collect())) == sorted(map(tuple, batch.collect()))


def test_duplicates_go(spark, folder, tmp_path):
    events = streams.read_events(spark, folder)
    out = streams.drained(streams.deduplicated(events.unionByName(events)).select("event_id"), f"{tmp_path}/c2", "append")
    assert out.count() == 120 and out.distinct().count() == 120


def frames(spark, tmp_path, rows, files):
    """Frames in files, read in the order of their names' writing."""
    schema = "video_id string, frame_idx long, t double, motion_magnitude double, motion_direction double, brightness double"
    df = spark.createDataFrame(rows, schema).selectExpr("video_id", "frame_idx", "timestamp_micros(cast(t * 1e6 as long)) ts", "motion_magnitude", "motion_direction", "brightness")
    for low, high in files:
        df.filter((F.col("frame_idx") >= low) & (F.col("frame_idx") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/frames")
        time.sleep(1.1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/frames")


def batch_segments(rows):
    want = []
    for video in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == video), key=lambda r: (r[2], r[1]))
        want += [(video, a, b, own[a][2], own[b][2], b - a + 1) for a, b in fold_change_points([(r[2], *r[3:]) for r in own])]
    return sorted(want)


def test_segments_of_files_out_of_order_equal_the_batch(spark, tmp_path):
    """The second file holds times before the first one's; a last row, far ahead, lets timers close the silent videos."""
    rnd = random.Random(2)
    rows = [(v, k, 1e6 + float(k ^ 40 if k < 120 else k), rnd.choice([None, rnd.random() * 5, 9.0]), rnd.choice([0.0, 3.0]), rnd.choice([None, rnd.random()])) for v in "abc" for k in range(200) if v != "c" or k < 60]
    ahead = ("z", 1000, 1_090_000.0, 1.0, 0.0, 0.5)
    stream = frames(spark, tmp_path, [*rows, ahead], [(80, 120), (0, 80), (120, 200), (1000, 1001)])
    out = streams.drained(streams.change_points(stream, "5 minutes", 600_000), f"{tmp_path}/c3", "append").collect()
    want = batch_segments(rows)
    assert sorted(tuple(r) for r in out) == want and len(want) > 20


def test_late_rows_are_dropped(spark, tmp_path):
    """Rows behind the watermark change nothing: what comes out is the batch result without them."""
    rows = [("a", k, 1e6 + 10.0 * k, 1.0 if k % 12 < 6 else 8.0, 0.0, 0.5) for k in range(100)]
    late = [("a", 500 + k, 1e6 + 100.0 + k, 50.0, 3.0, 0.9) for k in range(5)]
    ahead = [("z", 900, 1_009_000.0, 1.0, 0.0, 0.5), ("z", 2000, 99_000_000.0, 1.0, 0.0, 0.5)]
    stream = frames(spark, tmp_path, [*rows, *late, *ahead], [(0, 100), (900, 901), (500, 505), (2000, 2001)])
    out = streams.drained(streams.change_points(stream, "60 seconds", 20_000_000), f"{tmp_path}/c4", "append").collect()
    assert sorted(tuple(r) for r in out if r.video_id == "a") == batch_segments(rows)


def test_a_batch_of_rows_is_one_value_of_the_state_and_waits_for_its_timer():
    class State:
        def __init__(self):
            self.held, self.reads = [], 0

        def exists(self):
            return bool(self.held)

        def get(self):
            self.reads += 1
            return iter(self.held)

        def appendList(self, rows):
            self.held += rows

    class Handle:
        timers, waiting, open = [], State(), State()

        def getListState(self, *_):
            return self.waiting

        def getValueState(self, *_):
            return self.open

        def registerTimer(self, at):
            self.timers.append(at)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    held, work = Handle(), streams.OpenSegments(1000)
    work.init(held)
    batch = pd.DataFrame({"at": range(5_000, 6_000), "frame_idx": range(1000), "motion_magnitude": 1.0, "motion_direction": None, "brightness": 0.5})
    assert list(work.handleInputRows(("a",), iter([batch, batch]), Times())) == []
    assert len(held.waiting.held) == 2 and held.waiting.reads == 0 and held.timers == [5]
