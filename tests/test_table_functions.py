import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from intervalis.operators import intervals, table_functions, timeseries


@pytest.fixture(scope="module")
def sql(spark):
    table_functions.register(spark)
    rnd = random.Random(12)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice("abc"), k, rnd.randrange(400) / 4, rnd.choice([None, rnd.random() * 6]), rnd.choice([0.0, 3.0]), rnd.choice([None, rnd.random()]), "x") for k in range(900)] + [("short", 5000 + k, float(k), 1.0, 0.0, 0.5, "x") for k in range(4)]
    spark.createDataFrame(rows, "video_id string, frame_idx long, timestamp double, motion_magnitude double, motion_direction double, brightness double, last_row string").repartition(6).createOrReplaceTempView("tf_frames")
    clips, at = [], {}
    for k in range(500):
        v = "hot" if rnd.random() < 0.4 else rnd.choice("abc")
        start = at.get(v, 0.0) + rnd.choice([0.0, 0.0, 0.0, 3.0])
        at[v] = start + rnd.choice([0.25, 0.5, 1.5, 4.0])
        clips.append((v, k, start, at[v], at[v] - start, rnd.choice([4.0, 5.0, 8.0]), rnd.choice(["gold", "silver", "garbage"]), rnd.choice(["TILT", "PANEO", "LOCKED"]), rnd.random() < 0.1, [rnd.choice("xyz")], {"a": rnd.random()}))
    clips.append(("one", 900, 0.0, 0.5, 99.0, 5.0, "gold", "TILT", False, [], {"a": 1.0}))
    schema = "video_id string, index int, start_time double, end_time double, duration double, score double, tier string, shot_type string, is_key_moment boolean, tags array<string>, metrics struct<a:double>"
    spark.createDataFrame(clips, schema).repartition(6).createOrReplaceTempView("tf_segments")
    return spark.sql


def plain(df, *columns):
    return sorted(map(str, (r.asDict(recursive=True) for r in df.select(*columns).collect())))


def test_change_points_equal_the_batch(sql, spark):
    columns = ("video_id", "first_row", "last_row", "start_time", "end_time", "n_rows")
    want = timeseries.change_point_segments(spark.table("tf_frames").drop("last_row"))
    got = sql("SELECT * FROM change_points(TABLE(tf_frames))")
    assert got.columns == list(columns) and plain(got, *columns) == plain(want, *columns) and got.count() > 50
    strict = sql("SELECT * FROM change_points(TABLE(SELECT * FROM tf_frames WHERE video_id = 'a'), 1.5)")
    assert plain(strict, *columns) == plain(timeseries.change_point_segments(spark.table("tf_frames").filter("video_id = 'a'").drop("last_row"), 1.5), *columns)
    assert sql("SELECT * FROM change_points(TABLE(SELECT * FROM tf_frames WHERE false))").count() == 0


@pytest.mark.parametrize("micro", [None, 0.4, 5.0])
def test_consolidated_equal_the_batch(sql, spark, micro):
    want = intervals.consolidate(spark.table("tf_segments"), *([] if micro is None else [micro]))
    got = sql(f"SELECT * FROM consolidated_segments(TABLE(tf_segments){'' if micro is None else f', {micro}'})")
    columns = [c for c in want.columns if c != "merged_count"]
    shown = [*columns, F.col("merged_count").cast("long").alias("merged_count")]
    assert plain(got, *shown) == plain(want, *shown) and got.count() < 500
    assert got.filter("video_id = 'one'").first().duration == 99.0


def test_wrong_tables_are_refused(sql):
    with pytest.raises(PySparkException, match="no column brightness"):
        sql("SELECT * FROM change_points(TABLE(SELECT video_id, frame_idx, timestamp, motion_magnitude, motion_direction FROM tf_frames))")
    with pytest.raises(PySparkException, match="is a table"):
        sql("SELECT * FROM consolidated_segments(5)")
