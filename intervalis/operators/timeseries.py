"""Runs, prefixes and change points of ordered frame rows, one series per video.

Island operators are windows over (video, order): a break flag, its running sum
and one aggregation, so that a series is shuffled once by its key. Only the
change-point fold, whose state is reset by its own decisions, walks a series in
Python, as Arrow groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHANGE_SCORE, MIN_ROWS = 0.4, 5


def islands(df: DataFrame, key: str, order: Sequence[str], kind: Column) -> DataFrame:
    """``df`` with kind and island: maximal runs of equal kind (null is a kind of its own) along each key."""
    along = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("kind", kind)
    change = ~F.col("kind").eqNullSafe(F.lag("kind").over(along)) | F.row_number().over(along).eqNullSafe(1)
    return rows.withColumn("change", change.cast("int")).withColumn("island", F.sum("change").over(along)).drop("change")


def runs(df: DataFrame, key: str, order: Sequence[str], ts: str, kind: Column, least: int, aggregates: Sequence[Column] = ()) -> DataFrame:
    """Runs of a non-null kind of at least ``least`` rows: key, kind, start_time, end_time, n and further aggregates.

    A run ends at the next row's time, the last one at its own last row.
    """
    along = Window.partitionBy(key).orderBy(*order)
    rows = islands(df.withColumn("next_ts", F.coalesce(F.lead(ts).over(along), F.col(ts))), key, order, kind).filter("kind is not null")
    found = rows.groupBy(key, "island", "kind").agg(F.min(ts).alias("start_time"), F.max("next_ts").alias("end_time"), F.count(F.lit(1)).alias("n"), *aggregates)
    return found.filter(F.col("n") >= least).drop("island")


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def uniform_runs(frames: DataFrame) -> DataFrame:
    """Black, lens cap, white and uniform stretches of three frames or more."""
    flag = lambda name: F.coalesce(F.col(f"garbage_flags.{name}"), F.lit(False))
    kind = F.when(flag("is_black"), "black_frame").when(flag("is_lens_cap"), "lens_cap").when(flag("is_white"), "whiteout").when(flag("is_uniform"), "uniform_frame")
    means = [F.avg(F.coalesce("brightness", F.lit(0.5))).alias("avg_brightness"), F.avg(F.coalesce("variance", F.lit(0.0))).alias("avg_variance")]
    found = runs(frames, "video_id", ["timestamp", "frame_idx"], "timestamp", kind, 3, means)
    sure = F.when(F.col("kind").isin("black_frame", "lens_cap"), 1 - F.col("avg_brightness") / 0.02).when(F.col("kind") == "whiteout", (F.col("avg_brightness") - 0.9) / 0.1).otherwise(1 - F.col("avg_variance") / 10)
    return found.withColumn("confidence", _clamp(sure))


def accidental_runs(frames: DataFrame) -> DataFrame:
    """Stretches of sky, then of ground, of five frames or more."""
    flag = lambda name: F.coalesce(F.col(f"garbage_flags.{name}"), F.lit(False))
    kind = F.when(flag("is_likely_sky"), "sky_shot").when(flag("is_likely_ground"), "ground_shot")
    found = runs(frames, "video_id", ["timestamp", "frame_idx"], "timestamp", kind, 5, [F.avg(F.coalesce("edge_density", F.lit(0.0))).alias("avg_edge")])
    return found.withColumn("confidence", _clamp(1 - F.least(F.col("avg_edge") / 0.05, F.lit(1.0)), 0.5))


def _with_length(frames: DataFrame) -> DataFrame:
    """Adds the number of rows and, where it isn't there, the duration of each video."""
    whole = Window.partitionBy("video_id")
    rows = frames.withColumn("n_rows", F.count(F.lit(1)).over(whole))
    return rows if "duration" in frames.columns else rows.withColumn("duration", F.max("timestamp").over(whole))


def dead_air(frames: DataFrame, end: bool = False, still: float = 0.5, share: float = 0.15, least: int = 10) -> DataFrame:
    """Pre-roll, or post-roll if ``end``: the longest still prefix (suffix) within the first (last) share of the video."""
    order = [F.desc("timestamp"), F.desc("frame_idx")] if end else [F.asc("timestamp"), F.asc("frame_idx")]
    along = Window.partitionBy("video_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.col("timestamp") >= F.col("duration") * (1 - share) if end else F.col("timestamp") <= F.col("duration") * share
    stops = (F.coalesce("motion_magnitude", F.lit(0.0)) >= still) | ~inside
    rows = _with_length(frames).filter(F.col("n_rows") >= 10).withColumn("stopped", F.max(stops.cast("int")).over(along)).filter("stopped = 0")
    found = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.max("duration").alias("duration"))
    found = found.filter(F.col("n") >= least)
    if end:
        return found.select("video_id", F.lit("post_roll").alias("kind"), F.col("first_ts").alias("start_time"), F.col("duration").alias("end_time"), "n")
    return found.select("video_id", F.lit("pre_roll").alias("kind"), F.lit(0.0).alias("start_time"), (F.col("last_ts") + 0.1).alias("end_time"), "n")


def exposure_flash(frames: DataFrame, jump: float = 0.25, calm: float = 0.05, before: float = 2.0) -> DataFrame:
    """The first jump of brightness among the first frames that is followed by five steady ones."""
    along = Window.partitionBy("video_id").orderBy("timestamp", "frame_idx")
    b = F.coalesce("brightness", F.lit(0.5))
    rows = _with_length(frames).filter(F.col("n_rows") >= 20).withColumn("i", F.row_number().over(along) - 1).withColumn("b", b).filter("i < 30")
    rows = rows.withColumn("delta", F.abs(F.col("b") - F.lag("b").over(along))).withColumn("spread", F.stddev_pop("b").over(along.rowsBetween(1, 5))).withColumn("until", F.lead("timestamp", 5).over(along))
    hits = rows.filter((F.col("i") >= 1) & F.col("until").isNotNull() & (F.col("i") < F.least("n_rows", F.lit(30)) - 5) & (F.col("delta") > jump) & (F.col("spread") < calm) & (F.col("until") < before))
    first = hits.groupBy("video_id").agg(F.min(F.struct("i", "delta", "until")).alias("x"))
    return first.select("video_id", F.lit("exposure_flash").alias("kind"), F.lit(0.0).alias("start_time"), F.col("x.until").alias("end_time"), F.least(F.col("x.delta") / 0.3, F.lit(1.0)).alias("confidence"))


def abrupt_cuts(frames: DataFrame, motion: float = 3.0, consistency: float = 0.5) -> DataFrame:
    """Videos that begin or end in the middle of a movement."""
    up, down = Window.partitionBy("video_id").orderBy("timestamp", "frame_idx"), Window.partitionBy("video_id").orderBy(F.desc("timestamp"), F.desc("frame_idx"))
    rows = _with_length(frames).filter(F.col("n_rows") >= 6).withColumn("head", F.row_number().over(up)).withColumn("tail", F.row_number().over(down))
    edge = rows.filter("head <= 3 or tail <= 3").withColumn("kind", F.when(F.col("head") <= 3, "cut_at_start").otherwise("cut_at_end"))
    found = edge.groupBy("video_id", "kind").agg(
        F.avg(F.coalesce("motion_magnitude", F.lit(0.0))).alias("avg_motion"), F.avg(F.coalesce("direction_consistency", F.lit(0.0))).alias("avg_consistency"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.max("duration").alias("duration"),
    )
    start = F.col("kind") == "cut_at_start"
    return found.filter((F.col("avg_motion") > motion) & (F.col("avg_consistency") > consistency)).select(
        "video_id", "kind", F.when(start, 0.0).otherwise(F.col("first_ts")).alias("start_time"), F.when(start, F.col("last_ts")).otherwise(F.col("duration")).alias("end_time"),
        F.least(F.col("avg_motion") / 5, F.lit(1.0)).alias("confidence"),
    )


def scene_changes(segments: DataFrame, distance: Column, hard: float = 0.5, soft: float = 0.25) -> DataFrame:
    """Changes between a segment and the one before; ``distance`` is over the columns and their ``prev_`` twins."""
    along = Window.partitionBy("video_id").orderBy("start_time", "index")
    rows = segments
    for c in ("index", "start_time", "brightness", "contrast", "edge_density"):
        rows = rows.withColumn(f"prev_{c}", F.lag(c).over(along))
    rows = rows.filter("prev_index is not null").withColumn("distance", distance).filter(F.col("distance") > soft)
    kind = F.when(F.col("distance") > hard, "hard_cut").when(F.abs(F.col("brightness") - F.col("prev_brightness")) > 0.3, "lighting").otherwise("soft_cut")
    return rows.select("video_id", F.col("prev_index").alias("from_index"), F.col("index").alias("to_index"), F.col("start_time").alias("timestamp"), kind.alias("change_type"), F.least(F.col("distance") / 0.5, F.lit(1.0)).alias("confidence"), "distance")


def fold_change_points(rows: Sequence[tuple[float, float | None, float | None, float | None]], threshold: float = CHANGE_SCORE, least: int = MIN_ROWS) -> list[tuple[int, int]]:
    """(first, last) row of each segment of (timestamp, motion, direction, brightness) rows in order; neighbours share the closing row.

    A row closes the segment if it is far from the mean of the rows before it.
    """
    out, start, n, sums = [], 0, 0, (0.0, 0.0, 0.0)
    for i, (_, m, d, b) in enumerate(rows):
        now = (m or 0.0, d or 0.0, 0.5 if b is None else b)
        close = i == len(rows) - 1
        if n + 1 >= least and n:
            am, ad, ab = (s / n for s in sums)
            close |= 0.4 * abs(now[0] - am) / (am + 0.1) + 0.4 * abs(now[1] - ad) / (math.pi + 0.1) + 0.2 * abs(now[2] - ab) > threshold
        n, sums = n + 1, tuple(s + x for s, x in zip(sums, now, strict=True))
        if close and n >= least:
            out.append((start, i))
            start, n, sums = i, 1, now
    return out


_SEGMENTS = "video_id string, segment_no int, first_row int, last_row int, start_time double, end_time double, n_rows int"


def change_point_segments(frames: DataFrame, threshold: float = CHANGE_SCORE) -> DataFrame:
    """Segments of each video's frames between change points. Memory is one video's rows; a tail of under five rows is dropped."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("timestamp", "ascending"), ("frame_idx", "ascending")])
        ts = table["timestamp"].to_pylist()
        rows = list(zip(ts, *(table[c].to_pylist() for c in ("motion_magnitude", "motion_direction", "brightness")), strict=True))
        found, video = fold_change_points(rows, threshold), table["video_id"][0].as_py()
        columns = [[video] * len(found), range(1, len(found) + 1), [a for a, _ in found], [b for _, b in found], [ts[a] for a, _ in found], [ts[b] for _, b in found], [b - a + 1 for a, b in found]]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32())
        return pa.table({f.split()[0]: pa.array(list(c), k) for f, c, k in zip(_SEGMENTS.split(", "), columns, kinds, strict=True)})

    thin = frames.select("video_id", "timestamp", "frame_idx", "motion_magnitude", "motion_direction", "brightness")
    return thin.groupBy("video_id").applyInArrow(one, _SEGMENTS)


def history(df: DataFrame, key: str, order: Sequence[str], value: str, rows: int = 20) -> DataFrame:
    """``df`` with the last ``rows`` values of a column along each key, the current one last."""
    along = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn("history", F.collect_list(value).over(along))
