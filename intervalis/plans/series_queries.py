"""Runs, prefixes, change points, overlaps, folds and streams over frames."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from intervalis.operators import intervals, table_functions, timeseries
from intervalis.operators.rollups import detections_by_video
from intervalis.plans.register import Register
from intervalis.plans.scratch import shared_folder
from intervalis.plans.views import FRAMES_SQL, SEGMENTS_SQL, frames, segments
from intervalis.streaming import streams

REGISTER = Register()


def _runs_sql(kind: str, least: int, means: str, confidence: str) -> str:
    return f"""SELECT video_id, kind, min(timestamp) AS start_time, max(next_ts) AS end_time, count(*) AS n, {means}, {confidence} AS confidence FROM (
        SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY timestamp, frame_idx ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, coalesce(lead(timestamp) OVER w, timestamp) AS next_ts, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS b FROM (SELECT *, {kind} AS kind FROM frm)
        WINDOW w AS (PARTITION BY video_id ORDER BY timestamp, frame_idx))) WHERE kind IS NOT NULL GROUP BY video_id, island, kind HAVING count(*) >= {least}"""


REGISTER.add(
    "uniform_runs", lambda s, d: timeseries.uniform_runs(frames(s, d)),
    _runs_sql("CASE event_type WHEN 'error' THEN 'black_frame' WHEN 'signup' THEN 'uniform_frame' END", 3, "avg(brightness) AS avg_brightness, avg(variance) AS avg_variance", "greatest(0.0, least(1.0, CASE kind WHEN 'black_frame' THEN 1 - avg(brightness) / 0.02 ELSE 1 - avg(variance) / 10 END))"), FRAMES_SQL,
)
REGISTER.add(
    "accidental_runs", lambda s, d: timeseries.accidental_runs(frames(s, d)),
    _runs_sql("CASE event_type WHEN 'view' THEN 'sky_shot' WHEN 'click' THEN 'ground_shot' END", 5, "avg(edges) AS avg_edge", "greatest(0.5, least(1.0, 1 - least(avg(edges) / 0.05, 1.0)))"), FRAMES_SQL,
)
REGISTER.add(
    "pre_roll", lambda s, d: timeseries.dead_air(frames(s, d), still=4.0, share=0.5, least=3),
    """SELECT video_id, 'pre_roll' AS kind, 0.0::DOUBLE AS start_time, max(timestamp) + 0.1 AS end_time, count(*) AS n FROM (SELECT *, max(CASE WHEN motion >= 4 OR timestamp > dur * 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY timestamp, frame_idx ROWS UNBOUNDED PRECEDING) AS stopped FROM
       (SELECT *, max(timestamp) OVER v AS dur, count(*) OVER v AS c FROM frm WINDOW v AS (PARTITION BY video_id)) WHERE c >= 10) WHERE stopped = 0 GROUP BY video_id HAVING count(*) >= 3""", FRAMES_SQL,
)
REGISTER.add(
    "post_roll", lambda s, d: timeseries.dead_air(frames(s, d), end=True, still=4.0, share=0.5, least=3),
    """SELECT video_id, 'post_roll' AS kind, min(timestamp) AS start_time, max(dur) AS end_time, count(*) AS n FROM (SELECT *, max(CASE WHEN motion >= 4 OR timestamp < dur * (1 - 0.5) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY timestamp DESC, frame_idx DESC ROWS UNBOUNDED PRECEDING) AS stopped FROM
       (SELECT *, max(timestamp) OVER v AS dur, count(*) OVER v AS c FROM frm WINDOW v AS (PARTITION BY video_id)) WHERE c >= 10) WHERE stopped = 0 GROUP BY video_id HAVING count(*) >= 3""", FRAMES_SQL,
)
REGISTER.add(
    "exposure_flash", lambda s, d: timeseries.exposure_flash(frames(s, d), jump=0.2, calm=0.2, before=1e9),
    """SELECT video_id, 'exposure_flash' AS kind, 0.0::DOUBLE AS start_time, arg_min(until, i) AS end_time, least(arg_min(delta, i) / 0.3, 1.0)::DOUBLE AS confidence FROM (
       SELECT *, abs(brightness - lag(brightness) OVER w) AS delta, stddev_pop(brightness) OVER (PARTITION BY video_id ORDER BY timestamp, frame_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS spread, lead(timestamp, 5) OVER w AS until FROM
       (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, frame_idx) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS c FROM frm) WHERE c >= 20 AND i < 30 WINDOW w AS (PARTITION BY video_id ORDER BY timestamp, frame_idx))
       WHERE i >= 1 AND until IS NOT NULL AND i < least(c, 30) - 5 AND delta > 0.2 AND spread < 0.2 AND until < 1e9 GROUP BY video_id""", FRAMES_SQL,
)
REGISTER.add(
    "abrupt_cuts", lambda s, d: timeseries.abrupt_cuts(frames(s, d), motion=3.0, consistency=0.3),
    """SELECT video_id, kind, CASE kind WHEN 'cut_at_start' THEN 0.0 ELSE min(timestamp) END::DOUBLE AS start_time, CASE kind WHEN 'cut_at_start' THEN max(timestamp) ELSE max(dur) END AS end_time, least(avg(motion) / 5, 1.0)::DOUBLE AS confidence FROM (
       SELECT *, CASE WHEN head <= 3 THEN 'cut_at_start' ELSE 'cut_at_end' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, frame_idx) AS head, row_number() OVER (PARTITION BY video_id ORDER BY timestamp DESC, frame_idx DESC) AS tail,
       count(*) OVER (PARTITION BY video_id) AS c, max(timestamp) OVER (PARTITION BY video_id) AS dur FROM frm) WHERE c >= 6 AND (head <= 3 OR tail <= 3)) GROUP BY video_id, kind HAVING avg(motion) > 3 AND avg(coalesce(consistency, 0)) > 0.3""", FRAMES_SQL,
)
_FOLD = """ord AS (SELECT video_id, timestamp, motion AS m, direction AS d, brightness AS b, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, frame_idx) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS c FROM frm),
    fold(video_id, i, c, start, n, sm, sd, sb, done_start, done_n) AS (
        SELECT video_id, i, c, 0::BIGINT, 1::BIGINT, m, d, b, NULL::BIGINT, NULL::BIGINT FROM ord WHERE i = 0
        UNION ALL
        SELECT o.video_id, o.i, o.c, CASE WHEN k THEN o.i ELSE start END, CASE WHEN k THEN 1 ELSE n + 1 END, CASE WHEN k THEN m ELSE sm + m END, CASE WHEN k THEN d ELSE sd + d END, CASE WHEN k THEN b ELSE sb + b END, CASE WHEN k THEN start END, CASE WHEN k THEN n + 1 END
        FROM (SELECT o.*, f.start, f.n, f.sm, f.sd, f.sb, f.n + 1 >= 5 AND (o.i = o.c - 1 OR 0.4 * abs(o.m - f.sm / f.n) / (f.sm / f.n + 0.1) + 0.4 * abs(o.d - f.sd / f.n) / (pi() + 0.1) + 0.2 * abs(o.b - f.sb / f.n) > 0.4) AS k
              FROM fold f JOIN ord o ON o.video_id = f.video_id AND o.i = f.i + 1) o)"""
REGISTER.add(
    "change_point_segments", lambda s, d: timeseries.change_point_segments(frames(s, d)).select("video_id", "first_row", "last_row", "start_time", "end_time", "n_rows"),
    f"""WITH RECURSIVE {FRAMES_SQL}, {_FOLD} SELECT f.video_id, f.done_start::INT AS first_row, f.i::INT AS last_row, a.timestamp AS start_time, z.timestamp AS end_time, f.done_n::INT AS n_rows
        FROM fold f JOIN ord a ON a.video_id = f.video_id AND a.i = f.done_start JOIN ord z ON z.video_id = f.video_id AND z.i = f.i WHERE f.done_start IS NOT NULL""",
)


def _by_function(s, d):
    """``change_point_segments`` through the table function, from SQL."""
    table_functions.register(s)
    frames(s, d).createOrReplaceTempView("frames_to_cut")
    return s.sql("SELECT * FROM change_points(TABLE(frames_to_cut))").withColumns({c: F.col(c).cast("int") for c in ("first_row", "last_row")})


REGISTER.add("change_point_function", _by_function, REGISTER.sql["change_point_segments"])
REGISTER.add(
    "history_buffer", lambda s, d: timeseries.history(frames(s, d), "video_id", ["timestamp", "frame_idx"], "motion_magnitude").select("video_id", "frame_idx", F.size("history").cast("long").alias("n"), F.element_at("history", 1).alias("oldest")),
    "SELECT video_id, frame_idx, count(*) OVER w AS n, first_value(motion) OVER w AS oldest FROM frm WINDOW w AS (PARTITION BY video_id ORDER BY timestamp, frame_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", FRAMES_SQL,
)


def _spans(s, d):
    """Detections of a video: its runs of views and clicks, widened to hours."""
    found = timeseries.islands(frames(s, d), "video_id", ["timestamp", "frame_idx"], F.when(F.col("event_type").isin("view", "click"), F.col("event_type")))
    rows = found.filter("kind is not null").groupBy("video_id", "island", "kind").agg(F.min("timestamp").alias("start_time"), (F.max("timestamp") + 3600).alias("end_time"))
    return rows.select("video_id", F.col("island").alias("ordinal"), "kind", "start_time", "end_time")


_SPANS_SQL = """det AS (SELECT video_id, island AS ordinal, kind, min(timestamp) AS start_time, max(timestamp) + 3600 AS end_time FROM (
    SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY timestamp, frame_idx ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS b
    FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS kind FROM frm) WINDOW w AS (PARTITION BY video_id ORDER BY timestamp, frame_idx))) WHERE kind IS NOT NULL GROUP BY video_id, island, kind)"""


def _day_parts(s, d):
    """Segments of a video: the quarters of a day in which it has events."""
    rows = frames(s, d).withColumn("slot", F.floor(F.col("timestamp") / 21600)).select("video_id", "slot").distinct()
    return rows.select("video_id", F.col("slot").alias("index"), (F.col("slot") * 21600.0).alias("start_time"), ((F.col("slot") + 1) * 21600.0).alias("end_time"), F.lit("gold").alias("tier"))


_PARTS_SQL = "day AS (SELECT DISTINCT video_id, floor(timestamp / 21600)::BIGINT AS index FROM frm)"
REGISTER.add(
    "overlap_mark", lambda s, d: intervals.mark_garbage(_day_parts(s, d), _spans(s, d), share=0.1, width=21600.0).select("video_id", "index", "is_garbage", "garbage_type", "tier"),
    """SELECT y.video_id, y.index, g.kind IS NOT NULL AS is_garbage, g.kind AS garbage_type, CASE WHEN g.kind IS NOT NULL THEN 'garbage' ELSE 'gold' END AS tier FROM day y LEFT JOIN (
       SELECT y.video_id, y.index, arg_min(t.kind, t.ordinal) AS kind FROM day y JOIN det t ON t.video_id = y.video_id AND y.index * 21600.0 < t.end_time AND t.start_time < (y.index + 1) * 21600.0
       WHERE (least((y.index + 1) * 21600.0, t.end_time) - greatest(y.index * 21600.0, t.start_time)) / 21600.0 > 0.1 GROUP BY ALL) g ON g.video_id = y.video_id AND g.index = y.index""", FRAMES_SQL, _SPANS_SQL, _PARTS_SQL,
)
REGISTER.add(
    "frame_in_segment", lambda s, d: intervals.frames_in_segments(frames(s, d), _day_parts(s, d).withColumnRenamed("index", "segment_no"), width=21600.0).groupBy("video_id", "segment_no").agg(F.count(F.lit(1)).alias("n"), F.avg("motion_magnitude").alias("motion_mean")),
    "SELECT y.video_id, y.index AS segment_no, count(*) AS n, avg(f.motion) AS motion_mean FROM day y JOIN frm f ON f.video_id = y.video_id AND f.timestamp BETWEEN y.index * 21600.0 AND (y.index + 1) * 21600.0 GROUP BY ALL", FRAMES_SQL, _PARTS_SQL,
)
REGISTER.add(
    "detections_by_video", lambda s, d: detections_by_video(_spans(s, d)).select("video_id", F.size("detections").cast("long").alias("n"), F.concat_ws(",", "types_found").alias("types")),
    "SELECT video_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT kind)), ',') AS types FROM det GROUP BY video_id", FRAMES_SQL, _SPANS_SQL,
)
REGISTER.add(
    "guarded_garbage", lambda s, d: intervals.guard_garbage(segments(s, d)).select("video_id", "index", "tier", "is_key_moment", "is_repeated_take"),
    "SELECT video_id, index, tier, is_key_moment AND NOT is_garbage AS is_key_moment, is_repeated_take AND NOT is_garbage AS is_repeated_take FROM seg", SEGMENTS_SQL,
)


def _stream(make, mode):
    """A query that drains the stream of events through ``make``."""

    def run(spark, d):
        name = f"stream_{uuid.uuid4().hex}"
        return streams.drained(make(_events_stream(spark, d)), f"{shared_folder(spark)}/{name}", mode)

    return run


def _events_stream(spark, d):
    """The events table as a stream of its files."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


REGISTER.add(
    "stream_tumbling", _stream(lambda e: streams.tumbling(e, "1 day"), "complete"),
    "SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS stop, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL",
)
REGISTER.add(
    "stream_sliding", _stream(lambda e: streams.tumbling(e, "2 days", slide="1 day"), "complete"),
    "SELECT start, start + INTERVAL 2 DAY AS stop, event_type, count(*) AS n, sum(value) AS total FROM (SELECT *, date_trunc('day', ts) - INTERVAL (k) DAY AS start FROM events, (SELECT unnest([0, 1]) AS k)) WHERE start <= ts AND ts < start + INTERVAL 2 DAY GROUP BY start, event_type",
)
REGISTER.add(
    "stream_session", _stream(lambda e: streams.sessions(e, "2 hours"), "complete"),
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS n, sum(value) AS total FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
       (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""",
)
REGISTER.add(
    "stream_dedupe", _stream(lambda e: streams.deduplicated(e.unionByName(e)).select("event_id", "event_type"), "append"),
    "SELECT DISTINCT event_id, event_type FROM events",
)
_LATE, _IDLE = 3600, 43200


def _frames_of(events):
    """The columns of the frames view, on a stream."""
    k, v = F.col("event_id"), F.col("value")
    return events.select(F.col("user_id").alias("video_id"), k.alias("frame_idx"), "ts", (v / 50).alias("motion_magnitude"), (k % 7).cast("double").alias("motion_direction"), (v / 500).alias("brightness"))


_READY = f"""mark AS (SELECT floor(max(timestamp) * 1000) / 1000 - {_LATE} AS w FROM frm),
    ready AS (SELECT *, max(timestamp) OVER (PARTITION BY video_id) + {_IDLE} <= w AS silent FROM frm, mark QUALIFY timestamp <= w)"""
REGISTER.add(
    "stream_segments", _stream(lambda e: streams.change_points(_frames_of(e), f"{_LATE} seconds", _IDLE * 1000).withColumns({c: F.col(c) - 1704067200 for c in ("start_time", "end_time")}), "append"),
    f"""WITH RECURSIVE {FRAMES_SQL}, {_READY}, {_FOLD.replace("AS c FROM frm", "+ CASE WHEN silent THEN 0 ELSE 1 END AS c FROM ready")}
        SELECT f.video_id, f.done_start AS first_row, f.i AS last_row, a.timestamp AS start_time, z.timestamp AS end_time, f.done_n::INT AS n_rows
        FROM fold f JOIN ord a ON a.video_id = f.video_id AND a.i = f.done_start JOIN ord z ON z.video_id = f.video_id AND z.i = f.i WHERE f.done_start IS NOT NULL""",
)
