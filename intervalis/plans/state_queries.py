"""Queries of as-of joins, mergeable sketches and streams of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from intervalis.operators import sketches
from intervalis.operators.asof import asof_join
from intervalis.plans.register import Register
from intervalis.plans.scratch import shared_folder
from intervalis.plans.views import FRAMES_SQL, SEGMENTS_SQL, frames, segments, table
from intervalis.sources import documents
from intervalis.streaming.streams import drained

REGISTER = Register()


def _sides(s, d):
    """Frames and detections; every third video's are one video's, so that it holds a third of all rows."""
    rows = frames(s, d).withColumn("video_id", F.when(F.col("video_id").cast("long") % 3 == 0, "hot").otherwise(F.col("video_id")))
    found = rows.filter("event_type in ('purchase', 'error')").select("video_id", F.col("timestamp").alias("since"), F.col("event_type").alias("kind"), F.col("frame_idx").alias("detection"))
    return rows.select("frame_idx", "video_id", "timestamp"), found


_SIDES_SQL = f"""{FRAMES_SQL}, f AS (SELECT frame_idx, CASE WHEN video_id::BIGINT % 3 = 0 THEN 'hot' ELSE video_id END AS video_id, timestamp, event_type FROM frm),
    det AS (SELECT video_id, timestamp AS since, max({{'kind': event_type, 'detection': frame_idx}}) AS x FROM f WHERE event_type IN ('purchase', 'error') GROUP BY ALL)"""
REGISTER.add(
    "asof_detections", lambda s, d: (lambda fr, det: asof_join(fr, det, ["video_id"], "timestamp", ["kind", "detection"], 21_600.0, right_time="since"))(*_sides(s, d)),
    "SELECT f.frame_idx, f.video_id, f.timestamp, det.since AS since_asof, det.x.kind AS kind_asof, det.x.detection AS detection_asof FROM f ASOF LEFT JOIN det ON f.video_id = det.video_id AND f.timestamp >= det.since", _SIDES_SQL,
)
REGISTER.add(
    "asof_before_within", lambda s, d: (lambda fr, det: asof_join(fr, det, ["video_id"], "timestamp", ["kind"], 21_600.0, right_time="since", strict=True, tolerance=7200.0))(*_sides(s, d)),
    """SELECT f.frame_idx, f.video_id, f.timestamp, CASE WHEN f.timestamp - det.since <= 7200 THEN det.since END AS since_asof, CASE WHEN f.timestamp - det.since <= 7200 THEN det.x.kind END AS kind_asof
       FROM f ASOF LEFT JOIN det ON f.video_id = det.video_id AND f.timestamp > det.since""", _SIDES_SQL,
)


def _sketch_levels(s, d):
    """Sketches of users, merged to projects and to all; each answer is held against the exact one."""
    rows = table(s, d, "events").select(F.col("user_id").alias("video_id"), (F.col("user_id") % 5).alias("project_id"), F.col("event_id") % 7001, "value").toDF("video_id", "project_id", "who", "value")
    videos = sketches.sketched(rows, ["project_id", "video_id"], "who", "value")
    projects = sketches.read_sketches(sketches.merged(videos, ["project_id"]), ["project_id"], (0.5, 0.9))
    whole = sketches.read_sketches(sketches.merged(videos, []), [], (0.5, 0.9)).select(F.lit(-1).cast("long").alias("project_id"), "n", "distinct", "q50", "q90")
    said = projects.unionByName(whole)
    both = rows.unionByName(rows.withColumn("project_id", F.lit(-1).cast("long"))).join(said.drop("n"), "project_id")
    up_to = lambda q: F.sum((F.col("value") <= F.col(q)).cast("double")) / F.count("value")
    held = both.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("who").alias("exact"), F.max("distinct").alias("distinct"), up_to("q50").alias("r50"), up_to("q90").alias("r90"))
    near = lambda r, q: F.abs(F.col(r) - q) <= sketches.RANK_ERROR + 1 / F.col("n")
    return held.select("project_id", "n", F.col("exact").alias("distinct_exact"), (F.abs(F.col("distinct") - F.col("exact")) <= sketches.COUNT_ERROR * F.col("exact")).alias("distinct_near"), near("r50", 0.5).alias("median_near"), near("r90", 0.9).alias("q90_near"))


REGISTER.add(
    "sketch_levels", _sketch_levels,
    """SELECT project_id, count(*) AS n, count(DISTINCT event_id % 7001) AS distinct_exact, true AS distinct_near, true AS median_near, true AS q90_near
       FROM (SELECT user_id % 5 AS project_id, event_id FROM events UNION ALL SELECT -1, event_id FROM events) GROUP BY project_id""",
)


#: Bytes of documents that a round of the stream reads.
_ROUND = 1 << 30


def _stream_documents(s, d):
    """Segments written as analysis documents of 512 orders each, a file a document in one folder, and read back as a stream."""
    part = F.struct("start_time", "end_time", "duration", "score", F.upper("tier").alias("tier"), "tags")
    rows = segments(s, d).withColumn("doc", F.floor(F.col("video_id") / 512))
    videos = rows.groupBy("doc", "filename").agg(F.sort_array(F.collect_list(part)).alias("segments")).withColumn("v", F.struct(F.lit(True).alias("success"), "filename", F.lit(60.0).alias("duration"), "segments"))
    docs = videos.groupBy("doc").agg(F.collect_list("v").alias("analyses")).select(F.to_json(F.struct(F.concat(F.lit("p"), "doc").alias("project_id"), "analyses")).alias("value"))
    path = f"{shared_folder(s)}/documents-{uuid.uuid4().hex}"
    docs.write.option("maxRecordsPerFile", 1).text(path)
    read = documents.exploded(documents.stream_analyses(s, path, bytes_per_trigger=_ROUND))
    return drained(read.select("project_id", "filename", "start_time", "end_time", "score", "tier", F.array_join("tags", ",").alias("tag_list"), "file_duration"), f"{path}-state", "append")


REGISTER.add(
    "stream_documents", _stream_documents,
    "SELECT 'p' || video_id // 512 AS project_id, filename, start_time::DOUBLE AS start_time, end_time::DOUBLE AS end_time, score::DOUBLE AS score, tier, array_to_string(tags, ',') AS tag_list, 60.0::DOUBLE AS file_duration FROM seg", SEGMENTS_SQL,
)
