"""Queries of names, times, frames, faces, markers and clip elements."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from intervalis.functions import scalars
from intervalis.operators import rollups, scoring, timeline
from intervalis.plans.register import Register
from intervalis.plans.rollup_queries import _CLIPS_SQL, _clips
from intervalis.plans.scratch import dealt, shared_folder
from intervalis.plans.views import FRAMES_SQL, SEGMENTS_SQL, frames, segments, table
from intervalis.sources import timeline_files

REGISTER = Register()

# --- names and times --------------------------------------------------------------------------


def _names(s, d):
    path = F.concat(F.lit("/media/día: "), F.col("p_name"), F.lit("~ñ.mp4"))
    return table(s, d, "part").select("p_partkey", path.alias("path"), F.concat(F.col("p_name"), F.lit(" (ñandú) v1.2")).alias("name"))


REGISTER.add(
    "names",
    lambda s, d: _names(s, d).select(
        "p_partkey", scalars.ascii_name(F.col("name")).alias("ascii"), scalars.clean_name(F.col("name")).alias("clean"), scalars.plain_id(F.col("name")).alias("plain"), scalars.file_url(F.col("path")).alias("url"),
        scalars.file_id(F.col("path")).alias("file"), scalars.upload_id(F.col("path")).alias("upload"), scalars.xml_escape(F.concat(F.lit('<a "b"> & '), "name")).alias("escaped"),
    ),
    r"""SELECT p_partkey, regexp_replace(strip_accents(name), '[^a-zA-Z0-9_.-]', '_', 'g') AS ascii, replace(regexp_replace(name, '[^\p{L}\p{N}\-_ ]', '', 'g'), ' ', '_') AS clean, translate(name, '. -', '___') AS plain,
        'file://localhost' || replace(replace(url_encode(path), '%2F', '/'), '%3A', ':') AS url, 'f_' || substr(md5(path), 1, 8) AS file, 'upload_' || substr(md5(path), 1, 10) AS upload, '&lt;a &quot;b&quot;&gt; &amp; ' || name AS escaped
        FROM (SELECT p_partkey, '/media/día: ' || p_name || '~ñ.mp4' AS path, p_name || ' (ñandú) v1.2' AS name FROM part)""",
)
REGISTER.add(
    "human_times",
    lambda s, d: table(s, d, "orders").withColumn("seconds", F.col("o_orderkey") % 20011 / 5).select("o_orderkey", scalars.human_duration(F.col("seconds")).alias("length"), scalars.timecode(F.col("seconds"), 25).alias("code"), scalars.estimate_seconds(F.col("seconds")).cast("int").alias("estimate")),
    """SELECT o_orderkey, CASE WHEN t < 60 THEN printf('%.1fs', t) WHEN t < 3600 THEN printf('%dm %ds', w // 60, w % 60) ELSE printf('%dh %dm', w // 3600, w // 60 % 60) END AS length,
       printf('%02d:%02d:%02d:%02d', w // 3600, w // 60 % 60, w % 60, floor((t - w) * 25)::BIGINT) AS code,
       CASE WHEN t <= 0 THEN 5 WHEN t < 10 THEN greatest(5, trunc(1.2::DOUBLE * t) + 2) WHEN t < 60 THEN trunc(0.85::DOUBLE * t) + 2 ELSE trunc(0.75::DOUBLE * t) + 2 END::INT AS estimate
       FROM (SELECT o_orderkey, t, floor(t)::BIGINT AS w FROM (SELECT o_orderkey, o_orderkey % 20011 / 5 AS t FROM orders))""",
)
_NOW = "2024-02-03 00:00:00"
REGISTER.add(
    "relative_ages",
    lambda s, d: table(s, d, "events").select("event_id", scalars.relative_age(F.col("ts").cast("timestamp"), F.lit(_NOW).cast("timestamp")).alias("age")),
    f"""SELECT event_id, CASE WHEN t < 3600 THEN printf('Hace %d min', t // 60) WHEN t < 86400 THEN printf('Hace %dh', t // 3600) WHEN t // 86400 = 1 THEN 'Ayer' WHEN t // 86400 < 7 THEN printf('Hace %d días', t // 86400) ELSE strftime(ts, '%d %b') END AS age
        FROM (SELECT event_id, ts, epoch(TIMESTAMP '{_NOW}')::BIGINT - floor(epoch(ts))::BIGINT AS t FROM events)""",
)
REGISTER.add(
    "frame_rates",
    lambda s, d: table(s, d, "part").select("p_partkey", scalars.frame_rate(F.concat(F.col("p_partkey") % 71 * 1000, F.lit("/"), F.when(F.col("p_size") % 3 == 0, 1001).when(F.col("p_size") % 3 == 1, 1000).otherwise(0)), F.concat("p_size", F.lit("/1"))).alias("fps")),
    """SELECT p_partkey, (CASE WHEN abs(rate - 24) <= 0.1 THEN 24 WHEN abs(rate - 25) <= 0.1 THEN 25 WHEN abs(rate - 30) <= 0.1 THEN 30 WHEN abs(rate - 48) <= 0.1 THEN 48 WHEN abs(rate - 50) <= 0.1 THEN 50 WHEN abs(rate - 60) <= 0.1 THEN 60 ELSE round_even(rate, 0)::INT END)::INT AS fps
       FROM (SELECT p_partkey, round_even(CASE WHEN p_size % 3 < 2 AND p_partkey % 71 > 0 THEN p_partkey % 71 * 1000 / CASE p_size % 3 WHEN 0 THEN 1001 ELSE 1000 END ELSE p_size END::DOUBLE, 2) AS rate FROM part)""",
)

# --- frames and faces -------------------------------------------------------------------------


def _pictures(s, d):
    k = F.col("frame_idx")
    return frames(s, d).select("frame_idx", (k % 101 / 100).alias("brightness"), (k % 17).cast("double").alias("variance"), (k % 7 / 150).alias("edge_density"), (k % 11 / 10).alias("top_brightness"), (k % 5 / 10).alias("saturation"), (k % 9 / 10).alias("bottom_brightness"), (k % 4 / 10).alias("texture_score"))


_PICTURES_SQL = "pic AS (SELECT frame_idx, frame_idx % 101 / 100 AS b, (frame_idx % 17)::DOUBLE AS v, frame_idx % 7 / 150 AS e, frame_idx % 11 / 10 AS top, frame_idx % 5 / 10 AS sat, frame_idx % 9 / 10 AS bottom, frame_idx % 4 / 10 AS tex FROM frm)"
REGISTER.add(
    "garbage_frames",
    lambda s, d: _pictures(s, d).select("frame_idx", scoring.garbage_frame(F.col("brightness"), F.col("variance"), F.col("edge_density")).alias("g")).select("frame_idx", "g.is_garbage", "g.kind"),
    "SELECT frame_idx, kind IS NOT NULL AS is_garbage, kind FROM (SELECT frame_idx, CASE WHEN b < 0.02 THEN CASE WHEN v < 5 THEN 'lens_cap' ELSE 'black_frame' END WHEN b > 0.95 AND v < 10 THEN 'whiteout' WHEN v < 10 AND e < 0.01 THEN 'uniform_frame' END AS kind FROM pic)", FRAMES_SQL, _PICTURES_SQL,
)
REGISTER.add(
    "frame_flags", lambda s, d: _pictures(s, d).select("frame_idx", scoring.garbage_flags().alias("g")).select("frame_idx", "g.*"),
    "SELECT frame_idx, b < 0.02 AS is_black, v < 10 AS is_uniform, b > 0.95 AND v < 10 AS is_white, v < 5 AS is_lens_cap, top > 0.7 AND sat < 0.3 AND e < 0.02 AS is_likely_sky, bottom < 0.35 AND e < 0.05 AND tex > 0.1 AS is_likely_ground FROM pic", FRAMES_SQL, _PICTURES_SQL,
)


def _faces(s, d):
    """Order lines as faces: three frames an order."""
    c = F.col
    return table(s, d, "lineitem").select(
        c("l_orderkey").alias("video_id"), (c("l_linenumber") % 3).alias("frame_idx"), c("l_extendedprice").alias("face_no"), (c("l_extendedprice") / 1000000).alias("coverage"), (c("l_partkey") % 100 / 100).alias("x"), (c("l_suppkey") % 10 / 10).alias("y"),
        (c("l_quantity") > 25).alias("in_focus"), (c("l_suppkey") % 3).alias("issues"), (c("l_partkey") % 4 > 0).alias("eyes_open"),
        c("_metadata.row_index").alias("row"), F.xxhash64("_metadata.file_path").bitwiseAND((1 << 62) - 1).alias("file"),
    )


def _faces_by_frame(s, d):
    """Of faces with equal coverage the first row of the table is primary: the price, which numbers the faces, gives their coverage too."""
    rows = _faces(s, d)
    return scoring.faces_by_frame(dealt(rows, rows.count(), "video_id", "frame_idx"), ("row", "file"))


_FACES_SQL = "fac AS (SELECT l_orderkey AS video_id, l_linenumber % 3 AS frame_idx, l_extendedprice AS face_no, l_extendedprice / 1000000 AS coverage, l_partkey % 100 / 100 AS x, l_suppkey % 10 / 10 AS y, l_quantity > 25 AS in_focus, l_suppkey % 3 AS issues, l_partkey % 4 > 0 AS eyes_open FROM lineitem)"
REGISTER.add(
    "primary_face", lambda s, d: scoring.primary_face(_faces(s, d)).select("video_id", "frame_idx", "face_no", "face_score"),
    """SELECT video_id, frame_idx, face_no, face_score FROM (SELECT *, coverage * 100 - 20 * (abs(x - 0.5) + abs(y - 0.4)) + CASE WHEN in_focus THEN 30 ELSE 0 END - 10 * issues + CASE WHEN eyes_open THEN 15 ELSE 0 END AS face_score FROM fac)
       QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY face_score DESC, face_no) = 1""", _FACES_SQL,
)
REGISTER.add(
    "faces_by_frame", _faces_by_frame,
    """SELECT video_id, frame_idx, count(*)::INT AS face_count, max(coverage) AS primary_face_coverage, count(*) FILTER (in_focus) AS faces_in_focus, bool_and(in_focus) AS all_faces_in_focus, NOT bool_and(eyes_open) AS any_eyes_closed,
       sum(issues)::BIGINT AS framing_issues_count, max_by(in_focus, coverage) AS primary_face_in_focus FROM fac GROUP BY ALL""", _FACES_SQL,
)


def _boxes(s, d):
    c, lit = F.col, F.lit
    rows = table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", (c("l_partkey") % 480).alias("x"), (c("l_suppkey") % 50 * 6).alias("y"), (c("l_quantity") * 2).alias("fw"), (c("l_quantity") * 2).alias("fh"), (c("l_discount") * 4).alias("headroom"), (c("l_partkey") % 100 / 100).alias("nx"),
        (c("l_quantity") * 4).alias("sharpness"), (c("l_suppkey") % 100 / 100).alias("ny"), (c("l_quantity") < 15).alias("soft"), (c("l_partkey") % 4 == 0).alias("closed"),
    )
    issues = scoring.face_issues(c("x"), c("y"), c("fw"), c("fh"), lit(480), lit(360), c("headroom"), c("nx"))
    rows = rows.withColumn("found", issues)
    place = F.concat_ws("-", scoring.thirds(c("ny"), "top", "middle", "bottom"), scoring.thirds(c("nx"), "left", "center", "right"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.array_join("found", ",").alias("issues"), scoring.issue_severity(c("found"), c("soft"), c("closed")).alias("severity"), scoring.face_focus(c("sharpness")).alias("focus"), place.alias("place"),
    )


REGISTER.add(
    "face_boxes", _boxes,
    """SELECT l_orderkey, l_linenumber, l_extendedprice, array_to_string(found, ',') AS issues,
       CASE WHEN len(list_filter(found, lambda i: starts_with(i, 'face_cut'))) > 0 OR (soft AND closed) THEN 'severe' WHEN soft OR closed THEN 'moderate' WHEN len(found) > 0 THEN 'minor' ELSE 'none' END AS severity,
       CASE WHEN 4 * l_quantity >= 150 THEN 'excellent' WHEN 4 * l_quantity >= 100 THEN 'good' WHEN 4 * l_quantity >= 60 THEN 'acceptable' WHEN 4 * l_quantity >= 40 THEN 'soft' ELSE 'blurry' END AS focus,
       CASE WHEN ny < 0.33 THEN 'top' WHEN ny > 0.66 THEN 'bottom' ELSE 'middle' END || '-' || CASE WHEN nx < 0.33 THEN 'left' WHEN nx > 0.66 THEN 'right' ELSE 'center' END AS place
       FROM (SELECT *, list_filter([CASE WHEN y < 10 THEN 'face_cut_top' END, CASE WHEN y + side > 350 THEN 'face_cut_bottom' END, CASE WHEN x < 10 THEN 'face_cut_left' END, CASE WHEN x + side > 470 THEN 'face_cut_right' END,
                    CASE WHEN l_discount * 4 < 0.03 THEN 'no_headroom' END, CASE WHEN l_discount * 4 > 0.3 THEN 'too_much_headroom' END, CASE WHEN nx < 0.2 OR nx > 0.8 THEN 'off_center' END], lambda i: i IS NOT NULL) AS found
             FROM (SELECT *, l_partkey % 480 AS x, l_suppkey % 50 * 6 AS y, 2 * l_quantity AS side, l_partkey % 100 / 100 AS nx, l_suppkey % 100 / 100 AS ny, l_quantity < 15 AS soft, l_partkey % 4 = 0 AS closed FROM lineitem))""",
)

# --- timelines --------------------------------------------------------------------------------
_PLACED_SQL = """placed AS (SELECT *, row_number() OVER w AS position, coalesce(sum(clip_length) OVER (PARTITION BY project_id ORDER BY filename, start_time, clip_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS began
    FROM clips WINDOW w AS (PARTITION BY project_id ORDER BY filename, start_time, clip_no))"""
_ITEMS_SQL = """SELECT project_id, clip_no, printf('<clipitem id="clip_%d"><name>%s</name><start>%d</start><end>%d</end><in>%d</in><out>%d</out>%s<labels><label2>%s</label2></labels></clipitem>', position, filename, trunc(began * 30)::BIGINT,
       trunc((began + clip_length) * 30)::BIGINT, trunc(clip_in * 30)::BIGINT, trunc(clip_out * 30)::BIGINT,
       CASE WHEN row_number() OVER (PARTITION BY project_id, filename ORDER BY position) = 1 THEN printf('<file id="%s"><name>%s</name><pathurl>file://localhost/%s</pathurl></file>', translate(filename, '. -', '___'), filename, filename)
            ELSE printf('<file id="%s"/>', translate(filename, '. -', '___')) END,
       CASE tier WHEN 'gold' THEN 'Forest' WHEN 'silver' THEN 'Iris' WHEN 'bronze' THEN 'Mango' ELSE 'Rose' END) AS item FROM placed"""
REGISTER.add(
    "clip_items", lambda s, d: timeline.clip_items(timeline.layout(_clips(s, d), "sequence")).select("project_id", "clip_no", "item"),
    _ITEMS_SQL, SEGMENTS_SQL, _CLIPS_SQL, _PLACED_SQL,
)


def _timeline_files(s, d):
    """Every project's document, written as a packed file and read back."""
    path = f"{shared_folder(s)}/timelines-{uuid.uuid4().hex}"
    clips = _clips(s, d).select("project_id", "filename", "start_time", "clip_no", "tier", "clip_in", "clip_out", "clip_length")
    timeline_files.write_timelines(timeline.layout(clips, "sequence").withColumn("path", F.col("filename")), path, compression="gzip")
    read = timeline_files.read_timelines(s, path).filter("kind = 'clip'")
    return read.select(F.regexp_extract("file", r"^p-(.*)\.xml$", 1).cast("long").alias("project_id"), F.col("text").alias("item"))


REGISTER.add("timeline_files", _timeline_files, _ITEMS_SQL.replace("clip_no, ", "", 1), SEGMENTS_SQL, _CLIPS_SQL, _PLACED_SQL)
REGISTER.add(
    "markers",
    lambda s, d: timeline.markers(timeline.layout(_clips(s, d), "sequence").select("*", (F.col("clip_no") % 13).cast("double").alias("motion"), (F.col("clip_no") % 29 * 5).cast("double").alias("sharpness"), (F.col("clip_no") % 20 / 20).alias("brightness"))).select("project_id", F.col("position").cast("int").alias("position"), "frame", "comment"),
    """SELECT project_id, position::INT AS position, trunc(began * 30)::INT AS frame, printf('%s %.1f · %s | motion %s | focus %s | light %s', upper(tier), score::DOUBLE, CASE tier WHEN 'gold' THEN 'Usar' WHEN 'silver' THEN 'Usable' WHEN 'bronze' THEN 'Revisar' ELSE 'Descartar' END,
       CASE WHEN m < 0.5 THEN 'none' WHEN m < 2 THEN 'slight' WHEN m < 5 THEN 'moderate' WHEN m < 10 THEN 'high' ELSE 'extreme' END, CASE WHEN f >= 100 THEN 'sharp' WHEN f >= 50 THEN 'soft' ELSE 'blurry' END,
       CASE WHEN b < 0.2 THEN 'very_dark' WHEN b < 0.35 THEN 'dark' WHEN b < 0.65 THEN 'normal' WHEN b < 0.8 THEN 'bright' ELSE 'very_bright' END) AS comment
       FROM (SELECT *, clip_no % 13 AS m, clip_no % 29 * 5 AS f, clip_no % 20 / 20 AS b FROM placed)""", SEGMENTS_SQL, _CLIPS_SQL, _PLACED_SQL,
)


def _scene_summary(s, d):
    rows = segments(s, d)
    groups = rows.groupBy("scene_group_id").agg(F.count(F.lit(1)).alias("size"), F.avg("coverage").alias("consistency"))
    return rollups.scene_summary(groups, rows.select(F.when(F.col("shot_type") == "TILT", "hard_cut").when(F.col("shot_type") == "PANEO", "soft_cut").alias("change_type")))


REGISTER.add(
    "scene_summary", _scene_summary,
    """SELECT count(*) AS groups, max(size) AS largest, min(size) AS smallest, avg(size) AS avg_size, avg(consistency) AS avg_consistency, any_value(hard) AS hard_cuts, any_value(soft) AS soft_cuts
       FROM (SELECT count(*) AS size, avg(coverage) AS consistency FROM seg GROUP BY scene_group_id), (SELECT count(*) FILTER (shot_type = 'TILT') AS hard, count(*) FILTER (shot_type = 'PANEO') AS soft FROM seg)""", SEGMENTS_SQL,
)
