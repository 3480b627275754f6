"""Timeline layouts: where each clip lies on its track, and the rows and rules of the XML that carries them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervalis.functions.scalars import clip_text, file_url, frames, plain_id, xml_escape
from intervalis.operators.ranking import running
from intervalis.operators.search import tier_rank
from intervalis.plans.scratch import dealt
from intervalis.schemas import TIER_LABEL

TRACKS = ("gold", "silver", "bronze", "discard")
FRAME_RATES = (23.976, 24, 25, 29.97, 30, 48, 50, 59.94, 60)


def with_handles(clips: DataFrame, handle: float) -> DataFrame:
    """``clips`` with clip_in, clip_out and clip_length: widened on both sides, within the file where its duration is known."""
    out = F.col("end_time") + handle
    out = F.when(F.coalesce(F.col("file_duration"), F.lit(0.0)) > 0, F.least("file_duration", out)).otherwise(out)
    rows = clips.withColumn("clip_in", F.greatest(F.lit(0.0), F.col("start_time") - handle)).withColumn("clip_out", out)
    return rows.withColumn("clip_length", F.col("clip_out") - F.col("clip_in"))


def ordering(by: str) -> list[Column]:
    keys = {
        "time": [F.asc("filename"), F.asc("start_time")], "quality": [tier_rank(F.col("tier"), 0).desc(), F.asc("filename"), F.asc("start_time")],
        "shot_type": [F.asc("shot_type"), F.asc("filename"), F.asc("start_time")],
    }
    return [*keys[by], F.asc("clip_no")]


def _running(clips: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rows = running(clips, keys, order, "clip_length", "position", "timeline_start").withColumn("position", F.col("position").cast("int"))
    return rows.withColumn("timeline_end", F.col("timeline_start") + F.col("clip_length"))


def layout(clips: DataFrame, mode: str = "sequence", by: str = "time", key: str = "project_id") -> DataFrame:
    """``clips`` (with handles) placed on each project's timeline.

    sequence: one track, one after the other; by_tier: a track and a running
    time for each tier; tracks: a track for each tier, one running time across
    them; original: the file's own times.
    """
    rows = clips.withColumn("track", F.array_position(F.array(*map(F.lit, TRACKS)), F.lower("tier")) if mode != "sequence" else F.lit(1).cast("long"))
    if mode == "sequence":
        return _running(rows, [key], ordering(by))
    if mode == "by_tier":
        return _running(rows, [key, "track"], ordering("time"))
    if mode == "tracks":
        return _running(rows, [key], ordering("quality"))
    if mode == "original":
        placed = _running(rows, [key], ordering("time"))
        return placed.withColumn("timeline_start", F.col("clip_in")).withColumn("timeline_end", F.col("clip_out"))
    raise ValueError(f"unknown layout: {mode}")


def video_offsets(videos: DataFrame, key: str = "project_id") -> DataFrame:
    """``videos`` with timeline_offset: the durations of those before, by file name."""
    along = Window.partitionBy(key).orderBy("filename").rowsBetween(Window.unboundedPreceding, -1)
    return videos.withColumn("timeline_offset", F.coalesce(F.sum("duration").over(along), F.lit(0.0)))


def at_original_position(clips: DataFrame, videos: DataFrame, key: str = "project_id") -> DataFrame:
    """Clips at their files' offsets on one timeline of all files."""
    rows = clips.join(video_offsets(videos, key).select(key, "filename", "timeline_offset"), [key, "filename"])
    return rows.withColumn("timeline_start", F.col("timeline_offset") + F.col("start_time")).withColumn("timeline_end", F.col("timeline_offset") + F.col("end_time"))


def file_definitions(clips: DataFrame, key: str = "project_id") -> DataFrame:
    """``clips`` with defines_file: whether a clip is the first of its file, and so carries its definition."""
    first = Window.partitionBy(key, "file_id").orderBy("track", "position")
    rows = dealt(clips.withColumn("file_id", plain_id(F.col("filename"))), clips.count(), key, "file_id")
    return rows.withColumn("defines_file", F.row_number().over(first) == 1)


def labels(tier: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in TIER_LABEL.items() for x in kv)), F.lower(tier))


def clip_element(fps: float = 30.0) -> Column:
    """The XML element of a clip that ``file_definitions`` has marked, in frames."""
    at = lambda c: frames(F.col(c), fps, "long")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    file_id, name = xml_escape(F.col("file_id")), xml_escape(F.col("filename"))
    full = said('<file id="', file_id, '"><name>', name, "</name><pathurl>", xml_escape(file_url(F.col("path"))), "</pathurl></file>")
    file = F.when(F.col("defines_file"), full).otherwise(said('<file id="', file_id, '"/>'))
    return said(
        '<clipitem id="clip_', F.col("position"), '"><name>', name, "</name><start>", at("timeline_start"), "</start><end>", at("timeline_end"), "</end><in>", at("clip_in"), "</in><out>", at("clip_out"), "</out>",
        file, "<labels><label2>", labels(F.col("tier")), "</label2></labels></clipitem>",
    )


def clip_items(placed: DataFrame, fps: float = 30.0) -> DataFrame:
    """One XML clip element for each placed clip, in frames; a file is defined once and referred to after."""
    return file_definitions(placed).withColumn("item", clip_element(fps))


def sequence_xml(placed: DataFrame, fps: float = 30.0, key: str = "project_id") -> DataFrame:
    """(project, xml): the document of each project's timeline as one value, for projects of some thousand clips; of any others see ``sequence_parts``."""
    items = clip_items(placed, fps)
    tracks = items.groupBy(key, "track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timeline_start", "position", "item"))), lambda x: x["item"]), "").alias("items"), F.max("timeline_end").alias("ends"))
    both = tracks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("track", "items"))).alias("tracks"), F.max("ends").alias("ends"))
    body = F.array_join(F.transform("tracks", lambda t: F.concat(F.lit("<track>"), t["items"], F.lit("</track>"))), "")
    return both.select(key, F.concat(_head(key, fps), body, F.lit(_TAIL)).alias("xml"))


_TAIL = "</video></media></sequence></xmeml>"


def _head(key: str, fps: float) -> Column:
    return F.format_string('<xmeml version="4"><sequence id="%s"><duration>%d</duration><rate><timebase>%d</timebase></rate><media><video>', F.col(key), frames(F.col("ends"), fps, "long"), F.lit(int(round(fps))))


def sequence_parts(placed: DataFrame, fps: float = 30.0, key: str = "project_id") -> DataFrame:
    """(project, track, step, timeline_start, position, text): each project's document in pieces, a row a clip.

    The texts in the order of track, step, timeline_start and position are ``sequence_xml``'s, whatever the project's
    length: no task holds a project. The head comes before and the end after all tracks.
    """
    tracks = placed.groupBy(key, "track").agg(F.max("timeline_end").alias("ends"))
    projects = tracks.groupBy(key).agg(F.max("ends").alias("ends"))
    place = ("track", "step", "timeline_start", "position")

    def piece(rows: DataFrame, *steps: tuple[Column, int, Column | str]) -> DataFrame:
        made = F.array(*(F.struct(t.cast("long").alias("track"), F.lit(n).alias("step"), (F.lit(text) if isinstance(text, str) else text).alias("text")) for t, n, text in steps))
        return rows.select(key, F.inline(made)).withColumns({"timeline_start": F.lit(None).cast("double"), "position": F.lit(None).cast("int")})

    ends = piece(projects, (F.lit(-(1 << 62)), -1, _head(key, fps)), (F.lit(1 << 62), 3, _TAIL))
    borders = piece(tracks, (F.col("track"), 0, "<track>"), (F.col("track"), 2, "</track>"))
    items = clip_items(placed, fps).select(key, F.col("track").cast("long").alias("track"), F.lit(1).alias("step"), "timeline_start", "position", F.col("item").alias("text"))
    return items.unionByName(borders).unionByName(ends).select(key, *place, "text")


def markers(placed: DataFrame, fps: float = 30.0) -> DataFrame:
    """Marker rows by their time on the timeline."""
    text = clip_text(F.col("tier"), F.col("score"), F.col("motion"), F.col("sharpness"), F.col("brightness"))
    return placed.select("project_id", "position", frames(F.col("timeline_start"), fps).alias("frame"), text.alias("comment")).orderBy("project_id", "frame", "position")


def check_sequences(items: DataFrame, key: str = "project_id") -> DataFrame:
    """Errors of each clip row: bad id, empty range, unusual rate, a file defined twice."""
    twice = Window.partitionBy(key, "file_id")
    defined = F.count_if("defines_file").over(twice)
    rules = [
        (~F.col("file_id").rlike(r"^[a-zA-Z0-9_-]+$"), "bad_id"), (F.col("clip_out") <= F.col("clip_in"), "empty_range"), (~F.col("fps").isin(*FRAME_RATES), "unusual_rate"),
        (F.col("defines_file") & (defined > 1), "defined_twice"),
    ]
    return items.withColumn("errors", F.filter(F.array(*(F.when(c, name) for c, name in rules)), lambda e: e.isNotNull()))


def report_rows(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """Figures of the report: each segment's share of its video in percent, and the video's usable share."""
    usable = segments.groupBy("video_id").agg(F.sum(F.when(F.lower("tier").isin("gold", "silver"), F.col("duration")).otherwise(0.0)).alias("usable"))
    rows = segments.join(videos.select("video_id", F.col("duration").alias("video_duration")), "video_id").join(usable, "video_id")
    pct = lambda x: F.when(F.col("video_duration") > 0, F.try_divide(x, F.col("video_duration")) * 100).otherwise(0.0)
    return rows.select("video_id", "index", "tier", pct(F.col("duration")).alias("width_pct"), pct(F.col("usable")).alias("usable_pct"))
