"""Aggregations: metrics of a segment, statistics of videos, projects, scenes, takes and tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervalis.operators.ranking import ranked
from intervalis.operators.scoring import ladder
from intervalis.operators.search import tier_rank

TIERS = ("gold", "silver", "bronze", "discard")


def share(condition: Column) -> Column:
    """Percentage of the non-null rows that fulfil a condition."""
    return F.avg(condition.cast("int")) * 100


def segment_metrics(frames: DataFrame, keys: Sequence[str] = ("video_id", "segment_no")) -> DataFrame:
    """A segment's metrics from its frames: nulls don't count, and what no frame has takes its default."""
    spec = {
        "motion_mean": (F.avg("motion_magnitude"), 0.0), "motion_std": (F.stddev_pop("motion_magnitude"), 0.0), "motion_max": (F.max("motion_magnitude"), 0.0),
        "direction_mean": (F.avg("motion_direction"), 0.0), "direction_consistency": (F.avg("direction_consistency"), 0.0),
        "horizontal_component_mean": (F.avg("horizontal_component"), 0.0), "vertical_component_mean": (F.avg("vertical_component"), 0.0),
        "brightness_mean": (F.avg("brightness"), 0.5), "brightness_std": (F.stddev_pop("brightness"), 0.0), "contrast_mean": (F.avg("contrast"), 0.0),
        "dominant_frequency": (F.avg("dominant_frequency"), 0.0), "tremor_power": (F.avg("tremor_power"), 0.0),
        "sharpness_mean": (F.avg("sharpness"), 0.0), "sharpness_min": (F.min("sharpness"), 0.0), "sharpness_std": (F.stddev_pop("sharpness"), 0.0),
        "blurry_frame_pct": (share(F.col("is_blurry")), 0.0), "edge_density": (F.avg("edge_density"), 0.1),
        "avg_face_count": (F.avg("face_count"), 0.0), "avg_face_coverage": (F.avg("primary_face_coverage"), 0.0), "eyes_closed_frame_pct": (share(F.col("any_eyes_closed")), 0.0),
        "avg_framing_issues": (F.avg("framing_issues_count"), 0.0), "faces_in_focus_pct": (share(F.col("primary_face_in_focus")), 0.0),
        "camera_motion_mean": (F.avg("camera_motion"), 0.0), "object_motion_mean": (F.avg("object_motion"), 0.0), "motion_uniformity": (F.avg("motion_uniformity"), 0.0),
        "camera_shake_pct": (share(F.col("is_camera_shake")), 0.0), "any_eyes_closed_in_segment": (F.bool_or("any_eyes_closed"), False),
    }
    rows = frames.groupBy(*keys).agg(*(F.coalesce(agg, F.lit(default)).alias(name) for name, (agg, default) in spec.items()), F.count(F.lit(1)).alias("n_frames"))
    moved = F.col("horizontal_component_mean") + F.col("vertical_component_mean") + 0.001
    has_motion = F.col("horizontal_component_mean") + F.col("vertical_component_mean") > 0
    return (
        rows.withColumn("horizontal_dominance", F.when(has_motion, F.col("horizontal_component_mean") / moved).otherwise(0.5))
        .withColumn("vertical_dominance", F.when(has_motion, F.col("vertical_component_mean") / moved).otherwise(0.5))
        .withColumn("speed_consistency", 1 - F.col("motion_std") / (F.col("motion_mean") + 0.001))
        .withColumn("is_segment_blurry", F.col("blurry_frame_pct") > 50).withColumn("has_camera_shake", F.col("camera_shake_pct") > 30)
    )


def _sum_if(condition: Column, value: str = "duration") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0.0))


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.try_divide(part, whole) * 100).otherwise(0.0)


def tier_stats(segments: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Durations and percentages per tier, garbage outside their sum; usable and clean usable shares; counts."""
    tier = F.lower("tier")
    garbage = F.coalesce(F.col("is_garbage"), F.lit(False))
    rows = segments.groupBy(*keys).agg(
        *(_sum_if(tier == t).alias(f"{t}_duration") for t in TIERS), _sum_if(garbage).alias("garbage_duration"), F.count_if(garbage).alias("garbage_count"), F.count(F.lit(1)).alias("segment_count"),
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("all_duration"),
    )
    total = F.col("gold_duration") + F.col("silver_duration") + F.col("bronze_duration") + F.col("discard_duration")
    rows = rows.withColumn("analysed_duration", total)
    for t in TIERS:
        rows = rows.withColumn(f"{t}_pct", _pct(F.col(f"{t}_duration"), F.col("analysed_duration")))
    usable = F.col("gold_duration") + F.col("silver_duration")
    return rows.withColumn("usable_pct", F.col("gold_pct") + F.col("silver_pct")).withColumn("garbage_pct", _pct(F.col("garbage_duration"), F.col("all_duration"))).withColumn("clean_usable_pct", _pct(usable, F.col("all_duration") - F.col("garbage_duration")))


def shot_type_counts(segments: DataFrame, key: str = "video_id") -> DataFrame:
    counts = segments.groupBy(key, "shot_type").count()
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("shot_type", "count")))).alias("shot_types"))


def tier_ranges(segments: DataFrame) -> DataFrame:
    """Per video, the [start, end] list of each tier, the garbage tier too."""
    span = F.sort_array(F.collect_list(F.struct(F.col("start_time").alias("start"), F.col("end_time").alias("end"))))
    return segments.groupBy("video_id").pivot("tier", [*TIERS, "garbage"]).agg(span)


def garbage_rollup(segments: DataFrame) -> DataFrame:
    """Garbage durations and counts in total, by type and by video, as grouping sets; total_pct and advice on the total."""
    rows = segments.withColumn("is_garbage", F.coalesce("is_garbage", F.lit(False)))
    everything = rows.agg(F.sum("duration").alias("all_duration"))
    sets = rows.filter("is_garbage").groupingSets([[], ["garbage_type"], ["video_id"]], "garbage_type", "video_id").agg(F.coalesce(F.sum("duration"), F.lit(0.0)).alias("duration"), F.count(F.lit(1)).alias("count"), F.grouping_id().alias("level"))
    pct = _pct(F.col("duration"), F.col("all_duration"))
    advice = F.when(F.col("level") == 3, ladder((pct > 10, "high"), (pct > 0, "some"), otherwise="none"))
    return sets.crossJoin(F.broadcast(everything)).select("level", "garbage_type", "video_id", "duration", "count", F.when(F.col("level") == 3, pct).alias("total_pct"), advice.alias("advice"))


def garbage_summary(detections: DataFrame) -> DataFrame:
    """Per video: total, count, recoverable seconds, distinct types and a note."""
    length = F.col("end_time") - F.col("start_time")
    rows = detections.groupBy("video_id").agg(F.sum(length).alias("total"), F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.when(F.col("recoverable"), length)), F.lit(0.0)).alias("recoverable"), F.array_sort(F.collect_set("kind")).alias("types"))
    return rows.withColumn("note", ladder((F.col("total") > 5, "much"), (F.col("recoverable") > 0, "recoverable"), otherwise="little"))


def framing_stats(segments: DataFrame) -> DataFrame:
    return segments.groupBy("framing_type").agg(
        F.count(F.lit(1)).alias("count"), F.sum("duration").alias("duration"), F.coalesce(F.sum("face_count"), F.lit(0)).alias("faces"), F.count_if(F.col("face_count") > 0).alias("with_faces")
    )


def face_stats(segments: DataFrame) -> DataFrame:
    """Share of segments with faces (one decimal), average count (two), and counts by coverage."""
    cover = F.coalesce(F.col("coverage"), F.lit(0.0))
    faces = F.col("face_count") > 0
    return segments.agg(
        F.count(F.lit(1)).alias("segments"), F.bround(F.avg(faces.cast("int")) * 100, 1).alias("with_faces_pct"), F.bround(F.avg("face_count"), 2).alias("avg_faces"),
        *(F.count_if(faces & (cover >= low) & (cover < high)).alias(name) for name, low, high in (("tiny", 0.0, 0.02), ("small", 0.02, 0.05), ("medium", 0.05, 0.15), ("large", 0.15, 0.30), ("huge", 0.30, 1e9))),
    )


def face_histogram(segments: DataFrame) -> DataFrame:
    return segments.groupBy(F.coalesce("face_count", F.lit(0)).alias("face_count")).agg(F.count(F.lit(1)).alias("segments"))


def by_framing(segments: DataFrame) -> DataFrame:
    """Segments with their place in their framing type, best first: a framing type's list in order, as rows, whatever its length."""
    thin = segments.select("framing_type", "video_id", "index", "score")
    return ranked(thin, ["framing_type"], [F.desc("score"), F.asc("video_id"), F.asc("index")])


def repeated_stats(segments: DataFrame) -> DataFrame:
    return segments.filter("is_repeated_take").agg(F.count(F.lit(1)).alias("repeated"), F.bround(F.coalesce(F.sum("duration"), F.lit(0.0)), 2).alias("duration"))


def tag_frequency(segments: DataFrame, column: str = "tags") -> DataFrame:
    """(tag, count), the commonest first; ties by name."""
    return segments.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "tag")


def tags_by_category(tagged: DataFrame) -> DataFrame:
    """Counts by category and tag, as one map for each category."""
    counts = tagged.select(F.explode("tag_structs").alias("t")).groupBy(F.col("t.category").alias("category"), F.col("t.name").alias("name")).count()
    return counts.groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "count")))).alias("counts"), F.sum("count").alias("total"))


def scene_summary(groups: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: number and sizes of scene groups, their consistency, and changes by kind."""
    sizes = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("size").alias("largest"), F.min("size").alias("smallest"), F.avg("size").alias("avg_size"), F.avg("consistency").alias("avg_consistency"))
    kinds = changes.agg(F.count_if(F.col("change_type") == "hard_cut").alias("hard_cuts"), F.count_if(F.col("change_type") == "soft_cut").alias("soft_cuts"))
    return sizes.crossJoin(kinds)  # two one-row tables


def scene_tiers(segments: DataFrame) -> DataFrame:
    """Per scene: tier counts as a map, and the best tier by rank."""
    counts = segments.groupBy("scene_group_id", F.lower("tier").alias("tier")).count()
    return counts.groupBy("scene_group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "count")))).alias("tiers"), F.max_by("tier", tier_rank(F.col("tier"), 0)).alias("best_tier"))


def take_summary(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("take_count") - 1), F.lit(0)).alias("repeated"), F.bround(F.coalesce(F.sum("discard_duration"), F.lit(0.0)), 1).alias("savings"),
        F.coalesce(F.avg("take_count"), F.lit(0.0)).alias("avg_takes"),
    )


def common_rate(videos: DataFrame, default: float = 30.0) -> DataFrame:
    """The most frequent positive fps; the one first seen (by pos) among ties."""
    best = videos.filter("fps > 0").groupBy("fps").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    top = best.agg(F.max(F.struct("n", (-F.col("first_pos")).alias("p"), "fps"))["fps"].alias("fps"))
    return top.select(F.coalesce("fps", F.lit(default)).alias("fps"))


def scene_list(segments: DataFrame) -> DataFrame:
    return segments.filter("scene_group_id is not null").groupBy("scene_group_id").agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("video_id").alias("videos")).orderBy(F.desc("segments"), "scene_group_id")


def distinct_tags(segments: DataFrame, column: str = "tags") -> DataFrame:
    return segments.select(F.explode(column).alias("tag")).distinct().orderBy("tag")


def video_cards(segments: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """All figures of a video's card in one aggregation."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    tier = F.lower("tier")
    return segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("segments"), _sum_if(tier == "gold").alias("gold_duration"), _sum_if(tier == "silver").alias("silver_duration"), F.max("file_duration").alias("file_duration"),
        F.bround(_pct(_sum_if(tier.isin("gold", "silver")), F.max("file_duration"))).alias("usable_pct"), F.count_if(yes("is_best_take")).alias("best_takes"), F.count_if(yes("is_repeated_take")).alias("repeated_takes"),
        F.coalesce(F.sum("take_alternatives"), F.lit(0)).alias("alternatives"), F.count_if(yes("is_key_moment")).alias("key_moments"), F.count_if(yes("is_garbage")).alias("garbage"), _sum_if(yes("is_garbage")).alias("garbage_duration"),
        F.countDistinct("scene_group_id").alias("scenes"), _sum_if(F.col("face_count") > 0).alias("face_duration"), F.coalesce(F.max("face_count"), F.lit(0)).alias("max_faces"),
    )


def export_preview(segments: DataFrame) -> DataFrame:
    """Clips and seconds per tier with the totals of all tiers (tier null) and the number of distinct videos."""
    return segments.withColumn("tier", F.lower("tier")).rollup("tier").agg(F.count(F.lit(1)).alias("clips"), F.sum("duration").alias("duration"), F.countDistinct("video_id").alias("videos"), F.grouping("tier").alias("is_total"))


def detections_by_video(detections: DataFrame) -> DataFrame:
    return detections.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start_time", "end_time", "kind"))).alias("detections"), F.array_sort(F.collect_set("kind")).alias("types_found"))


def project_totals(projects: DataFrame, added: DataFrame) -> DataFrame:
    """Registry totals with those of newly added analyses, whose ids are appended once."""
    both = projects.select("project_id", "videos", "duration", "analysis_ids").unionByName(added.select("project_id", "videos", "duration", "analysis_ids"))
    return both.groupBy("project_id").agg(F.sum("videos").alias("videos"), F.sum("duration").alias("duration"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("analysis_ids")))).alias("analysis_ids"))


# --- top k ------------------------------------------------------------------------------------


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def recent_distinct(events: DataFrame, key: str, ts: str, k: int = 5) -> DataFrame:
    """The k values last seen, latest first."""
    return events.groupBy(key).agg(F.max(ts).alias("last_seen")).orderBy(F.desc("last_seen"), key).limit(k)
