"""The domain's tables, read from the star schema and the event stream.

``segments``: order lines as segments of their order's video; ``frames``:
events as frames of their user's video. Each view has its SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervalis.operators.scoring import ladder, tier_of
from intervalis.plans.scratch import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, index, start_time, end_time, duration, score, tier, shot_type, framing_type, face_count, coverage, flags, tags, metrics."""
    c, q = F.col, F.col("l_quantity")
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    end = F.sum("l_quantity").over(along.rowsBetween(Window.unboundedPreceding, 0))
    garbage = c("l_discount") >= 0.09
    score = q / 5
    framing = ladder((c("l_partkey") % 4 == 0, "PRIMER_PLANO"), (c("l_partkey") % 4 == 1, "PLANO_MEDIO"), (c("l_partkey") % 4 == 2, "PLANO_GENERAL"), otherwise="DESCONOCIDO")
    some = lambda when, tag: F.when(when, F.array(F.lit(tag))).otherwise(F.array().cast("array<string>"))
    flag = F.when(c("l_returnflag").isNotNull(), F.array(F.lower("l_returnflag"))).otherwise(F.array().cast("array<string>"))
    tags = F.concat(flag, some(c("l_linestatus") == "O", "open"), some(q > 40, "long"), some(c("l_partkey") % 3 == 0, "persona"), some(c("l_partkey") % 7 == 0, "entrevista"))
    lines = table(spark, sf_dir, "lineitem")
    return dealt(lines, lines.count(), "l_orderkey").select(
        c("l_orderkey").alias("video_id"), F.row_number().over(along).cast("long").alias("index"), (end - q).alias("start_time"), end.alias("end_time"), q.alias("duration"), score.alias("score"),
        F.when(garbage, "garbage").otherwise(tier_of(score)).alias("tier"), ladder((c("l_returnflag") == "A", "ESTATICA"), (c("l_returnflag") == "N", "PANEO"), otherwise="TILT").alias("shot_type"),
        framing.alias("framing_type"), (c("l_suppkey") % 4).cast("int").alias("face_count"), (c("l_tax") * 4).alias("coverage"), (c("l_suppkey") % 10).alias("scene_group_id"), garbage.alias("is_garbage"),
        F.when(garbage, F.when(c("l_returnflag") == "A", "lens_cap").otherwise("sky_shot")).alias("garbage_type"), (c("l_tax") >= 0.08).alias("is_key_moment"),
        F.when(c("l_linenumber") > 4, None).otherwise(c("l_linenumber") == 1).alias("is_best_take"), (c("l_linenumber").isin(2, 3)).alias("is_repeated_take"),
        F.when(c("l_linenumber") <= 3, (c("l_orderkey") % 5)).alias("take_group_id"), F.concat(F.lit("clip_"), c("l_orderkey"), F.lit(".mp4")).alias("filename"), tags.alias("tags"),
        F.struct((c("l_discount") * 10).alias("brightness_mean"), (c("l_tax") * 10).alias("contrast_mean"), F.lit(0.0).alias("brightness_std"), (q * 5).alias("sharpness_mean"), (q / 10).alias("motion_mean"), (c("l_tax") * 20).alias("motion_std"), (c("l_discount") * 3).alias("edge_density")).alias("metrics"),
        F.struct((c("l_suppkey") % 4 > 0).alias("has_faces"), (c("l_suppkey") % 4).cast("double").alias("avg_face_count"), (c("l_tax") * 4).alias("primary_face_coverage"), (c("l_linenumber") % 2).cast("double").alias("avg_framing_issues")).alias("face_analysis"),
    )


SEGMENTS_SQL = """seg AS (
    SELECT l_orderkey AS video_id, i::BIGINT AS index, e - l_quantity AS start_time, e AS end_time, l_quantity AS duration, l_quantity / 5 AS score,
           CASE WHEN l_discount >= 0.09 THEN 'garbage' WHEN l_quantity / 5 >= 8 THEN 'gold' WHEN l_quantity / 5 >= 6 THEN 'silver' WHEN l_quantity / 5 >= 4 THEN 'bronze' ELSE 'discard' END AS tier,
           CASE l_returnflag WHEN 'A' THEN 'ESTATICA' WHEN 'N' THEN 'PANEO' ELSE 'TILT' END AS shot_type,
           CASE l_partkey % 4 WHEN 0 THEN 'PRIMER_PLANO' WHEN 1 THEN 'PLANO_MEDIO' WHEN 2 THEN 'PLANO_GENERAL' ELSE 'DESCONOCIDO' END AS framing_type,
           (l_suppkey % 4)::INT AS face_count, l_tax * 4 AS coverage, l_suppkey % 10 AS scene_group_id, l_discount >= 0.09 AS is_garbage,
           CASE WHEN l_discount >= 0.09 THEN CASE WHEN l_returnflag = 'A' THEN 'lens_cap' ELSE 'sky_shot' END END AS garbage_type, l_tax >= 0.08 AS is_key_moment,
           CASE WHEN l_linenumber <= 4 THEN l_linenumber = 1 END AS is_best_take, l_linenumber IN (2, 3) AS is_repeated_take, CASE WHEN l_linenumber <= 3 THEN l_orderkey % 5 END AS take_group_id,
           'clip_' || l_orderkey || '.mp4' AS filename,
           list_filter([lower(l_returnflag), CASE WHEN l_linestatus = 'O' THEN 'open' END, CASE WHEN l_quantity > 40 THEN 'long' END, CASE WHEN l_partkey % 3 = 0 THEN 'persona' END, CASE WHEN l_partkey % 7 = 0 THEN 'entrevista' END], lambda t: t IS NOT NULL) AS tags,
           l_discount * 10 AS brightness, l_tax * 10 AS contrast, l_quantity * 5 AS sharpness, l_quantity / 10 AS motion, l_tax * 20 AS motion_std, l_discount * 3 AS edges, (l_linenumber % 2)::DOUBLE AS issues
    FROM (SELECT *, row_number() OVER w AS i, sum(l_quantity) OVER w AS e FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame_idx, timestamp (seconds of the month) and metrics; metrics of some rows are null."""
    v, kind = F.col("value"), F.col("event_type")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    flag = lambda name: (kind == name)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("frame_idx"), seconds.alias("timestamp"), (v / 50).alias("motion_magnitude"), (F.col("event_id") % 7).cast("double").alias("motion_direction"),
        F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 10) / 10).alias("direction_consistency"), (v / 500).alias("brightness"), (v / 5).alias("variance"), (v / 1000).alias("edge_density"), (v / 3).alias("sharpness"),
        (v < 60).alias("is_blurry"), F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 3).cast("int")).alias("face_count"),
        F.struct(flag("error").alias("is_black"), flag("signup").alias("is_uniform"), F.lit(False).alias("is_white"), F.lit(False).alias("is_lens_cap"), flag("view").alias("is_likely_sky"), flag("click").alias("is_likely_ground")).alias("garbage_flags"),
        kind.alias("event_type"),
    )


FRAMES_SQL = """frm AS (
    SELECT user_id::VARCHAR AS video_id, event_id AS frame_idx, epoch_us(ts) / 1e6 - 1704067200 AS timestamp, value / 50 AS motion, (event_id % 7)::DOUBLE AS direction,
           CASE WHEN event_id % 5 > 0 THEN (event_id % 10) / 10 END AS consistency, value / 500 AS brightness, value / 5 AS variance, value / 1000 AS edges, value / 3 AS sharpness,
           value < 60 AS is_blurry, CASE WHEN event_id % 5 = 0 THEN (event_id % 3)::INT END AS face_count, event_type
    FROM events)"""


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint features from embeddings: 20 vectors make a video."""
    e = F.col("embedding")
    at = lambda k: F.abs(e[k].cast("double"))
    scaled = lambda k: F.least(at(k) * 4, F.lit(1.0))
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 20).alias("video_id"), F.col("vec_id").alias("index"), (F.col("vec_id") % 20 * 15).cast("double").alias("start_time"), (at(3) * 20 + 1).alias("duration"), scaled(0).alias("brightness"), scaled(1).alias("contrast"),
        scaled(2).alias("edge_density"), (at(4) * 500).alias("sharpness"), (at(5) * 10).alias("motion"), F.when(F.col("label") % 2 == 0, "PLANO_MEDIO").otherwise("DESCONOCIDO").alias("framing_type"), (F.col("label") % 3).alias("scene_group_id"),
        (F.col("label") % 2).cast("int").alias("face_count"), at(6).alias("coverage"), (at(7) * 30).alias("score"), F.lit("silver").alias("tier"), F.lit(False).alias("is_garbage"),
    )


FEATURES_SQL = """fea AS (
    SELECT vec_id // 20 AS video_id, vec_id AS index, (vec_id % 20 * 15)::DOUBLE AS start_time, abs(embedding[4]::DOUBLE) * 20 + 1 AS duration, least(abs(embedding[1]::DOUBLE) * 4, 1.0) AS brightness, least(abs(embedding[2]::DOUBLE) * 4, 1.0) AS contrast,
           least(abs(embedding[3]::DOUBLE) * 4, 1.0) AS edges, abs(embedding[5]::DOUBLE) * 500 AS sharpness, abs(embedding[6]::DOUBLE) * 10 AS motion, CASE WHEN label % 2 = 0 THEN 'PLANO_MEDIO' ELSE 'DESCONOCIDO' END AS framing_type, label % 3 AS scene_group_id,
           (label % 2)::INT AS face_count, abs(embedding[7]::DOUBLE) AS coverage, abs(embedding[8]::DOUBLE) * 30 AS score
    FROM embeddings)"""
