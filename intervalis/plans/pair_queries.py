"""Pair similarity, groups, representatives and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from intervalis.operators import similarity as X
from intervalis.operators.rollups import repeated_stats, take_summary
from intervalis.operators.timeseries import scene_changes
from intervalis.plans.register import Register
from intervalis.plans.views import FEATURES_SQL, feature_rows, table

REGISTER = Register()
_VISUAL = """(0.25 * (1 - abs(a.brightness - b.brightness)) + 0.15 * (1 - abs(a.contrast - b.contrast)) + 0.2 * (1 - least(1.0, 5 * abs(a.edges - b.edges))) + 0.2 * (1 - least(1.0, abs(a.sharpness - b.sharpness) / 200)) + 0.2 * (1 - least(1.0, abs(a.motion - b.motion) / 5)))"""
_PAIRS_SQL = f"""raw AS (SELECT a.video_id, a.index AS segment_a, b.index AS segment_b, {_VISUAL} AS v, CASE WHEN least(a.duration, b.duration) / greatest(a.duration, b.duration) >= 0.75 THEN 1 ELSE least(a.duration, b.duration) / greatest(a.duration, b.duration) END AS l,
        (a.framing_type = b.framing_type AND a.framing_type <> 'DESCONOCIDO')::INT AS f, (a.scene_group_id = b.scene_group_id)::INT AS s,
        CASE WHEN a.face_count = 0 AND b.face_count = 0 THEN 1.0 WHEN a.face_count = 0 OR b.face_count = 0 THEN 0.3 ELSE (1.0 + CASE WHEN greatest(a.coverage, b.coverage) > 0 THEN least(a.coverage, b.coverage) / greatest(a.coverage, b.coverage) ELSE 1 END) / 2 END AS c
        FROM fea a JOIN fea b ON a.video_id = b.video_id AND a.index < b.index AND abs(a.start_time - b.start_time) >= 10),
    sim AS (SELECT *, least(1.0, greatest(0.0, 0.45 * v + 0.15 * l + 0.15 * f + 0.15 * s + 0.1 * c)) AS similarity, least(1.0, 0.3 + CASE WHEN v > 0.8 THEN 0.25 WHEN v > 0.6 THEN 0.15 ELSE 0 END + CASE WHEN l > 0.9 THEN 0.15 WHEN l > 0.7 THEN 0.1 ELSE 0 END + 0.15 * f + 0.15 * s) AS confidence FROM raw),
    pairs AS (SELECT *, CASE WHEN similarity >= 0.9 THEN 'same_take' WHEN similarity >= 0.85 THEN 'repeated_take' ELSE 'similar_shot' END AS relation FROM sim WHERE similarity >= 0.6 AND confidence >= 0.699999)"""


def _pairs(s, d):
    return X.take_pairs(feature_rows(s, d), sure=0.699999)


REGISTER.add("take_pairs", lambda s, d: _pairs(s, d).select("segment_a", "segment_b", F.bround("similarity", 9).alias("similarity"), "relation"), "SELECT segment_a, segment_b, round(similarity::DOUBLE, 9) AS similarity, relation FROM pairs", FEATURES_SQL, _PAIRS_SQL)


def _linked(s, d):
    return _pairs(s, d).withColumn("relation", F.when(F.col("similarity") >= 0.75, "same_take").otherwise(F.col("relation")))


_REACH = """hop AS (SELECT segment_a AS a, segment_b AS b FROM pairs WHERE similarity >= 0.75 UNION SELECT segment_b, segment_a FROM pairs WHERE similarity >= 0.75),
    reach(a, b) AS (SELECT DISTINCT a, a FROM hop UNION SELECT r.a, h.b FROM reach r JOIN hop h ON h.a = r.b), roots AS (SELECT a AS index, min(b) AS root FROM reach GROUP BY a)"""


def _groups(s, d):
    return X.take_groups(feature_rows(s, d), _linked(s, d))


REGISTER.add(
    "take_groups", lambda s, d: _groups(s, d).select("index", F.col("group_id").cast("int").alias("group_id"), "take_count", "best_take", "is_best"),
    f"""WITH RECURSIVE {FEATURES_SQL}, {_PAIRS_SQL}, {_REACH}
        SELECT index, (dense_rank() OVER (PARTITION BY video_id ORDER BY root) - 1)::INT AS group_id, count(*) OVER g AS take_count, arg_max(index, (score, -index)) OVER g AS best_take, index = arg_max(index, (score, -index)) OVER g AS is_best
        FROM roots JOIN fea USING (index) WINDOW g AS (PARTITION BY video_id, root)""",
)
REGISTER.add(
    "take_summary", lambda s, d: take_summary(_groups(s, d).select("video_id", "group_id", "take_count", "discard_duration").distinct()).select("groups", "repeated", "avg_takes"),
    f"WITH RECURSIVE {FEATURES_SQL}, {_PAIRS_SQL}, {_REACH} SELECT count(*) AS groups, sum(n - 1)::BIGINT AS repeated, avg(n) AS avg_takes FROM (SELECT video_id, root, count(*) AS n FROM roots JOIN fea USING (index) GROUP BY ALL)",
)
REGISTER.add("flagged_takes", lambda s, d: X.recommend(X.flag_takes(feature_rows(s, d), _groups(s, d))).groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_repeated_take").alias("repeated")),
    f"""WITH RECURSIVE {FEATURES_SQL}, {_PAIRS_SQL}, {_REACH}, top AS (SELECT index, index <> arg_max(index, (score, -index)) OVER (PARTITION BY video_id, root) AS repeated FROM roots JOIN fea USING (index))
        SELECT CASE WHEN coalesce(repeated, false) THEN 'skip' ELSE 'use' END AS recommendation, count(*) AS n, count(*) FILTER (coalesce(repeated, false)) AS repeated FROM fea LEFT JOIN top USING (index) GROUP BY 1""")  # fmt: skip
REGISTER.add("repeated_after_flags", lambda s, d: repeated_stats(X.flag_takes(feature_rows(s, d), _groups(s, d))).select("repeated"),
    f"WITH RECURSIVE {FEATURES_SQL}, {_PAIRS_SQL}, {_REACH} SELECT count(*) - count(DISTINCT (video_id, root)) AS repeated FROM roots JOIN fea USING (index)")


def _hist(bins: int, value: str) -> str:
    """SQL of the Pearson correlation of the bell histograms around the bins of two values."""
    return f"""(SELECT CASE WHEN var_pop(x) * var_pop(y) > 0 THEN corr(x, y) ELSE 1 END FROM (SELECT exp(-power(i - least({bins - 1}, greatest(0, trunc(a.{value} * {bins - 1}))), 2) / {bins / 4}) AS x, exp(-power(i - least({bins - 1}, greatest(0, trunc(b.{value} * {bins - 1}))), 2) / {bins / 4}) AS y FROM (SELECT unnest(range({bins})) AS i)))"""


_DISTANCE = f"""(0.25 * (1 - {_hist(32, "brightness")}) + 0.15 * (1 - {_hist(16, "contrast")}) + 0.25 * (1 - {_hist(16, "brightness")}) + 0.25 * abs(a.brightness - b.brightness) + 0.1 * abs(a.edges - b.edges))"""
_SCENE_SQL = f"dist AS (SELECT a.video_id, a.index AS segment_a, b.index AS segment_b, {_DISTANCE} AS distance FROM fea a JOIN fea b ON a.video_id = b.video_id AND a.index < b.index)"
REGISTER.add("scene_pairs", lambda s, d: X.scene_pairs(feature_rows(s, d)).select("segment_a", "segment_b", F.bround("distance", 7).alias("distance")), "SELECT segment_a, segment_b, round(distance, 7) AS distance FROM dist", FEATURES_SQL, _SCENE_SQL)
REGISTER.add(
    "scene_groups", lambda s, d: X.scene_groups(feature_rows(s, d)).select("index", F.col("group_id").cast("int").alias("group_id"), "size", F.bround("avg_brightness", 7).alias("avg_brightness")),
    f"""WITH RECURSIVE {FEATURES_SQL}, {_SCENE_SQL}, hop AS (SELECT segment_a AS a, segment_b AS b FROM dist WHERE distance < 0.25 UNION SELECT segment_b, segment_a FROM dist WHERE distance < 0.25),
        reach(a, b) AS (SELECT index, index FROM fea UNION SELECT r.a, h.b FROM reach r JOIN hop h ON h.a = r.b), roots AS (SELECT a AS index, min(b) AS root FROM reach GROUP BY a)
        SELECT index, (dense_rank() OVER (PARTITION BY video_id ORDER BY root) - 1)::INT AS group_id, count(*) OVER (PARTITION BY video_id, root) AS size, round(avg(brightness) OVER (PARTITION BY video_id, root), 7) AS avg_brightness FROM roots JOIN fea USING (index)""",
)


def _changes(s, d):
    apart = 0.6 * F.abs(F.col("brightness") - F.col("prev_brightness")) + 0.4 * F.abs(F.col("contrast") - F.col("prev_contrast"))
    return scene_changes(feature_rows(s, d), apart)


REGISTER.add(
    "scene_changes", lambda s, d: _changes(s, d).select("from_index", "to_index", "timestamp", "change_type", "confidence"),
    """SELECT p AS from_index, index AS to_index, start_time AS timestamp, CASE WHEN x > 0.5 THEN 'hard_cut' WHEN abs(brightness - pb) > 0.3 THEN 'lighting' ELSE 'soft_cut' END AS change_type, least(x / 0.5, 1.0)::DOUBLE AS confidence FROM (
       SELECT *, 0.6 * abs(brightness - pb) + 0.4 * abs(contrast - pc) AS x FROM (SELECT *, lag(index) OVER w AS p, lag(brightness) OVER w AS pb, lag(contrast) OVER w AS pc FROM fea WINDOW w AS (PARTITION BY video_id ORDER BY start_time, index))) WHERE x > 0.25""", FEATURES_SQL,
)
REGISTER.add(
    "knn", lambda s, d: X.most_similar(feature_rows(s, d).filter("index <> 0"), feature_rows(s, d).filter("index = 0").select(F.col("brightness").alias("rb"), F.col("contrast").alias("rc")), F.bround(F.abs(F.col("brightness") - F.col("rb")) + F.abs(F.col("contrast") - F.col("rc")), 9), 10).select("index", "similarity"),
    "SELECT index, 1 - x AS similarity FROM (SELECT f.index, round(abs(f.brightness - r.brightness) + abs(f.contrast - r.contrast), 9) AS x FROM fea f, (SELECT * FROM fea WHERE index = 0) r WHERE f.index <> 0) ORDER BY similarity DESC, index LIMIT 10", FEATURES_SQL,
)
REGISTER.add(
    "dimension_names", lambda s, d: table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"),
    "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
)
REGISTER.add(
    "computed_key_lookup", lambda s, d: table(s, d, "supplier").select("s_suppkey", F.substring(F.md5("s_name"), 1, 12).alias("id")).join(table(s, d, "supplier").select(F.substring(F.md5("s_name"), 1, 12).alias("id"), "s_name"), "id").select("s_suppkey", "id", "s_name"),
    "SELECT a.s_suppkey, substr(md5(a.s_name), 1, 12) AS id, b.s_name FROM supplier a JOIN supplier b ON substr(md5(a.s_name), 1, 12) = substr(md5(b.s_name), 1, 12)",
)
