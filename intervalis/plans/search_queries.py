"""Filters, shortcuts, sorts and pages over segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from intervalis.functions import scalars
from intervalis.operators import search as S
from intervalis.operators.ranking import PageIndex
from intervalis.plans.register import Register
from intervalis.plans.views import SEGMENTS_SQL, segments, table
from intervalis.sources.documents import field, pending

REGISTER = Register()
KEYS = ("video_id", "index")


def _filtered(name: str, operator: str, value=None):
    group = S.Group("and", (S.Filter(name, operator, value),))
    return lambda spark, d: S.matching(segments(spark, d), S.Query(group)).select(*KEYS, "score", "tier")


# name of the query: field, operator, value, and the condition in SQL with its null rule spelt out
_PREDICATES = {
    "search_eq": ("tier", "eq", "gold", "coalesce(tier = 'gold', false)"),
    "search_neq": ("take_group_id", "neq", 3, "coalesce(take_group_id <> 3, true)"),
    "search_gt": ("score", "gt", 9.0, "coalesce(score > 9, false)"),
    "search_gte": ("quality", "gte", 9.0, "coalesce(score >= 9, false)"),
    "search_lt": ("take_group_id", "lt", 2, "coalesce(take_group_id < 2, false)"),
    "search_lte": ("metrics.motion_std", "lte", 0.4, "coalesce(motion_std <= 0.4, false)"),
    "search_in": ("tier", "in", ["gold", "silver"], "coalesce(tier IN ('gold', 'silver'), false)"),
    "search_not_in": ("take_group_id", "not_in", [0, 1], "coalesce(take_group_id NOT IN (0, 1), false)"),
    "search_contains": ("framing_type", "contains", "plano", "coalesce(contains(lower(framing_type), 'plano'), false)"),
    "search_tags_contains": ("tags", "contains", "entrevista", "coalesce(list_contains(tags, 'entrevista'), false)"),
    "search_not_contains": ("garbage_type", "not_contains", "SKY", "coalesce(NOT contains(lower(garbage_type), 'sky'), false)"),
    "search_starts_with": ("shot_type", "starts_with", "est", "coalesce(starts_with(lower(shot_type), 'est'), false)"),
    "search_ends_with": ("filename", "ends_with", "7.MP4", "coalesce(ends_with(lower(filename), '7.mp4'), false)"),
    "search_between": ("duration", "between", [10.0, 12.0], "coalesce(duration BETWEEN 10 AND 12, false)"),
    "search_exists": ("is_best_take", "exists", None, "is_best_take IS NOT NULL"),
    "search_is_true": ("is_best_take", "is_true", None, "coalesce(is_best_take, false)"),
    "search_is_false": ("is_best_take", "is_false", None, "NOT coalesce(is_best_take, false)"),
    "search_alias": ("brightness", "lt", 0.2, "coalesce(brightness < 0.2, false)"),
    "search_unknown_field": ("no.such.field", "neq", 1, "true"),
}
for _name, (_field, _operator, _value, _sql) in _PREDICATES.items():
    REGISTER.add(_name, _filtered(_field, _operator, _value), f"SELECT video_id, index, score, tier FROM seg WHERE {_sql}", SEGMENTS_SQL)

_NESTED = {
    "filters": {"operator": "AND", "filters": [
        {"field": "score", "operator": "gte", "value": 6.0},
        {"operator": "OR", "filters": [{"field": "shot_type", "value": "PANEO"}, {"operator": "AND", "filters": [{"field": "face_count", "operator": "gte", "value": 2}, {"field": "is_key_moment", "operator": "is_true"}]}]}]},
    "sort_by": "take", "sort_order": "desc", "page": 3, "page_size": 40,
}
_NESTED_SQL = "score >= 6 AND (shot_type = 'PANEO' OR (face_count >= 2 AND is_key_moment))"


def _ordered(spark, d):
    """A tie key that is unique in the whole table."""
    rows = segments(spark, d)
    return rows.withColumn("index", F.col("video_id") * 1000 + F.col("index"))


REGISTER.add("search_nested_and_or", lambda s, d: S.matching(segments(s, d), S.parse_query(_NESTED)).select(*KEYS, "score"), f"SELECT video_id, index, score FROM seg WHERE {_NESTED_SQL}", SEGMENTS_SQL)
REGISTER.add(
    "search_page", lambda s, d: S.page_of(_ordered(s, d), S.parse_query(_NESTED | {"include_fields": ["index", "take_group_id", "score"]})),
    f"SELECT video_id * 1000 + index AS index, take_group_id, score FROM seg WHERE {_NESTED_SQL} ORDER BY take_group_id DESC NULLS FIRST, 1 LIMIT 40 OFFSET 80", SEGMENTS_SQL,
)
REGISTER.add(
    "search_deep_page", lambda s, d: PageIndex(_ordered(s, d), S.Query(sort_by="score", descending=True, page_size=50, include=("index", "score"))).page(71),
    "SELECT video_id * 1000 + index AS index, score FROM seg ORDER BY score DESC NULLS FIRST, 1 LIMIT 50 OFFSET 3500", SEGMENTS_SQL,
)
REGISTER.add(
    "search_sort_nulls_last", lambda s, d: S.page_of(_ordered(s, d), S.Query(sort_by="take_group_id", page=2, page_size=100, include=("index", "take_group_id"))),
    "SELECT video_id * 1000 + index AS index, take_group_id FROM seg ORDER BY take_group_id ASC NULLS LAST, 1 LIMIT 100 OFFSET 100", SEGMENTS_SQL,
)
REGISTER.add("search_empty_or", lambda s, d: S.matching(segments(s, d), S.Query(S.Group("or"))).select(*KEYS), "SELECT video_id, index FROM seg WHERE false", SEGMENTS_SQL)
REGISTER.add(
    "search_dotted_path", lambda s, d: table(s, d, "events").withColumn("k", field(F.col("props"), "k").cast("long")).filter("k >= 50").select("event_id", "k"),
    "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k')::BIGINT >= 50",
)
REGISTER.add(
    "quick_search", lambda s, d: S.quick_search(segments(s, d), tiers=["gold", "silver"], score_min=7.0, has_faces=True, tags=["persona", "open"], exclude_repeated=True, framing_type="primer").select(*KEYS, "score"),
    "SELECT video_id, index, score FROM seg WHERE tier IN ('gold', 'silver') AND score >= 7 AND face_count > 0 AND list_contains(tags, 'persona') AND list_contains(tags, 'open') AND NOT coalesce(is_repeated_take, false) AND contains(lower(framing_type), 'primer')", SEGMENTS_SQL,
)
_SHORTCUTS = {
    "gold": ((), "tier = 'gold'"), "usable": ((), "tier IN ('gold', 'silver') AND NOT is_repeated_take"), "faces": ((), "face_count > 0"), "key_moments": ((), "is_key_moment"), "best_takes": ((), "coalesce(is_best_take, false)"),
    "scene": ((3,), "scene_group_id = 3"), "shot_type": (("TILT",), "shot_type = 'TILT'"), "framing": (("medio",), "contains(lower(framing_type), 'medio')"), "static": ((), "shot_type = 'ESTATICA'"), "interview": ((), "face_count > 0 AND list_contains(tags, 'entrevista')"),
}
for _name, (_args, _sql) in _SHORTCUTS.items():
    REGISTER.add(f"shortcut_{_name}", lambda s, d, n=_name, a=_args: S.shortcut(segments(s, d), n, *a).select(*KEYS, "score"), f"SELECT video_id, index, score FROM seg WHERE {_sql}", SEGMENTS_SQL)
REGISTER.add(
    "shortcut_time_range", lambda s, d: S.shortcut(_ordered(s, d), "time_range", 20.0, 60.0).select("index", "start_time", "end_time"),
    "SELECT video_id * 1000 + index AS index, start_time, end_time FROM seg WHERE start_time >= 20 AND end_time <= 60 ORDER BY start_time, 1 LIMIT 50", SEGMENTS_SQL,
)
REGISTER.add("min_tier", lambda s, d: S.min_tier(segments(s, d), "SILVER").select(*KEYS), "SELECT video_id, index FROM seg WHERE tier IN ('gold', 'silver')", SEGMENTS_SQL)
REGISTER.add("exclude_garbage", lambda s, d: S.without_garbage(segments(s, d), ["lens_cap"]).select(*KEYS), "SELECT video_id, index FROM seg WHERE NOT (is_garbage AND coalesce(garbage_type = 'lens_cap', false))", SEGMENTS_SQL)
REGISTER.add(
    "face_filter", lambda s, d: S.with_faces(segments(s, d).withColumn("any_eyes_closed", F.col("index") == 2), 2, eyes_open=True, tier="gold").select(*KEYS, "face_count"),
    "SELECT video_id, index, face_count FROM seg WHERE face_count >= 2 AND index <> 2 AND tier = 'gold'", SEGMENTS_SQL,
)
REGISTER.add(
    "exists_semi", lambda s, d: S.videos_with(table(s, d, "orders").select(F.col("o_orderkey").alias("video_id"), "o_custkey"), segments(s, d), F.array_contains("tags", "entrevista")),
    "SELECT o_orderkey AS video_id, o_custkey FROM orders WHERE o_orderkey IN (SELECT video_id FROM seg WHERE list_contains(tags, 'entrevista'))", SEGMENTS_SQL,
)
REGISTER.add(
    "pending_anti", lambda s, d: S.not_yet(table(s, d, "customer").select("c_custkey", "c_name"), table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey"),
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
REGISTER.add(
    "pending_union",
    lambda s, d: pending(table(s, d, "supplier").select(F.col("s_name").alias("filename"), F.col("s_acctbal").alias("size")), table(s, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_name").alias("filename"), F.col("s_acctbal").alias("size"))).select("filename", "state"),
    "SELECT s_name AS filename, CASE WHEN s_suppkey % 3 = 0 THEN 'analyzed' ELSE 'pending' END AS state FROM supplier",
)
REGISTER.add(
    "export_guarded_filter", lambda s, d: S.export_selection(segments(s, d), ["gold", "SILVER"], best_takes=True, faces=True).select(*KEYS),
    "SELECT video_id, index FROM seg WHERE tier IN ('gold', 'silver') AND NOT is_garbage AND NOT is_repeated_take AND face_count > 0 AND (coalesce(is_best_take, false) OR NOT (SELECT bool_or(coalesce(is_best_take, false)) FROM seg WHERE tier IN ('gold', 'silver') AND NOT is_garbage AND NOT is_repeated_take AND face_count > 0))", SEGMENTS_SQL,
)
REGISTER.add("legacy_export_filter", lambda s, d: segments(s, d).filter(F.col("tier").isin("gold", "bronze") & (F.col("duration") >= 20) & F.col("shot_type").isin("TILT")).select(*KEYS), "SELECT video_id, index FROM seg WHERE tier IN ('gold', 'bronze') AND duration >= 20 AND shot_type = 'TILT'", SEGMENTS_SQL)
REGISTER.add("text_search", lambda s, d: S.text_search(table(s, d, "part"), "RED", "p_name").select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')")
REGISTER.add("available_filters", lambda s, d: S.available_filters(s))
REGISTER.add("project_exclude", lambda s, d: S.project(table(s, d, "nation"), exclude=["n_regionkey", "unknown"]), "SELECT n_nationkey, n_name FROM nation")
REGISTER.add(
    "scalar_names",
    lambda s, d: segments(s, d).select(
        *KEYS, scalars.timecode(F.col("start_time")).alias("timecode"), scalars.thumbnail_id(F.col("filename"), F.col("start_time")).alias("thumbnail"), scalars.file_id(F.col("filename")).alias("file_id"), scalars.plain_id(F.col("filename")).alias("plain"),
        scalars.frames(F.col("duration"), 25).alias("frames"), scalars.estimate_seconds(F.col("duration")).alias("estimate"), scalars.movement_band(F.col("metrics.motion_mean")).alias("band"), scalars.tier_action(F.col("tier")).alias("action"),
        F.concat_ws(",", scalars.leading_tags(F.col("tags"))).alias("leading"), scalars.display_class().alias("display"),
    ),
    """SELECT video_id, index,
           printf('%02d:%02d:%02d:%02d', floor(start_time)::BIGINT // 3600, floor(start_time)::BIGINT // 60 % 60, floor(start_time)::BIGINT % 60, floor((start_time - floor(start_time)) * 30)::BIGINT) AS timecode,
           substr(md5(printf('%s_%.2f', filename, start_time)), 1, 12) AS thumbnail, 'f_' || substr(md5(filename), 1, 8) AS file_id, translate(filename, '. -', '___') AS plain, trunc(duration * 25)::INT AS frames,
           greatest(3, CASE WHEN duration <= 0 THEN 5 WHEN duration < 10 THEN greatest(5, trunc(1.2::DOUBLE * duration)::INT + 2) WHEN duration < 60 THEN trunc(0.85::DOUBLE * duration)::INT + 2 ELSE trunc(0.75::DOUBLE * duration)::INT + 2 END)::INT AS estimate,
           CASE WHEN motion < 0.5 THEN 'none' WHEN motion < 2 THEN 'slight' WHEN motion < 5 THEN 'moderate' WHEN motion < 10 THEN 'high' ELSE 'extreme' END AS band,
           CASE tier WHEN 'gold' THEN 'Usar' WHEN 'silver' THEN 'Usable' WHEN 'bronze' THEN 'Revisar' ELSE 'Descartar' END AS action,
           array_to_string((list_filter(tags, lambda t: regexp_matches(t, 'entrevista|persona')) || list_filter(tags, lambda t: NOT regexp_matches(t, 'entrevista|persona')))[1:4], ',') AS leading,
           CASE WHEN is_garbage THEN 'garbage' WHEN is_key_moment THEN 'key-moment' WHEN coalesce(is_best_take, false) THEN 'best-take' WHEN is_repeated_take THEN 'repeated-take' ELSE tier END AS display
    FROM seg""", SEGMENTS_SQL,
)
