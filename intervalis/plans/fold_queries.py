"""Queries of ordered folds and of the criteria of a segment; their SQL walks a video's rows by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from intervalis.operators import intervals, scoring, table_functions
from intervalis.plans.register import Register
from intervalis.plans.series_queries import _SPANS_SQL, _spans
from intervalis.plans.views import FRAMES_SQL, SEGMENTS_SQL, segments

REGISTER = Register()

# --- detections of one video, the more important of two that overlap stays ---------------------
_CLASH = "least(x.e, k.e) > greatest(x.s, k.s) AND ((x.e > x.s AND (least(x.e, k.e) - greatest(x.s, k.s)) / (x.e - x.s) > 0.5) OR (k.e > k.s AND (least(x.e, k.e) - greatest(x.s, k.s)) / (k.e - k.s) > 0.5))"
REGISTER.add(
    "priority_dedupe", lambda s, d: intervals.priority_dedupe(_spans(s, d).withColumn("kind", F.when(F.col("kind") == "view", "sky_shot").otherwise("uniform_frame"))),
    f"""WITH RECURSIVE {FRAMES_SQL}, {_SPANS_SQL},
        ord AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_time, ordinal) AS i, count(*) OVER (PARTITION BY video_id) AS c,
                       {{'s': start_time, 'e': end_time, 'p': CASE kind WHEN 'view' THEN 7 ELSE 4 END, 'o': ordinal}} AS x FROM det),
        fold(video_id, i, c, kept) AS (
            SELECT video_id, i, c, [x] FROM ord WHERE i = 1
            UNION ALL
            SELECT video_id, i, c, CASE WHEN hit = 0 THEN list_append(kept, x) WHEN x.p > kept[hit].p THEN list_transform(kept, lambda k, j: CASE WHEN j = hit THEN x ELSE k END) ELSE kept END
            FROM (SELECT o.*, f.kept, coalesce(list_position(list_transform(f.kept, lambda k: {_CLASH.replace("x.", "o.x.")}), true), 0) AS hit FROM fold f JOIN ord o ON o.video_id = f.video_id AND o.i = f.i + 1))
        SELECT video_id, k.o AS ordinal, CASE k.p WHEN 7 THEN 'sky_shot' ELSE 'uniform_frame' END AS kind, k.s AS start_time, k.e AS end_time FROM (SELECT video_id, unnest(kept) AS k FROM fold WHERE i = c)""",
)

# --- consolidation ----------------------------------------------------------------------------
_MICRO = 8.0
_FIELDS = ("idx", "s", "e", "score", "tier", "shot", "garb", "key", "best", "rep", "n", "tags", "sharp")
_RANK = "CASE {}.tier WHEN 'gold' THEN 4 WHEN 'silver' THEN 3 WHEN 'bronze' THEN 2 WHEN 'discard' THEN 1 ELSE 0 END"


def _with(x: str, **changes: str) -> str:
    return "{" + ", ".join(f"'{f}': {changes.get(f, f'{x}.{f}')}" for f in _FIELDS) + "}"


def _merged(a: str, b: str) -> str:
    da, db = f"({a}.e - {a}.s)", f"({b}.e - {b}.s)"
    mean = lambda f: f"({a}.{f} * {da} + {b}.{f} * {db}) / CASE WHEN {da} + {db} = 0 THEN 1.0 ELSE {da} + {db} END"
    return _with(
        a, e=f"{b}.e", score=mean("score"), sharp=mean("sharp"), tier=f"CASE WHEN {_RANK.format(b)} > {_RANK.format(a)} THEN {b}.tier ELSE {a}.tier END", key=f"{a}.key OR {b}.key", best=f"{a}.best OR {b}.best",
        n=f"{a}.n + {b}.n", tags=f"list_sort(list_distinct(list_concat({a}.tags, {b}.tags)))",
    )


def _clean(*xs: str) -> str:
    return " AND ".join(f"NOT {x}.garb AND {x}.tier <> 'garbage'" for x in xs)


def _similar(a: str, b: str) -> str:
    return f"""(abs({b}.s - {a}.e) <= 0.1 AND {a}.shot = {b}.shot AND ({a}.tier = {b}.tier OR ({a}.tier IN ('gold', 'silver') AND {b}.tier IN ('gold', 'silver'))) AND {_clean(a, b)}
        AND abs({a}.score - {b}.score) <= 2 AND {a}.key = {b}.key AND {a}.best = {b}.best AND {a}.garb = {b}.garb)"""


def _relaxed(a: str, b: str) -> str:
    both = lambda names: f"({a}.shot IN ({names}) AND {b}.shot IN ({names}))"
    still, moving = both("'ESTATICA', 'TRIPOD', 'LOCKED'"), "'MOVIMIENTO_FLUIDO', 'PANEO', 'TILT', 'TRACKING', 'DOLLY'"
    kin = lambda extra: f"({a}.shot = {b}.shot OR {still} OR {both(moving + extra)})"
    short = lambda x: f"({x}.e - {x}.s < {_MICRO} AND {x}.rep)"
    wide = f"({kin(", 'SHAKY'")} OR least({a}.e - {a}.s, {b}.e - {b}.s) < 1)"
    return f"(abs({b}.s - {a}.e) <= 0.15 AND {_clean(a, b)} AND CASE WHEN {short(a)} OR {short(b)} THEN {wide} ELSE {kin('')} END)"


_CONSOLIDATED = f"""WITH RECURSIVE {SEGMENTS_SQL},
    ord AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_time, index) AS i, count(*) OVER (PARTITION BY video_id) AS c,
        {{'idx': index, 's': start_time::DOUBLE, 'e': end_time::DOUBLE, 'score': score::DOUBLE, 'tier': tier, 'shot': shot_type, 'garb': is_garbage, 'key': is_key_moment, 'best': coalesce(is_best_take, false),
          'rep': is_repeated_take, 'n': 1::BIGINT, 'tags': tags, 'sharp': sharpness::DOUBLE}} AS x FROM seg),
    one(video_id, i, c, cur, done) AS (
        SELECT video_id, i, c, x, CASE WHEN false THEN x END FROM ord WHERE i = 1
        UNION ALL
        SELECT video_id, i, c, CASE WHEN k THEN {_merged("cur", "x")} ELSE x END, CASE WHEN k THEN NULL ELSE cur END
        FROM (SELECT o.*, f.cur, {_similar("f.cur", "o.x")} AS k FROM one f JOIN ord o ON o.video_id = f.video_id AND o.i = f.i + 1)),
    mid AS (SELECT video_id, done AS x FROM one WHERE done IS NOT NULL UNION ALL SELECT video_id, cur FROM one WHERE i = c),
    mord AS (SELECT video_id, x, lead(x) OVER w AS nx, row_number() OVER w AS i, count(*) OVER (PARTITION BY video_id) AS c FROM mid WINDOW w AS (PARTITION BY video_id ORDER BY x.s, x.idx)),
    two(video_id, i, c, kept, carry, joins, done) AS (
        SELECT video_id, 0::BIGINT, c, CASE WHEN false THEN x END, CASE WHEN false THEN x END, false, CASE WHEN false THEN x END FROM mord WHERE i = 1
        UNION ALL
        SELECT video_id, i, c, CASE WHEN step IN (1, 6) THEN y WHEN step = 2 THEN {_merged("kept", "y")} WHEN step = 4 THEN {_with("kept", e="y.e")} ELSE kept END,
               CASE WHEN step IN (3, 5) THEN y END, step = 3, CASE WHEN step = 1 THEN kept END
        FROM (SELECT *, CASE WHEN y.e - y.s >= {_MICRO} OR (y.e - y.s >= 1 AND (y.key OR y.best) AND NOT y.rep) THEN 1 WHEN kept IS NOT NULL AND {_relaxed("kept", "y")} THEN 2
                             WHEN nx IS NOT NULL AND {_relaxed("y", "nx")} THEN 3 WHEN kept IS NOT NULL THEN 4 WHEN nx IS NOT NULL THEN 5 ELSE 6 END AS step
              FROM (SELECT m.video_id, m.i, m.c, m.nx, f.kept, CASE WHEN f.carry IS NULL THEN m.x WHEN f.joins THEN {_merged("f.carry", "m.x")} ELSE {_with("m.x", s="f.carry.s")} END AS y
                    FROM two f JOIN mord m ON m.video_id = f.video_id AND m.i = f.i + 1)))
    SELECT video_id, x.idx AS index, x.s AS start_time, x.e AS end_time, x.score AS score, x.tier AS tier, x.n::INT AS merged_count, array_to_string(x.tags, ',') AS tag_list, x.sharp AS sharpness
    FROM (SELECT video_id, done AS x FROM two WHERE done IS NOT NULL UNION ALL SELECT video_id, kept FROM two WHERE i = c)"""
_FOLDED = "video_id index start_time end_time duration score tier shot_type tags is_garbage is_key_moment is_best_take is_repeated_take face_count metrics".split()
REGISTER.add(
    "consolidate_fold",
    lambda s, d: intervals.consolidate(segments(s, d).select(*_FOLDED), micro=_MICRO)
    .select("video_id", "index", "start_time", "end_time", "score", "tier", F.col("merged_count").cast("int").alias("merged_count"), F.array_join("tags", ",").alias("tag_list"), F.col("metrics.sharpness_mean").alias("sharpness")),
    _CONSOLIDATED,
)



def _by_function(s, d):
    """``consolidate_fold`` through the table function, from SQL."""
    found = segments(s, d).select(*_FOLDED)
    found.createOrReplaceTempView("segments_to_fold")
    dealt = table_functions.register_consolidation(s, "consolidated_blocks", found.schema)
    rows = s.sql(f"SELECT * FROM consolidated_blocks(TABLE(segments_to_fold) {dealt}, {_MICRO}D)")
    return rows.select("video_id", "index", "start_time", "end_time", "score", "tier", F.col("merged_count").cast("int").alias("merged_count"), F.array_join("tags", ",").alias("tag_list"), F.col("metrics.sharpness_mean").alias("sharpness"))


REGISTER.add("consolidate_function", _by_function, _CONSOLIDATED)

# --- criteria ---------------------------------------------------------------------------------
#: Metrics of a segment from its number k, in words that Spark and the SQL share.
_METRICS = {
    "camera_motion_mean": "k % 4 / 5", "motion_mean": "k % 11 / 4", "motion_std": "k % 7 / 10", "direction_consistency": "k % 10 / 10", "motion_uniformity": "k % 5 / 5", "object_motion_mean": "k % 9 / 10",
    "has_camera_shake": "CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END", "tremor_power": "k % 17 / 40", "dominant_frequency": "k % 19 / 3", "horizontal_dominance": "k % 8 / 8", "vertical_dominance": "k % 6 / 6",
    "speed_consistency": "k % 12 / 12", "vertical_component_mean": "k % 14 / 8", "horizontal_component_mean": "k % 15 / 8", "sharpness_mean": "k % 23 * 10", "sharpness_std": "k % 16 * 2", "blurry_frame_pct": "k % 18 * 4",
    "brightness_mean": "k % 21 / 20", "brightness_std": "k % 12 / 100", "contrast_mean": "k % 22 / 21", "h_balance": "k % 11 / 10", "v_balance": "k % 13 / 12", "avg_face_count": "k % 3", "faces_in_focus_pct": "k % 26 * 4",
    "eyes_closed_frame_pct": "k % 9 * 5", "avg_face_coverage": "k % 20 / 40", "avg_framing_issues": "k % 7 / 3",
}


def _judged(s, d, also=None):
    rows = segments(s, d).select("video_id", "index", (F.col("video_id") * 31 + F.col("index") * 7).alias("k"))
    return scoring.evaluate(rows.withColumn("metrics", F.struct(*(F.expr(f"CAST({x} AS DOUBLE)").alias(n) for n, x in _METRICS.items()))), also=also)


def _categories(s, d):
    h, v = F.col("metrics.h_balance"), F.col("metrics.v_balance")
    rows = _judged(s, d, lambda made: scoring.categorised(made, h, v)).withColumn("image_quality", F.col("focus") * 0.7 + F.col("exposure") * 0.3)
    return rows.select("video_id", "index", "stability", "focus", "exposure", "image_quality", "framing", scoring.status(F.col("image_quality")).alias("status"))


def _made(name: str, value: str, score: str, weight: float, passed: str, when: str = "true") -> str:
    return f"CASE WHEN {when} THEN {{'name': '{name}', 'value': ({value})::DOUBLE, 'score': ({score})::DOUBLE, 'weight': {weight}::DOUBLE, 'passed': {passed}}} END"


_BAND = "CASE WHEN {0} >= 0.7 THEN 10 WHEN {0} >= 0.5 THEN 7 ELSE 4 END"
_MADE = ", ".join((
    _made("Estabilidad de cámara", "motion", "CASE WHEN motion < 0.5 THEN 10 * (1 - motion / 0.5::DOUBLE) ELSE 0 END", 0.5, "motion < 0.5", "shot = 'ESTATICA'"),
    _made("Consistencia", "motion_std", "10 * greatest(0, 1 - motion_std / 0.5::DOUBLE)", 0.3, "motion_std < 0.5", "shot = 'ESTATICA'"),
    _made("Acción en escena", "object_motion_mean", "8", 0.1, "true", "shot = 'ESTATICA' AND object_motion_mean > 0.5 AND motion < 0.5"),
    _made("Velocidad uniforme", "speed_consistency", "10 * speed_consistency", 0.4, "speed_consistency >= 0.7", "shot IN ('PANEO', 'TILT')"),
    _made("Estabilidad vertical", "vertical_component_mean", "10 * greatest(0, 1 - vertical_component_mean / 1.5::DOUBLE)", 0.4, "vertical_component_mean < 1.5", "shot = 'PANEO'"),
    _made("Estabilidad horizontal", "horizontal_component_mean", "10 * greatest(0, 1 - horizontal_component_mean / 1.5::DOUBLE)", 0.4, "horizontal_component_mean < 1.5", "shot = 'TILT'"),
    _made("Suavidad", "dominant_frequency", "10 * greatest(0, 1 - dominant_frequency / 4)", 0.5, "dominant_frequency < 4", "shot IN ('MOVIMIENTO_FLUIDO', 'TRACKING')"),
    _made("Sin temblor", "tremor_power", "10 * greatest(0, 1 - tremor_power / 0.2::DOUBLE)", 0.3, "tremor_power < 0.2", "shot IN ('MOVIMIENTO_FLUIDO', 'TRACKING')"),
    _made("Nivel de temblor", "tremor_power", "greatest(0, 4 - 10 * tremor_power)", 0.7, "tremor_power < 0.1", "shot = 'SHAKY'"),
    _made("Enfoque", "sharpness_mean", "CASE WHEN sharpness_mean < 30 THEN 0 WHEN sharpness_mean < 50 THEN 3 WHEN sharpness_mean < 100 THEN 6 WHEN sharpness_mean < 200 THEN 8 ELSE 10 END", 0.25, "sharpness_mean >= 50"),
    _made("Frames con enfoque", "blurry_frame_pct", "CASE WHEN blurry_frame_pct = 0 THEN 10 WHEN blurry_frame_pct <= 20 THEN 8 WHEN blurry_frame_pct <= 50 THEN 5 ELSE 2 END", 0.1, "blurry_frame_pct <= 20"),
    _made("Consistencia de enfoque", "spread", "CASE WHEN spread < 0.1 THEN 10 WHEN spread < 0.2 THEN 8 WHEN spread < 0.35 THEN 5 ELSE 3 END", 0.1, "spread < 0.2"),
    _made("Exposición", "brightness_mean", "CASE WHEN brightness_mean BETWEEN 0.4 AND 0.7 THEN 10 WHEN brightness_mean < 0.2 OR brightness_mean > 0.85 THEN 3 ELSE 7 END", 0.15, "brightness_mean BETWEEN 0.4 AND 0.7"),
    _made("Consistencia de luz", "brightness_std", "10 * greatest(0, 1 - brightness_std / 0.1::DOUBLE)", 0.1, "brightness_std < 0.1"),
    _made("Contraste", "contrast_mean", "CASE WHEN contrast_mean BETWEEN 0.3 AND 0.7 THEN 10 WHEN contrast_mean BETWEEN 0.2 AND 0.85 THEN 7 WHEN contrast_mean < 0.2 THEN 4 ELSE 5 END", 0.1, "contrast_mean BETWEEN 0.3 AND 0.7"),
    _made("Balance horizontal", "h_balance", _BAND.format("h_balance"), 0.1, "h_balance >= 0.5"), _made("Balance vertical", "v_balance", _BAND.format("v_balance"), 0.1, "v_balance >= 0.5"),
    _made("Rostros en foco", "faces_in_focus_pct", "CASE WHEN faces_in_focus_pct >= 80 THEN 10 WHEN faces_in_focus_pct >= 50 THEN 6 WHEN faces_in_focus_pct >= 20 THEN 3 ELSE 0 END", 0.25, "faces_in_focus_pct >= 50", "avg_face_count > 0"),
    _made("Ojos abiertos", "eyes_closed_frame_pct", "CASE WHEN eyes_closed_frame_pct = 0 THEN 10 WHEN eyes_closed_frame_pct < 10 THEN 8 WHEN eyes_closed_frame_pct < 30 THEN 5 ELSE 2 END", 0.2, "eyes_closed_frame_pct < 10", "avg_face_count > 0"),
    _made("Tamaño del rostro", "avg_face_coverage", "CASE WHEN avg_face_coverage BETWEEN 0.05 AND 0.4 THEN 10 WHEN avg_face_coverage > 0.4 THEN 7 WHEN avg_face_coverage > 0.02 THEN 6 ELSE 4 END", 0.1, "avg_face_coverage >= 0.05", "avg_face_count > 0"),
    _made("Encuadre del rostro", "avg_framing_issues", "CASE WHEN avg_framing_issues = 0 THEN 10 WHEN avg_framing_issues < 1 THEN 7 WHEN avg_framing_issues < 2 THEN 4 ELSE 2 END", 0.1, "avg_framing_issues < 1", "avg_face_count > 0"),
))
_JUDGED_SQL = f"""met AS (SELECT *, CASE WHEN camera_motion_mean > 0 THEN camera_motion_mean ELSE motion_mean END AS motion, sharpness_std / (sharpness_mean + 1) AS spread,
        direction_consistency > 0.75 AND (motion_uniformity > 0.6 OR object_motion_mean < 0.3 * camera_motion_mean) AS directed
        FROM (SELECT video_id, index, {", ".join(f"({x})::DOUBLE AS {n}" for n, x in _METRICS.items())} FROM (SELECT *, video_id * 31 + index * 7 AS k FROM seg))),
    judged AS (SELECT *, list_filter([{_MADE}], lambda c: c IS NOT NULL) AS made FROM (
        SELECT *, CASE WHEN motion < 0.8 THEN 'ESTATICA' WHEN has_camera_shake > 0 OR tremor_power > 0.3 OR dominant_frequency > 6 THEN 'SHAKY' WHEN directed AND horizontal_dominance > 0.7 THEN 'PANEO'
                          WHEN directed AND vertical_dominance > 0.7 THEN 'TILT' WHEN dominant_frequency < 4 THEN 'MOVIMIENTO_FLUIDO' ELSE 'TRACKING' END AS shot FROM met))"""


def _mean_of(*names: str) -> str:
    kept = f"list_filter(made, lambda c: c.name IN ({', '.join(repr(n) for n in names)}))"
    return f"CASE WHEN len({kept}) > 0 THEN list_sum(list_transform({kept}, lambda c: c.score)) / len({kept}) ELSE 7.0 END::DOUBLE"


_STEADY = ("Estabilidad de cámara", "Consistencia", "Velocidad uniforme", "Estabilidad vertical", "Estabilidad horizontal", "Suavidad", "Sin temblor", "Nivel de temblor", "Consistencia de enfoque", "Consistencia de luz")
REGISTER.add(
    "evaluate_segments",
    lambda s, d: _judged(s, d, scoring.explained).select("video_id", "index", "shot_type", "score", "tier", "is_critically_blurry", "passed", "failed", "worst"),
    """SELECT video_id, index, shot AS shot_type, CASE WHEN blurry THEN least(mean, 3.0) ELSE mean END AS score,
       CASE WHEN blurry THEN 'discard' WHEN mean >= 8 THEN 'gold' WHEN mean >= 6 THEN 'silver' WHEN mean >= 4 THEN 'bronze' ELSE 'discard' END AS tier, blurry AS is_critically_blurry, passed, failed, worst
       FROM (SELECT *, sharpness_mean < 30 AS blurry, list_sum(list_transform(made, lambda c: c.score * c.weight)) / list_sum(list_transform(made, lambda c: c.weight)) AS mean,
                    len(list_filter(made, lambda c: c.passed))::INT AS passed, len(list_filter(made, lambda c: NOT c.passed))::INT AS failed,
                    list_min(list_transform(made, lambda c: {'score': c.score, 'name': c.name})).name AS worst FROM judged)""", SEGMENTS_SQL, _JUDGED_SQL,
)
REGISTER.add(
    "criteria_by_name",
    lambda s, d: _judged(s, d).select("shot_type", F.explode("criteria").alias("c")).groupBy("shot_type", "c.name").agg(F.count(F.lit(1)).alias("n"), F.count_if("c.passed").alias("passed"), F.sum("c.value").alias("value"), F.sum("c.score").alias("score"), F.max("c.weight").alias("weight")),
    "SELECT shot AS shot_type, c.name AS name, count(*) AS n, count(*) FILTER (c.passed) AS passed, sum(c.value) AS value, sum(c.score) AS score, max(c.weight) AS weight FROM (SELECT shot, unnest(made) AS c FROM judged) GROUP BY ALL", SEGMENTS_SQL, _JUDGED_SQL,
)
REGISTER.add(
    "category_scores",
    _categories,
    f"""SELECT *, CASE WHEN image_quality >= 8 THEN 'good' WHEN image_quality >= 6 THEN 'warning' WHEN image_quality >= 4 THEN 'poor' ELSE 'bad' END AS status FROM (
        SELECT *, focus * 0.7::DOUBLE + exposure * 0.3::DOUBLE AS image_quality FROM (SELECT video_id, index, {_mean_of(*_STEADY)} AS stability, {_mean_of("Enfoque", "Frames con enfoque")} AS focus,
        {_mean_of("Exposición")} AS exposure, CASE WHEN h_balance > 0 THEN (h_balance + v_balance) / 2 * 10 ELSE 7.0 END::DOUBLE AS framing FROM judged))""", SEGMENTS_SQL, _JUDGED_SQL,
)
