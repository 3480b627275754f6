import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervalis.functions import pixels, scalars
from intervalis.operators import intervals, rollups, scoring, similarity, tagging, timeline, timeseries
from intervalis.sources import documents


def collected(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# --- time series ------------------------------------------------------------------------------
FRAMES = "video_id string, frame_idx int, timestamp double, brightness double, variance double, edge_density double, motion_magnitude double, motion_direction double, direction_consistency double, garbage_flags struct<is_black:boolean,is_uniform:boolean,is_white:boolean,is_lens_cap:boolean,is_likely_sky:boolean,is_likely_ground:boolean>"


@pytest.fixture(scope="module")
def frames(spark):
    """Forty-eight frames at 8 fps of a lamp that is switched on after six: then a slow pan, a fast one, rest."""
    rows = []
    for i in range(48):
        dark = i < 6
        motion = None if dark else 0.25 if i < 12 else 3.5 if i < 36 else 0.05
        rows.append(("v", i, i / 8, 0.005 if dark else 0.625, 1.0 if dark else 900.0, 0.2, motion, 0.0, None if dark else 0.9 if i < 36 else 0.1, (dark, False, False, False, False, False)))
    return spark.createDataFrame(rows, FRAMES)


def test_garbage_of_a_dark_start(spark, frames):
    black = timeseries.uniform_runs(frames)
    assert [(r.kind, r.start_time, r.end_time, r.n) for r in black.collect()] == [("black_frame", 0.0, 0.75, 6)]
    long = frames.withColumn("duration", F.lit(6.0))
    flash = timeseries.exposure_flash(long)
    assert [(r.kind, r.start_time) for r in flash.collect()] == [("exposure_flash", 0.0)]
    both = black.select("video_id", "kind", "start_time", "end_time").unionByName(flash.select("video_id", "kind", "start_time", "end_time")).withColumn("ordinal", F.when(F.col("kind") == "black_frame", 0).otherwise(1))
    assert [r.kind for r in intervals.priority_dedupe(both).collect()] == ["black_frame"]


def test_dead_air_is_a_prefix_and_a_suffix(spark, frames):
    rows = frames.withColumn("motion_magnitude", F.when((F.col("frame_idx") < 16) | (F.col("frame_idx") >= 32), 0.05).otherwise(4.0)).withColumn("duration", F.lit(10.0))
    assert collected(timeseries.dead_air(rows), "kind", "start_time", "n") == [("pre_roll", 0.0, 13)]  # up to 1.5 s
    late = rows.withColumn("timestamp", F.col("timestamp") + 4)
    assert collected(timeseries.dead_air(late, end=True), "start_time", "end_time", "n") == [(8.5, 10.0, 12)]
    longer = rows.withColumn("duration", F.lit(40.0))
    assert collected(timeseries.dead_air(longer), "n") == [(16,)]


def plain_segments(rows, threshold=0.4):
    """The definition: compare each row with the mean of the buffer before it."""
    out, start, buf = [], 0, []
    for i, (_, m, d, b) in enumerate(rows):
        buf.append((m or 0, d or 0, 0.5 if b is None else b))
        change = False
        if i > 0 and len(buf) >= 5:
            am, ad, ab = (sum(x[k] for x in buf[:-1]) / (len(buf) - 1) for k in range(3))
            change = 0.4 * abs(buf[-1][0] - am) / (am + 0.1) + 0.4 * abs(buf[-1][1] - ad) / (math.pi + 0.1) + 0.2 * abs(buf[-1][2] - ab) > threshold
        if (change or i == len(rows) - 1) and len(buf) >= 5:
            out.append((start, i))
            start, buf = i, [buf[-1]]
    return out


def test_change_points_equal_the_definition(spark):
    rnd = random.Random(1)
    for n in [0, 1, 4, 5, 6, 60, 200]:
        for _ in range(30):
            rows = [(i, rnd.choice([None, rnd.random() * 5]), rnd.choice([None, rnd.random() * 3]), rnd.choice([None, rnd.random()])) for i in range(n)]
            assert timeseries.fold_change_points(rows) == plain_segments(rows)
    data = [("a", i, i / 10, 0.5, 0.0, 0.0, 3.0 if i > 20 else 0.5, 0.0, 0.5, None) for i in range(40)]
    found = timeseries.change_point_segments(spark.createDataFrame(data, FRAMES)).orderBy("segment_no").collect()
    assert [(r.first_row, r.last_row) for r in found] == plain_segments([(d[2], d[6], d[7], d[3]) for d in data])


def test_overlap_join_equals_nested_loops(spark):
    rnd = random.Random(4)
    segs = [("ab"[rnd.randrange(2)], i, s := rnd.randrange(200) / 2, s + rnd.randrange(1, 40), "gold") for i in range(60)]
    dets = [("ab"[rnd.randrange(2)], i, f"k{i}", s := rnd.randrange(200) / 2, s + rnd.randrange(1, 60)) for i in range(40)]
    marked = intervals.mark_garbage(spark.createDataFrame(segs, "video_id string, index int, start_time double, end_time double, tier string"), spark.createDataFrame(dets, "video_id string, ordinal int, kind string, start_time double, end_time double"), width=7.0)
    want = []
    for v, i, s, e, _ in segs:
        hits = [k for w, _, k, a, b in dets if w == v and min(e, b) - max(s, a) > 0 and (min(e, b) - max(s, a)) / (e - s) > 0.5]
        want.append((i, hits[0] if hits else None, "garbage" if hits else "gold"))
    assert sorted((r["index"], r.garbage_type, r.tier) for r in marked.collect()) == sorted(want)


def test_boundary_frames_belong_to_both(spark):
    f = spark.createDataFrame([("v", i / 2) for i in range(9)], "video_id string, timestamp double")
    s = spark.createDataFrame([("v", 1, 0.0, 2.0), ("v", 2, 2.0, 4.0)], "video_id string, segment_no int, start_time double, end_time double")
    assert collected(intervals.frames_in_segments(f, s, width=1.0).groupBy("segment_no").count()) == [(1, 5), (2, 5)]


def test_consolidation(spark):
    """Two tilts merge over a short one of a better tier; a short tail joins what stands before it; a gap keeps runs apart."""
    rows = [(0.0, 2.0, "TILT", "silver", 5.0), (2.0, 2.5, "TILT", "gold", 6.0), (2.5, 5.5, "TILT", "silver", 6.5), (5.5, 9.5, "LOCKED", "bronze", 4.0), (9.5, 9.75, "LOCKED", "silver", 8.0), (20.0, 24.0, "LOCKED", "bronze", 4.0), (24.0, 24.5, "PANEO", "gold", 9.0)]
    df = spark.createDataFrame([("v", i, *r, r[1] - r[0]) for i, r in enumerate(rows)], "video_id string, index int, start_time double, end_time double, shot_type string, tier string, score double, duration double")
    out = intervals.consolidate(df).orderBy("start_time").collect()
    assert [(r.start_time, r.end_time, r.tier, r.merged_count) for r in out] == [(0.0, 5.5, "gold", 3), (5.5, 9.75, "silver", 2), (20.0, 24.5, "bronze", 1)]
    assert [round(r.score, 4) for r in out] == [round((5 * 2 + 6 * 0.5 + 6.5 * 3) / 5.5, 4), round((4 * 4 + 8 * 0.25) / 4.25, 4), 4.0]


# --- rules ------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("faces", "coverage", "edges", "kind"),
    [
        # each bound from below, on it, and above
        (0.49, 0.9, 0.1501, "PLANO_DETALLE"), (0.49, 0.9, 0.15, "PLANO_GENERAL"), (0.49, 0.9, 0.08, "PLANO_GENERAL"), (0.49, 0.9, 0.0799, "PLANO_GENERAL_EXTREMO"),
        (0.5, 0.0399, 0.5, "PLANO_GENERAL"), (0.5, 0.04, 0.5, "PLANO_MEDIO"), (0.7, 0.1499, 0.0, "PLANO_MEDIO"), (0.7, 0.15, 0.0, "PRIMER_PLANO"),
        (1.4, 0.3499, 0.0, "PRIMER_PLANO"), (1.4, 0.35, 0.0, "PRIMERÍSIMO_PLANO"), (1.5, 0.35, 0.0, "PLANO_DOS"), (2.49, 0.0, 0.0, "PLANO_DOS"), (2.5, 0.9, 0.9, "PLANO_GRUPO"),
    ],
)
def test_framing(spark, faces, coverage, edges, kind):
    assert spark.range(1).select(scoring.framing_type(F.lit(faces), F.lit(coverage), F.lit(edges)).alias("f")).first().f.framing_type == kind


def test_face_geometry(spark):
    """A 60 x 40 box in 320 x 200: each side just outside and just on the margin of ten pixels, and both bounds of headroom and place."""
    x, y, headroom, place = 130, 80, 0.1, 0.5
    cases = [((x, y, headroom, place), []), ((9, y, headroom, place), ["face_cut_left"]), ((10, y, headroom, place), []), ((250, y, headroom, place), []), ((251, y, headroom, place), ["face_cut_right"])]
    cases += [((x, 9, headroom, place), ["face_cut_top"]), ((x, 10, headroom, place), []), ((x, 150, headroom, place), []), ((x, 151, headroom, place), ["face_cut_bottom"])]
    cases += [((x, y, 0.029, place), ["no_headroom"]), ((x, y, 0.03, place), []), ((x, y, 0.3, place), []), ((x, y, 0.301, place), ["too_much_headroom"])]
    cases += [((x, y, headroom, 0.199), ["off_center"]), ((x, y, headroom, 0.2), []), ((x, y, headroom, 0.8), []), ((9, 9, 0.0, 0.801), ["face_cut_top", "face_cut_left", "no_headroom", "off_center"])]
    rows = spark.createDataFrame([(k, *map(float, c)) for k, (c, _) in enumerate(cases)], "k int, x double, y double, headroom double, place double")
    found = rows.select("k", scoring.face_issues(F.col("x"), F.col("y"), F.lit(60), F.lit(40), F.lit(320), F.lit(200), F.col("headroom"), F.col("place")).alias("i")).orderBy("k").collect()
    assert [r.i for r in found] == [want for _, want in cases]
    bands = {150.0: "excellent", 149.9: "good", 100.0: "good", 99.9: "acceptable", 60.0: "acceptable", 59.9: "soft", 40.0: "soft", 39.9: "blurry", 0.0: "blurry"}
    found = spark.createDataFrame([(s,) for s in bands], "s double").select("s", scoring.face_focus(F.col("s")).alias("b")).collect()
    assert {r.s: r.b for r in found} == bands


METRICS = "struct<brightness_mean:double,contrast_mean:double,sharpness_mean:double,motion_mean:double,motion_std:double,edge_density:double>"
FACES = "struct<has_faces:boolean,avg_face_count:double,primary_face_coverage:double,avg_framing_issues:double>"


def segment_rows(spark, rows):
    base = {"video_id": "v", "score": 7.0, "tier": "gold", "start_time": 0.0, "shot_type": "ESTATICA", "framing_type": "MEDIUM_SHOT", "framing_type_display": "Medio", "take_group_id": None, "is_garbage": False, "metrics": (0.5, 0.5, 80.0, 3.0, 1.0, 0.1), "face_analysis": (False, 0.0, 0.0, 0.0)}
    data = [tuple({**base, "index": i, **r}[c] for c in ("video_id", "index", "score", "tier", "start_time", "shot_type", "framing_type", "framing_type_display", "take_group_id", "is_garbage", "metrics", "face_analysis")) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"video_id string, index int, score double, tier string, start_time double, shot_type string, framing_type string, framing_type_display string, take_group_id int, is_garbage boolean, metrics {METRICS}, face_analysis {FACES}")


def test_tags(spark):
    rows = [{"metrics": (0.8, 0.7, 150.0, 0.5, 0.1, 0.05), "face_analysis": (True, 2.0, 0.2, 0.0)}, {"metrics": (0.1, 0.2, 30.0, 8.0, 4.0, 0.3), "shot_type": "TRACKING", "framing_type": "WIDE"}]
    bright, dark = (set(r.tags) for r in tagging.tag_segments(segment_rows(spark, rows)).orderBy("index").collect())
    assert {"persona", "varias_personas", "rostro_visible", "primer_plano_rostro", "entrevista", "plano_medio", "estatico", "iluminado", "posible_exterior", "alto_contraste", "contraluz", "nitido", "en_foco", "estable", "minimalista", "rostro_bien_encuadrado"} == bright
    assert {"plano_general", "accion", "movimiento_camara", "oscuro", "posible_interior", "bajo_contraste", "borroso", "fuera_de_foco", "subexpuesto", "tembloroso", "complejo_visualmente"} == dark


def test_key_moments(spark):
    """The best of two equal scores comes first by index; a take, garbage and an unknown frame without faces are out."""
    rows = [{"score": 9.25, "start_time": 1.0, "take_group_id": 4}, {"score": 7.75, "start_time": 3.0}, {"score": 7.75, "start_time": 6.0}, {"score": 9.5, "start_time": 8.0, "is_garbage": True}]
    rows += [{"score": 7.0, "start_time": 9.0, "framing_type": "DESCONOCIDO"}, {"score": 7.0, "start_time": 11.0}, {"score": 6.99, "start_time": 12.0}, {"score": 9.0, "start_time": 13.0, "tier": "Discard"}]
    assert collected(tagging.key_moments(segment_rows(spark, rows)), "index", "moment") == [(1, "mejor_calidad"), (2, "contenido_unico"), (5, "contenido_unico")]
    assert tagging.moments_of(tagging.key_moments(segment_rows(spark, rows)), "best_quality").count() == 1


def test_weighted_score(spark):
    made = F.array(*(F.struct(F.lit(s).alias("score"), F.lit(w).alias("weight")) for s, w in ((10.0, 0.5), (4.0, 0.25))))
    none = F.filter(made, lambda c: c["score"] < 0)
    row = spark.range(1).select(scoring.weighted_score(made).alias("a"), scoring.weighted_score(none).alias("b")).first()
    assert row.a == pytest.approx(8.0) and row.b == 7.0


# --- pairs ------------------------------------------------------------------------------------
TAKES = "video_id string, index int, start_time double, duration double, brightness double, contrast double, edge_density double, sharpness double, motion double, framing_type string, scene_group_id int, face_count double, coverage double, score double, tier string, is_garbage boolean"


def test_takes(spark):
    row = lambda i, dur, b, s, score, framing="MEDIUM", scene=0, motion=1.0: ("v", i, 20.0 * i, dur, b, 0.5, 0.1, s, motion, framing, scene, 0.0, 0.0, score, "gold", False)
    rows = spark.createDataFrame([row(0, 8.0, 0.3, 60.0, 3.5), row(1, 8.25, 0.31, 60.0, 4.5), row(2, 8.125, 0.3, 61.0, 6.25), row(3, 31.0, 0.9, 300.0, 6.5, "CLOSE", 7, 11.0)], TAKES)
    pairs = similarity.take_pairs(rows)
    assert collected(pairs, "segment_a", "segment_b", "relation") == [(0, 1, "same_take"), (0, 2, "same_take"), (1, 2, "same_take")]
    groups = similarity.take_groups(rows, pairs)
    assert {(r["index"], r.group_id, r.best_take, r.take_count) for r in groups.collect()} == {(i, 0, 2, 3) for i in range(3)}
    assert groups.first().discard_duration == pytest.approx(16.25)
    flagged = {r["index"]: r for r in similarity.recommend(similarity.flag_takes(rows, groups)).collect()}
    assert [flagged[i].recommendation for i in range(4)] == ["skip", "skip", "use", "use"] and flagged[3].is_best_take is None and flagged[2].take_alternatives == 2
    near = similarity.take_pairs(rows.withColumn("start_time", F.col("index") * 5.0))
    assert collected(near, "segment_a", "segment_b") == [(0, 2)]


def test_scenes(spark):
    rows = spark.createDataFrame([("v", i, 2.0 * i, 2.0, 0.3 if i < 3 else 0.8, 0.5, 0.1) for i in range(6)], "video_id string, index int, start_time double, duration double, brightness double, contrast double, edge_density double")
    found = similarity.scene_groups(rows).collect()
    assert {(r["index"], r.group_id, r.name) for r in found} == {(i, int(i > 2), "Setup A (Medio)" if i < 3 else "Setup B (Brillante)") for i in range(6)}
    pairs = {(r.segment_a, r.segment_b): r.distance for r in similarity.scene_pairs(rows).collect()}
    assert pairs[0, 1] == pytest.approx(0) and pairs[2, 3] == pytest.approx(0.81, abs=0.03)


def shots(spark, n=240, seed=5):
    """Two videos, one with most segments; values at, near and far from each other, nulls in every column that may be null."""
    rng = random.Random(seed)
    some = lambda x: None if rng.random() < 0.05 else x
    rows = []
    for i in range(n):
        light, edges = rng.choice([0.0, 0.2, 0.55, 1.0]) + rng.random() * 0.02, rng.choice([0.0, 0.1, 0.2999, 0.6, 0.95])
        rows.append(("hot" if i % 8 else "w", i, i * 7.5, some(rng.choice([0.0, 2.0, 2.5, 3.0, 4.0, 11.0]) + rng.random() / 8), some(min(light, 1.0)), some(rng.choice([0.1, 0.5, 0.9])), some(edges), some(rng.choice([20.0, 60.0, 400.0])), some(rng.choice([0.0, 1.0, 6.0])),
                     some(rng.choice(["DESCONOCIDO", "CLOSE", "WIDE"])), some(rng.choice([-1, 0, 1])), float(rng.randrange(3)), rng.random(), rng.random() * 10, "gold", False))
    return spark.createDataFrame(rows, TAKES)


@pytest.mark.parametrize("least,sure", [(0.6, 0.7), (0.6, 0.699999), (0.3, 0.45), (0.8, 0.85), (0.0, 0.0)])
def test_take_candidates_lose_no_pair(spark, least, sure, monkeypatch):
    rows = shots(spark)
    a, b = rows.alias("a"), rows.alias("b")
    every = a.join(b, (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.index") < F.col("b.index")) & (F.abs(F.col("a.start_time") - F.col("b.start_time")) >= 10))
    columns = ("video_id", "segment_a", "segment_b", "similarity", "confidence", "relation")
    found = collected(similarity.take_pairs(rows, 10.0, least, sure), *columns)
    if sure >= 0.7:
        assert similarity.take_candidates(rows, 10.0, least, sure).count() < every.count() * 0.75
    monkeypatch.setattr(similarity, "take_candidates", lambda *_: every)
    want = collected(similarity.take_pairs(rows, 10.0, least, sure), *columns)
    assert found == want and len(found) > 0


def test_scene_distances_without_pairs(spark):
    rows = shots(spark, 160)
    every = similarity.scene_pairs(rows).collect()
    close = collected(similarity.scene_pairs(rows, 0.25), "video_id", "segment_a", "segment_b")
    assert close == sorted((r.video_id, r.segment_a, r.segment_b) for r in every if r.distance < 0.25)
    found = {(r.video_id, r["index"]): r for r in similarity.scene_groups(rows).collect()}
    group = {k: r.group_id for k, r in found.items()}
    to = {}
    for r in every:
        for x, y in ((r.segment_a, r.segment_b), (r.segment_b, r.segment_a)):
            if group[r.video_id, x] == group[r.video_id, y]:
                to.setdefault((r.video_id, x), []).append(r.distance)
    mean = {k: sum(to.get(k, [0.0])) / len(to.get(k, [0.0])) for k in group}
    for k, r in found.items():
        members = [m for m in group if m[0] == k[0] and group[m] == group[k]]
        assert r.size == len(members) and r.consistency == pytest.approx(max(0.0, 1 - sum(mean[m] for m in members) / len(members)))
        assert mean[k[0], r.representative] == pytest.approx(min(mean[m] for m in members))
    assert similarity.scene_groups(rows.limit(0)).count() == 0 and similarity.take_pairs(rows.limit(0)).count() == 0


@pytest.mark.parametrize("tasks", [1, 3])
def test_equal_faces_have_one_leader(spark, tasks):
    rows = [(1, 0, k, 0.5, k != 2, 0, True) for k in (5, 2, 9, 7)] + [(1, 1, 1, None, True, 0, True), (1, 1, 2, 0.1, False, 0, True), (1, 2, 3, None, True, 0, True)]
    faces = spark.createDataFrame(rows, "video_id long, frame_idx long, face_no long, coverage double, in_focus boolean, issues long, eyes_open boolean")
    for ordered in (faces, faces.orderBy(F.desc("face_no"))):
        assert collected(scoring.faces_by_frame(ordered.repartition(tasks)), "frame_idx", "primary_face_in_focus") == [(0, False), (1, False), (2, None)]


def test_of_equal_faces_the_first_row_leads(spark, tmp_path):
    from intervalis.plans.catalogue import QUERIES

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(500).withColumn("l_extendedprice", F.lit(7.0)).drop("l_shipdate").toPandas()
    lines["l_orderkey"] = lines["l_orderkey"] % 20
    lines.to_parquet(tmp_path / "lineitem.parquet")
    want = {}
    for r in lines.itertuples():
        want.setdefault((r.l_orderkey, r.l_linenumber % 3), r.l_quantity > 25)
    assert {(r.video_id, r.frame_idx): r.primary_face_in_focus for r in QUERIES["faces_by_frame"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("active", [scoring.CATEGORIES, ("focus",), ()])
def test_criteria_apart_give_what_the_array_gives(spark, active):
    rnd = random.Random(3)
    names = "camera_motion_mean motion_mean motion_std sharpness_mean blurry_frame_pct brightness_mean contrast_mean h_balance v_balance avg_face_count eyes_closed_frame_pct".split()
    rows = [(k, tuple(rnd.choice([None, rnd.random() * s]) for s in (2, 2, 1, 200, 60, 1, 1, 1, 1, 2, 40))) for k in range(60)]
    df = spark.createDataFrame(rows, f"k int, metrics struct<{', '.join(f'{n}: double' for n in names)}>")
    h, v = F.col("metrics.h_balance"), F.col("metrics.v_balance")
    got = scoring.evaluate(df, active, lambda made: scoring.explained(made) | scoring.categorised(made, h, v))
    made = F.col("criteria")
    both = got.withColumns({"x": scoring.explanation(made), "y": scoring.category_scores(made, h, v), "z": scoring.weighted_score(made)}).collect()
    for r in both:
        assert (r.passed, r.failed, r.worst) == (r.x.passed, r.x.failed, r.x.worst)
        assert (r.stability, r.focus, r.exposure, r.framing) == pytest.approx((r.y.stability, r.y.focus, r.y.exposure, r.y.framing))
        assert r.score == pytest.approx(min(r.z, 3.0) if r.is_critically_blurry else r.z)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan


# --- timelines, documents, scalars ------------------------------------------------------------
def test_layouts_and_xml(spark):
    clips = spark.createDataFrame([("p", "a b.mp4", "/x/a b.mp4", 1.0, 3.0, "gold", 8.0, 1, 0.0), ("p", "a b.mp4", "/x/a b.mp4", 5.0, 6.0, "silver", 6.0, 2, 6.2), ("p", "c&d.mp4", "/x/c&d.mp4", 0.2, 2.2, "gold", 9.0, 3, 0.0)], "project_id string, filename string, path string, start_time double, end_time double, tier string, score double, clip_no int, file_duration double").withColumn("shot_type", F.lit("TILT"))
    wide = timeline.with_handles(clips, 0.5)
    assert collected(timeline.layout(wide, "sequence"), "clip_no", "timeline_start", "timeline_end") == [(1, 0.0, 3.0), (2, 3.0, 4.7), (3, 4.7, 7.4)]
    assert collected(timeline.layout(wide, "by_tier"), "clip_no", "track", "timeline_start") == [(1, 1, 0.0), (2, 2, 0.0), (3, 1, 3.0)]
    xml = timeline.sequence_xml(timeline.layout(wide, "sequence")).first().xml
    assert xml.count("<clipitem") == 3 and xml.count("<pathurl>") == 2 and "c&amp;d.mp4" in xml and "file://localhost/x/a%20b.mp4" in xml
    import xml.etree.ElementTree as tree

    tree.fromstring(xml)


@pytest.mark.parametrize("mode", ["sequence", "by_tier"])
def test_pieces_are_the_document(spark, mode):
    rows = [(f"p{k % 2}", f"v{k % 5}.mp4", "/x", float(k), k + 1.5, ("gold", "silver", "bronze")[k % 3], 8.0, k, 0.0) for k in range(40)]
    clips = spark.createDataFrame(rows, "project_id string, filename string, path string, start_time double, end_time double, tier string, score double, clip_no int, file_duration double")
    placed = timeline.layout(timeline.with_handles(clips.repartition(5), 0.5), mode)
    whole = {r.project_id: r.xml for r in timeline.sequence_xml(placed).collect()}
    pieces = {}
    for r in sorted(timeline.sequence_parts(placed).collect(), key=lambda r: (r.project_id, r.track, r.step, r.timeline_start or 0.0, r.position or 0)):
        pieces[r.project_id] = pieces.get(r.project_id, "") + r.text
    assert pieces == whole and len(whole) == 2


def test_documents(spark, tmp_path):
    doc = {"timestamp": "t", "project_id": "p", "stats": {"total": 1.5}, "analyses": [{"success": True, "filename": "a.mp4", "duration": 9.0, "segments": [{"start_time": 2.0, "end_time": 4.0, "duration": 2.0, "tier": "GOLD", "score": 8.0, "tags": ["x"]}, {"start_time": 0.0, "end_time": 2.0, "duration": 2.0, "tier": "silver"}]}, {"success": False, "filename": "b.mp4"}]}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=1))
    docs = documents.read_analyses(spark, str(tmp_path))
    segs = documents.segments_of(docs)
    assert collected(segs, "analysis_id", "filename", "index", "start_time", "tier") == [("one", "a.mp4", 0, 0.0, "silver"), ("one", "a.mp4", 1, 2.0, "gold")]
    assert documents.latest(docs).first().analysis_id == "one" and documents.history(docs).count() == 1
    back = documents.nested(segs.drop("project_id"), documents.videos_of(docs).drop("segments"))
    assert [len(v.segments) for v in back.first().analyses] == [2]
    assert documents.without_comments('{"//": 1, "a": {"// b": 2, "c": 3}}') == {"a": {"c": 3}}


def test_probe_and_rates(spark):
    probe = json.dumps({"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "h264", "r_frame_rate": "30000/1001", "avg_frame_rate": "0/0"}], "format": {"duration": "12.5"}})
    row = documents.probed(spark.createDataFrame([(probe,), ("{}",)], "probe string")).orderBy(F.desc("duration")).collect()
    assert (row[0].snapped_fps, row[0].duration, row[0].width, row[0].codec) == (30, 12.5, 1920, "h264") and round(row[0].fps, 3) == 29.97 and row[1].fps == 30.0


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(scalars.timecode(F.lit(3725.5))) == "01:02:05:15" and one(scalars.human_duration(F.lit(75.2))) == "1m 15s" and one(scalars.human_duration(F.lit(3725.0))) == "1h 2m"
    assert one(scalars.ascii_name(F.lit("Día ñ?.mp4"))) == "Dia_n_.mp4" and one(scalars.clean_name(F.lit("a b/c"))) == "a_bc"
    assert [one(scalars.estimate_seconds(F.lit(d))) for d in (0.0, 1.0, 20.0, 100.0)] == [5, 5, 19, 77]
    assert one(scalars.leading_tags(F.array(*map(F.lit, ["z", "persona", "y", "entrevista", "w"])))) == ["persona", "entrevista", "z", "y"]
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    ages = [one(scalars.relative_age(F.lit(t).cast("timestamp"), now)) for t in ("2024-01-10 11:50:00", "2024-01-10 02:00:00", "2024-01-09 11:00:00", "2024-01-06 12:00:00")]
    assert ages == ["Hace 10 min", "Hace 10h", "Ayer", "Hace 4 días"]


def test_pixels(spark):
    rnd = np.random.default_rng(0)
    noisy = rnd.integers(0, 256, (40, 60, 3), dtype=np.uint8)
    rows = [("v", 0, 40, 60, bytearray(np.zeros((40, 60, 3), np.uint8).tobytes())), ("v", 1, 40, 60, bytearray(noisy.tobytes()))]
    found = pixels.measure_frames(spark.createDataFrame(rows, "video_id string, frame_idx int, height int, width int, pixels binary")).orderBy("frame_idx").collect()
    assert found[0].brightness == 0 and found[0].underexposed_pct == 1 and found[0].sharpness == 0 and found[0].texture_score == 0.5
    assert found[1].brightness == pytest.approx(noisy.max(axis=2).mean() / 255) and found[1].sharpness > 1000
    wave = [math.sin(2 * math.pi * 2 * i / 10) for i in range(20)]
    out = spark.createDataFrame([(wave,), ([1.0] * 5,)], "h array<double>").select(pixels.motion_spectrum(F.col("h")).alias("s")).collect()
    assert out[0].s.dominant_frequency == pytest.approx(2.0) and out[0].s.tremor_power == 0 and out[1].s.dominant_frequency is None


def test_segment_metrics_ignore_missing(spark):
    schema = "video_id string, segment_no int, motion_magnitude double, motion_direction double, direction_consistency double, horizontal_component double, vertical_component double, brightness double, contrast double, dominant_frequency double, tremor_power double, sharpness double, is_blurry boolean, edge_density double, face_count int, primary_face_coverage double, any_eyes_closed boolean, framing_issues_count int, primary_face_in_focus boolean, camera_motion double, object_motion double, motion_uniformity double, is_camera_shake boolean"
    empty = ("v", 1) + (None,) * 21
    full = ("v", 1, 2.0, 0.0, 0.5, 3.0, 1.0, 0.2, 0.1, None, None, 50.0, True, None, 2, 0.1, True, 1, True, 1.0, 0.0, 0.9, True)
    row = rollups.segment_metrics(spark.createDataFrame([empty, full], schema)).first()
    assert row.motion_mean == 2.0 and row.brightness_mean == 0.2 and row.edge_density == 0.1 and row.tremor_power == 0 and row.blurry_frame_pct == 100 and row.has_camera_shake and row.horizontal_dominance == pytest.approx(0.75, abs=1e-3)
