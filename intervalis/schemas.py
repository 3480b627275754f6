"""Schemas of the domain tables and the enumerations that name their values."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"double": T.DoubleType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _struct(kind: str, names: str) -> list[T.StructField]:
    return [T.StructField(name, _TYPES[kind]) for name in names.split()]


METRICS = T.StructType(
    _struct(
        "double",
        "motion_mean motion_std motion_max direction_mean direction_consistency horizontal_dominance vertical_dominance speed_consistency brightness_mean brightness_std "
        "contrast_mean dominant_frequency tremor_power sharpness_mean sharpness_min sharpness_std blurry_frame_pct edge_density avg_face_count avg_face_coverage "
        "eyes_closed_frame_pct avg_framing_issues faces_in_focus_pct camera_motion_mean object_motion_mean motion_uniformity camera_shake_pct",
    )
    + _struct("boolean", "is_segment_blurry any_eyes_closed_in_segment has_camera_shake")
)
FACE_ANALYSIS = T.StructType(
    _struct("boolean", "has_faces any_eyes_closed") + _struct("double", "avg_face_count faces_in_focus_pct eyes_closed_frame_pct avg_framing_issues primary_face_coverage")
)
SEGMENT = T.StructType(
    _struct("double", "start_time end_time duration score")
    + _struct("string", "shot_type tier framing_type framing_type_display action garbage_type scene_group_name auto_description key_moment_type key_moment_reason")
    + _struct("int", "face_count scene_group_id take_group_id take_alternatives")
    + _struct("boolean", "any_eyes_closed is_blurry has_issue is_garbage is_best_take is_repeated_take is_key_moment")
    + [T.StructField("metrics", METRICS), T.StructField("face_analysis", FACE_ANALYSIS), T.StructField("tags", T.ArrayType(T.StringType()))]
)
VIDEO_RESULT = T.StructType(
    _struct("boolean", "success") + _struct("string", "filename path") + _struct("double", "duration fps timeline_offset") + _struct("int", "width height") + [T.StructField("segments", T.ArrayType(SEGMENT))]
)
ANALYSIS_DOCUMENT = T.StructType(
    _struct("string", "timestamp version project_id") + [T.StructField("stats", T.MapType(T.StringType(), T.DoubleType())), T.StructField("analyses", T.ArrayType(VIDEO_RESULT))]
)
PROJECT = T.StructType(
    _struct("string", "id name preset notes") + _struct("timestamp", "created_at updated_at")
    + [T.StructField("analyses", T.ArrayType(T.StringType())), T.StructField("stats", T.StructType(_struct("int", "total_videos") + _struct("double", "total_duration gold_duration silver_duration")))]
)
GARBAGE_FLAGS = T.StructType(_struct("boolean", "is_black is_uniform is_white is_lens_cap is_likely_sky is_likely_ground"))
FRAME = T.StructType(
    _struct("string", "video_id") + _struct("int", "frame_idx face_count framing_issues_count")
    + _struct(
        "double",
        "timestamp motion_magnitude motion_direction direction_consistency horizontal_component vertical_component camera_motion object_motion motion_uniformity brightness "
        "contrast variance edge_density saturation sharpness primary_face_coverage dominant_frequency tremor_power",
    )
    + _struct("boolean", "is_camera_shake is_blurry any_eyes_closed primary_face_in_focus") + [T.StructField("garbage_flags", GARBAGE_FLAGS)]
)

# Fixed values of the domain: names, ranks and labels that stored tables use.
TIER_RANK = {"gold": 4, "silver": 3, "bronze": 2, "discard": 1, "garbage": 0}
TIER_LABEL = {"gold": "Forest", "silver": "Iris", "bronze": "Mango", "discard": "Rose"}
MOVEMENT_TYPES = ("ESTATICA", "PANEO", "TILT", "TRACKING", "MOVIMIENTO_FLUIDO", "SHAKY", "TRANSICION")
FRAMING = {
    "PLANO_GENERAL_EXTREMO": "EWS", "PLANO_GENERAL": "WS", "PLANO_AMERICANO": "MWS", "PLANO_MEDIO": "MS", "PLANO_MEDIO_CORTO": "MCU", "PRIMER_PLANO": "CU",
    "PRIMERÍSIMO_PLANO": "ECU", "PLANO_DETALLE": "DET", "OVER_THE_SHOULDER": "OTS", "PUNTO_DE_VISTA": "POV", "PLANO_DOS": "2S", "PLANO_GRUPO": "GRP", "INSERT": "INS", "DESCONOCIDO": "?",
}
GARBAGE_PRIORITY = {
    "lens_cap": 10, "black_frame": 9, "whiteout": 9, "exposure_flash": 8, "sky_shot": 7, "ground_shot": 7, "cut_at_start": 6, "cut_at_end": 6,
    "pre_roll": 5, "post_roll": 5, "uniform_frame": 4, "accidental": 3,
}
KEY_MOMENTS = {"best_quality": "mejor_calidad", "unique_content": "contenido_unico"}
TAKE_RELATIONS = (("same_take", 0.90), ("repeated_take", 0.85), ("similar_shot", 0.60))
