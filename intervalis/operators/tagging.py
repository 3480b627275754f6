"""Tags, descriptions and key moments of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervalis.operators.scoring import ladder, metric
from intervalis.schemas import KEY_MOMENTS


def _tag(name: str, category: str, when: Column, confidence: Column | float = 1.0, source: str = "auto") -> Column:
    sure = F.lit(confidence) if isinstance(confidence, float) else F.least(confidence, F.lit(1.0))
    made = F.array(F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), sure.cast("double").alias("confidence"), F.lit(source).alias("source")))
    return F.when(when, made).otherwise(F.array().cast("array<struct<name:string,category:string,confidence:double,source:string>>"))


def tag_structs() -> Column:
    """All tags of a segment, in the order content, context, quality, composition."""
    faces, cover = metric("avg_face_count", 0, "face_analysis"), metric("primary_face_coverage", 0, "face_analysis")
    framing, shot = F.upper(F.coalesce("framing_type", F.lit(""))), F.upper(F.coalesce("shot_type", F.lit("")))
    motion, std, sharp = metric("motion_mean"), metric("motion_std"), metric("sharpness_mean", 100)
    light, contrast, edges = metric("brightness_mean", 0.5), metric("contrast_mean", 0.5), metric("edge_density", 0.1)
    wide = framing.contains("WIDE") | framing.contains("GENERAL")
    medium = ~wide & (framing.contains("MEDIUM") | framing.contains("MEDIO"))
    close = ~wide & ~medium & (framing.contains("CLOSE") | framing.contains("PRIMER"))
    detail = ~wide & ~medium & ~close & (framing.contains("DETAIL") | framing.contains("DETALLE"))
    calm = F.coalesce(F.col("metrics.motion_mean"), F.lit(10.0)) < 2
    steady = (shot == "ESTATICA") | (std < 0.5)
    outline = F.coalesce(F.col("metrics.edge_density"), F.lit(0.0)) < 0.15
    framed = F.coalesce(F.col("face_analysis.has_faces"), F.lit(False)) & (metric("avg_framing_issues", 0, "face_analysis") == 0)
    made = [
        _tag("persona", "content", faces > 0, faces), _tag("varias_personas", "content", faces >= 2, faces / 2), _tag("rostro_visible", "content", faces > 0),
        _tag("primer_plano_rostro", "content", (faces > 0) & (cover >= 0.15), cover / 0.25), _tag("entrevista", "content", (faces > 0) & (cover >= 0.08) & calm, 0.7, "inferred"),
        _tag("plano_general", "content", wide), _tag("plano_medio", "content", medium), _tag("primer_plano", "content", close), _tag("plano_detalle", "content", detail),
        _tag("estatico", "content", motion < 1), _tag("accion", "content", motion > 5, motion / 10), _tag("con_movimiento", "content", motion.between(1, 5)),
        _tag("movimiento_camara", "content", shot.isin("PANEO", "TILT", "TRACKING")),
        _tag("iluminado", "context", light >= 0.65, (light - 0.5) * 2), _tag("posible_exterior", "context", light > 0.7, 0.5, "inferred"),
        _tag("oscuro", "context", light <= 0.35, (0.5 - light) * 2), _tag("posible_interior", "context", light <= 0.35, 0.4, "inferred"),
        _tag("alto_contraste", "context", contrast >= 0.6), _tag("bajo_contraste", "context", contrast <= 0.3),
        _tag("contraluz", "context", (light > 0.6) & (contrast > 0.5) & outline, 0.6, "inferred"),
        _tag("nitido", "quality", sharp >= 100), _tag("en_foco", "quality", sharp >= 100), _tag("borroso", "quality", sharp <= 50), _tag("fuera_de_foco", "quality", sharp <= 50),
        _tag("enfoque_suave", "quality", (sharp > 50) & (sharp < 100)),
        _tag("bien_expuesto", "quality", light.between(0.35, 0.70)), _tag("sobreexpuesto", "quality", light > 0.80), _tag("subexpuesto", "quality", light < 0.20),
        _tag("estable", "quality", steady), _tag("tembloroso", "quality", ~steady & ((std > 3) | shot.contains("SHAKY"))),
        _tag("complejo_visualmente", "composition", edges > 0.25, edges / 0.4), _tag("minimalista", "composition", edges < 0.08, 0.7), _tag("rostro_bien_encuadrado", "composition", framed),
    ]
    return F.concat(*made)  # arrays of one or none: compiled code, where a filter by a lambda is not


def description() -> Column:
    """A line about a segment: framing, people, movement, quality."""
    faces = metric("avg_face_count", 0, "face_analysis")
    people = F.when(faces >= 2, F.format_string("con %d personas", F.floor(faces))).when(faces >= 1, "con persona")
    shot, tier = F.col("shot_type"), F.lower("tier")
    moves = ladder((shot == "PANEO", "con paneo"), (shot == "TILT", "con tilt"), (shot == "TRACKING", "con seguimiento"), (shot == "ESTATICA", "estática"))
    quality = ladder((tier == "gold", "(excelente)"), (tier == "silver", "(buena)"), (tier == "discard", "(descartable)"))
    line = F.concat_ws(", ", F.when(F.col("framing_type_display") != "", F.col("framing_type_display")), people, moves, quality)
    return F.when(line == "", "Segmento sin clasificar").otherwise(line)


def tag_segments(segments: DataFrame) -> DataFrame:
    """``segments`` with tag_structs, tags (their distinct names) and auto_description."""
    rows = segments.withColumn("tag_structs", tag_structs())
    return rows.withColumn("tags", F.array_distinct(F.col("tag_structs")["name"])).withColumn("auto_description", description())


def by_category(tags: Column, category: str) -> Column:
    """The tags of one category; rows left empty can be dropped by their size."""
    return F.filter(tags, lambda t: t["category"] == category)


def with_tag(segments: DataFrame, tag: str) -> DataFrame:
    return segments.filter(F.coalesce(F.array_contains("tags", tag), F.lit(False)))


def key_moments(segments: DataFrame, best: float = 7.5, unique: float = 7.0) -> DataFrame:
    """Key moments by time: a video's best segment, and good ones without another take; one per segment, the former first."""
    open_ = segments.filter(~F.coalesce("is_garbage", F.lit(False)) & ~F.coalesce(F.lower("tier").isin("garbage", "discard"), F.lit(False)) & F.col("take_group_id").isNull())
    first = Window.partitionBy("video_id").orderBy(F.desc("score"), "index")
    top = open_.withColumn("r", F.row_number().over(first)).filter((F.col("r") == 1) & (F.col("score") >= best)).drop("r").withColumn("priority", F.lit(0)).withColumn("moment", F.lit(KEY_MOMENTS["best_quality"]))
    shown = F.coalesce(F.col("face_analysis.has_faces"), F.lit(False)) | ~F.coalesce("framing_type", F.lit("")).isin("DESCONOCIDO", "")
    rare = open_.filter((F.col("score") >= unique) & shown).withColumn("priority", F.lit(1)).withColumn("moment", F.lit(KEY_MOMENTS["unique_content"]))
    columns = ["video_id", "index", F.col("start_time").alias("timestamp"), "score", "moment", "priority"]
    both = top.select(*columns).unionByName(rare.select(*columns))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("video_id", "index").orderBy("timestamp", "priority"))).filter("r = 1").drop("r", "priority")


def moments_of(moments: DataFrame, kind: str) -> DataFrame:
    """Key moments of a kind by its stored or its English name."""
    return moments.filter(F.col("moment") == KEY_MOMENTS.get(kind, kind))


def flag_moments(segments: DataFrame, moments: DataFrame) -> DataFrame:
    found = moments.select("video_id", "index", F.col("moment").alias("key_moment_type"))
    rows = segments.drop("key_moment_type", "is_key_moment").join(found, ["video_id", "index"], "left")
    return rows.withColumn("is_key_moment", F.col("key_moment_type").isNotNull())
