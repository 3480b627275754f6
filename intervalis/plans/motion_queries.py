"""Queries of tracked points, tiles and frame classes.

Order lines stand for points: 64 order keys make a frame. Most points follow a
map with perspective; those with a high discount move on their own, and those
of the highest tax are lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervalis.operators import motion
from intervalis.plans.register import Register
from intervalis.plans.views import table

REGISTER = Register()
HYPOTHESES = 24


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").withColumns({"video_id": F.floor(k / 1024), "frame_idx": F.floor(k / 64), "point_no": k * 8 + F.col("l_linenumber")})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_partkey") * 37 % 480 + F.col("l_linenumber") * 0.5, F.col("l_suppkey") * 53 % 270 + F.col("l_linenumber") * 0.25
    rows = _lines(spark, sf_dir).withColumns({"x": x.cast("double"), "y": y.cast("double")})
    own, there = F.col("l_discount") >= 0.08, F.col("l_tax") < 0.075
    w = 1 + F.col("x") / 10000
    nx = (F.col("x") * 1.01 + F.col("frame_idx") % 5 * 2 - 3) / w + F.when(own, 15.0 + F.col("l_linenumber")).otherwise(0.0)
    ny = (F.col("y") * 1.01 + F.col("frame_idx") % 3 - 1) / w - F.when(own, 9.0).otherwise(0.0)
    return rows.select("video_id", "frame_idx", "point_no", "x", "y", F.when(there, nx).alias("nx"), F.when(there, ny).alias("ny"))


POINTS_SQL = """pts AS (
    SELECT video_id, frame_idx, point_no, x, y, CASE WHEN l_tax < 0.075 THEN (x * 1.01 + frame_idx % 5 * 2 - 3) / (1 + x / 10000) + CASE WHEN own THEN 15.0::DOUBLE + l_linenumber ELSE 0 END END AS nx,
           CASE WHEN l_tax < 0.075 THEN (y * 1.01 + frame_idx % 3 - 1) / (1 + x / 10000) - CASE WHEN own THEN 9.0::DOUBLE ELSE 0 END END AS ny
    FROM (SELECT l_orderkey // 1024 AS video_id, l_orderkey // 64 AS frame_idx, l_orderkey * 8 + l_linenumber AS point_no, (l_partkey * 37 % 480 + l_linenumber * 0.5)::DOUBLE AS x,
                 (l_suppkey * 53 % 270 + l_linenumber * 0.25)::DOUBLE AS y, l_tax, l_discount >= 0.08 AS own, l_linenumber FROM lineitem))"""
FLOW_SQL = """flow AS (
    SELECT video_id, frame_idx, tracked, found, CASE WHEN ok THEN m ELSE 0 END AS motion_magnitude, CASE WHEN ok THEN a ELSE 0 END AS motion_direction, CASE WHEN ok THEN sd ELSE 0 END AS direction_spread,
           CASE WHEN ok THEN greatest(0, 1 - sd / pi()) ELSE 0 END AS direction_consistency, CASE WHEN ok THEN hx ELSE 0 END AS horizontal_component, CASE WHEN ok THEN vy ELSE 0 END AS vertical_component,
           CASE WHEN ok THEN atan2(s, c) ELSE 0 END AS circular_direction, CASE WHEN ok THEN sqrt(c * c + s * s) ELSE 0 END AS resultant
    FROM (SELECT video_id, frame_idx, count(*) AS tracked, count(nx) AS found, count(*) >= 10 AND count(nx) >= 5 AS ok, avg(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS m, avg(atan2(ny - y, nx - x)) AS a,
                 stddev_pop(atan2(ny - y, nx - x)) AS sd, avg(abs(nx - x)) AS hx, avg(abs(ny - y)) AS vy, avg(cos(atan2(ny - y, nx - x))) AS c, avg(sin(atan2(ny - y, nx - x))) AS s
          FROM pts GROUP BY ALL))"""


def _camera_sql() -> str:
    """The definition, hypothesis by hypothesis: four slots, the map of the unit square on both sides, all points tried."""
    triples = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]
    sound = " AND ".join(f"abs((p{b}[{i}] - p{a}[{i}]) * (p{c}[{j}] - p{a}[{j}]) - (p{c}[{i}] - p{a}[{i}]) * (p{b}[{j}] - p{a}[{j}])) >= 1" for i, j in ((2, 3), (4, 5)) for a, b, c in triples)

    def square(i: int, j: int, side: str) -> str:
        ax, bx, sx = f"(p1[{i}] - p2[{i}])", f"(p3[{i}] - p2[{i}])", f"(p0[{i}] - p1[{i}] + p2[{i}] - p3[{i}])"
        ay, by, sy = f"(p1[{j}] - p2[{j}])", f"(p3[{j}] - p2[{j}])", f"(p0[{j}] - p1[{j}] + p2[{j}] - p3[{j}])"
        det = f"nullif({ax} * {by} - {bx} * {ay}, 0)"
        return f"({sx} * {by} - {bx} * {sy}) / {det} AS {side}6, ({ax} * {sy} - {sx} * {ay}) / {det} AS {side}7"

    def rest(i: int, j: int, side: str) -> str:
        return f"p1[{i}] - p0[{i}] + {side}6 * p1[{i}] AS {side}0, p3[{i}] - p0[{i}] + {side}7 * p3[{i}] AS {side}1, p0[{i}] AS {side}2, p1[{j}] - p0[{j}] + {side}6 * p1[{j}] AS {side}3, p3[{j}] - p0[{j}] + {side}7 * p3[{j}] AS {side}4, p0[{j}] AS {side}5"

    u = "((s4 - s5 * s7) * x + (s2 * s7 - s1) * y + (s1 * s5 - s2 * s4))"
    v = "((s5 * s6 - s3) * x + (s0 - s2 * s6) * y + (s2 * s3 - s0 * s5))"
    w = "((s3 * s7 - s4 * s6) * x + (s1 * s6 - s0 * s7) * y + (s0 * s4 - s1 * s3))"
    below = f"nullif(d6 * {u} + d7 * {v} + {w}, 0)"
    return f"""good AS (SELECT * FROM pts WHERE nx IS NOT NULL AND ny IS NOT NULL),
    drawn AS (SELECT *, ((point_no % 1000003 + 1) * (2 * h + 12345) * 48271 + frame_idx % 1000003 * 16807 + h * 69621) % 2147483647 * 48271 % 2147483647 AS r FROM good, range({HYPOTHESES}) AS g(h)),
    picked AS (SELECT video_id, frame_idx, h, {", ".join(f"min([r::DOUBLE, x, y, nx, ny]) FILTER (r % 4 = {k}) AS p{k}" for k in range(4))} FROM drawn GROUP BY ALL),
    half AS (SELECT *, {square(2, 3, "s")}, {square(4, 5, "d")} FROM picked WHERE {sound}),
    models AS (SELECT *, {rest(2, 3, "s")}, {rest(4, 5, "d")} FROM half),
    tried AS (
        SELECT g.*, m.h, coalesce(((d0 * {u} + d1 * {v} + d2 * {w}) / {below} - nx) ** 2 + ((d3 * {u} + d4 * {v} + d5 * {w}) / {below} - ny) ** 2 <= 9, false) AS fits, sqrt((nx - x) ** 2 + (ny - y) ** 2) AS moved
        FROM good g JOIN models m USING (video_id, frame_idx)),
    won AS (SELECT video_id, frame_idx, h FROM (SELECT video_id, frame_idx, h, count(*) FILTER (fits) AS n FROM tried GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY n DESC, h) = 1),
    split AS (SELECT video_id, frame_idx, avg(fits::INT) AS u, avg(moved) FILTER (fits) AS c, avg(moved) FILTER (NOT fits) AS o FROM tried SEMI JOIN won USING (video_id, frame_idx, h) GROUP BY ALL),
    cam AS (
        SELECT flow.*, CASE WHEN found >= 8 AND tracked >= 10 THEN coalesce(u, 0) ELSE 0 END AS motion_uniformity, CASE WHEN found >= 8 AND tracked >= 10 THEN coalesce(c, 0) ELSE 0 END AS camera_motion,
               CASE WHEN found >= 8 AND tracked >= 10 THEN coalesce(o, 0) ELSE 0 END AS object_motion
        FROM flow LEFT JOIN split USING (video_id, frame_idx))"""


REGISTER.add("flow_statistics", lambda s, d: motion.flow_statistics(points(s, d)), "SELECT * FROM flow", POINTS_SQL, FLOW_SQL)
REGISTER.add(
    "camera_motion", lambda s, d: motion.camera_motion(points(s, d), HYPOTHESES),
    "SELECT *, camera_motion > 1.5 AND motion_uniformity > 0.7 AND (direction_consistency < 0.5 OR direction_spread > 0.8) AS is_camera_shake FROM cam", POINTS_SQL, FLOW_SQL, _camera_sql(),
)


# --- tiles ------------------------------------------------------------------------------------


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's lines as tiles of a grid of seven by six, so that borders of thirds cut tiles; some cells are missing, some there twice."""
    c, r = F.col("l_partkey") % 7, F.col("l_suppkey") % 6
    strong = F.when((c >= 2) & (c <= 4), F.col("frame_idx") % 4 + 1).otherwise(1)
    return _lines(spark, sf_dir).select(
        "video_id", "frame_idx", (c / 7).alias("left"), (r / 6).alias("top"), ((c + 1) / 7).alias("right"), ((r + 1) / 6).alias("bottom"),
        (F.col("l_discount") * (1 + F.col("frame_idx") % 5)).cast("double").alias("edges"), F.col("l_tax").cast("double").alias("lap_mean"), (F.col("l_quantity") * strong).cast("double").alias("lap_var"),
    )


TILES_SQL = """til AS (
    SELECT l_orderkey // 1024 AS video_id, l_orderkey // 64 AS frame_idx, (l_partkey % 7) / 7 AS l, (l_suppkey % 6) / 6 AS t, (l_partkey % 7 + 1) / 7 AS r, (l_suppkey % 6 + 1) / 6 AS b,
           (l_discount * (1 + l_orderkey // 64 % 5))::DOUBLE AS edges, l_tax::DOUBLE AS mean, (l_quantity * CASE WHEN l_partkey % 7 BETWEEN 2 AND 4 THEN l_orderkey // 64 % 4 + 1 ELSE 1 END)::DOUBLE AS var
    FROM lineitem)"""


def _area(left: str, top: str, right: str, bottom: str) -> str:
    return f"greatest(0, least(r, {right}) - greatest(l, {left})) * greatest(0, least(b, {bottom}) - greatest(t, {top}))"


def _weights() -> str:
    thirds = ["0", "1::DOUBLE / 3", "2::DOUBLE / 3", "1"]
    cells = [(r, c, _area(thirds[c], thirds[r], thirds[c + 1], thirds[r + 1])) for r in range(3) for c in range(3)]
    return ", ".join(f"coalesce(sum({a} * edges) / nullif(sum({a}), 0), 0) * 255 AS w{r}{c}" for r, c, a in cells)


COMPOSITION_SQL = f"""com AS (
    SELECT video_id, frame_idx, 1 - abs(w00 + w10 + w20 - w02 - w12 - w22) / (w00 + w10 + w20 + w02 + w12 + w22 + 0.001) AS h_balance,
           1 - abs(w00 + w01 + w02 - w20 - w21 - w22) / (w00 + w01 + w02 + w20 + w21 + w22 + 0.001) AS v_balance, (w10 + w12 + w01 + w21) / 4 AS thirds_interest, e AS edge_density
    FROM (SELECT video_id, frame_idx, {_weights()}, coalesce(sum({_area("0", "0", "1", "1")} * edges) / nullif(sum({_area("0", "0", "1", "1")}), 0), 0) AS e FROM til GROUP BY ALL))"""
_BOXES = {"ce": (0.25, 0.25, 0.75, 0.75), "up": (0, 0, 1, 0.25), "dn": (0, 0.75, 1, 1), "le": (0, 0, 0.25, 1), "ri": (0.75, 0, 1, 1), "fl": (0, "2::DOUBLE / 3", "1::DOUBLE / 3", 1), "fr": ("2::DOUBLE / 3", "2::DOUBLE / 3", 1, 1)}
_BOXES["mi"] = ("1::DOUBLE / 3", "1::DOUBLE / 3", "2::DOUBLE / 3", "2::DOUBLE / 3")


def _variance(name: str) -> str:
    a = _area(*map(str, _BOXES[name]))
    mean = f"sum({a} * mean) / nullif(sum({a}), 0)"
    return f"coalesce(greatest(0, sum({a} * (var + mean * mean)) / nullif(sum({a}), 0) - ({mean}) * ({mean})), 0) AS {name}"


DEPTH_SQL = f"""dep AS (
    SELECT *, center_sharpness / (edge_sharpness + 0.001) AS sharpness_ratio, coalesce(1 - foreground_sharpness / nullif(middle_sharpness, 0), 0) AS foreground_blur_ratio,
           center_sharpness / (edge_sharpness + 0.001) > 1.5 AS is_shallow_dof, coalesce(1 - foreground_sharpness / nullif(middle_sharpness, 0), 0) > 0.3 AS has_foreground_element
    FROM (SELECT video_id, frame_idx, ce AS center_sharpness, (up + dn + le + ri) / 4 AS edge_sharpness, (fl + fr) / 2 AS foreground_sharpness, mi AS middle_sharpness
          FROM (SELECT video_id, frame_idx, {", ".join(map(_variance, _BOXES))} FROM til GROUP BY ALL)))"""

REGISTER.add("composition", lambda s, d: motion.composition(tiles(s, d)), "SELECT * FROM com", TILES_SQL, COMPOSITION_SQL)
REGISTER.add("depth_of_field", lambda s, d: motion.depth_of_field(tiles(s, d)), "SELECT * FROM dep", TILES_SQL, DEPTH_SQL)


def frame_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four of a frame's lines are faces; many frames have none."""
    rows = _lines(spark, sf_dir).filter((F.col("l_orderkey") % 64 < F.col("frame_idx") % 5 * 2) & (F.col("l_linenumber") == 1))
    place = F.when(F.col("l_partkey") % 5 == 0, "top").when(F.col("l_partkey") % 5 == 1, "left").when(F.col("l_partkey") % 5 == 2, "bottom").otherwise("center")
    return rows.select("video_id", "frame_idx", (F.col("point_no") * 4096 + F.col("l_partkey") % 4096).alias("face_no"), (F.col("l_discount") * 4).cast("double").alias("coverage"), place.alias("position"), (F.col("l_linestatus") == "O").alias("in_focus"), (F.col("l_tax") > 0.04).alias("is_partial"))


FACES_SQL = """fac AS (
    SELECT video_id, frame_idx, count(*)::INT AS face_count, arg_max({'c': c, 'p': p, 'f': f, 'q': q}, [c, -no]) AS lead
    FROM (SELECT l_orderkey // 1024 AS video_id, l_orderkey // 64 AS frame_idx, ((l_orderkey * 8 + l_linenumber) * 4096 + l_partkey % 4096)::DOUBLE AS no, (l_discount * 4)::DOUBLE AS c, l_linestatus = 'O' AS f, l_tax > 0.04 AS q,
                 CASE l_partkey % 5 WHEN 0 THEN 'top' WHEN 1 THEN 'left' WHEN 2 THEN 'bottom' ELSE 'center' END AS p
          FROM lineitem WHERE l_orderkey % 64 < l_orderkey // 64 % 5 * 2 AND l_linenumber = 1)
    GROUP BY ALL)"""
REGISTER.add(
    "frame_classes",
    lambda s, d: motion.frame_classes(tiles(s, d), frame_faces(s, d), motion.flow_statistics(points(s, d)).withColumn("motion_magnitude", F.col("motion_magnitude") * (F.col("frame_idx") % 2))).withColumn("characteristics", F.array_join("characteristics", " ")),
    """SELECT video_id, frame_idx, shot_type, confidence::DOUBLE AS confidence, face_count, primary_face_coverage,
        concat_ws(' ', CASE WHEN is_shallow_dof THEN 'shallow_dof' END, CASE WHEN lead.f THEN 'face_in_focus' END, CASE WHEN lead.q THEN 'face_partial' END, CASE WHEN shot_type = 'OVER_THE_SHOULDER' THEN 'foreground_blur' END,
                  CASE WHEN shot_type = 'PUNTO_DE_VISTA' THEN 'pov_motion' END, CASE WHEN shot_type = 'PLANO_DETALLE' THEN 'high_detail' END, CASE WHEN shot_type = 'PLANO_GENERAL_EXTREMO' THEN 'low_detail' END) AS characteristics
       FROM (SELECT *, split_part(k, '|', 1) AS shot_type, split_part(k, '|', 2) AS confidence FROM (
        SELECT * EXCLUDE (face_count), coalesce(fac.face_count, 0) AS face_count, coalesce(lead.c, 0) AS primary_face_coverage,
            CASE WHEN lead IS NOT NULL THEN CASE WHEN has_foreground_element AND lead.p IN ('left', 'right', 'center') THEN 'OVER_THE_SHOULDER|0.75' WHEN fac.face_count >= 3 THEN 'PLANO_GRUPO|0.85' WHEN fac.face_count = 2 THEN 'PLANO_DOS|0.85'
                    WHEN lead.c >= 0.35 THEN 'PRIMERÍSIMO_PLANO|0.9' WHEN lead.c >= 0.15 THEN 'PRIMER_PLANO|0.85' WHEN lead.c >= 0.08 THEN 'PLANO_MEDIO_CORTO|0.8' WHEN lead.c >= 0.04 THEN 'PLANO_MEDIO|0.75' WHEN lead.c >= 0.02 THEN 'PLANO_AMERICANO|0.7' ELSE 'PLANO_GENERAL|0.65' END
                 WHEN motion_magnitude * (frame_idx % 2) > 1.5 AND vertical_component > 0.3 THEN 'PUNTO_DE_VISTA|0.7' WHEN edge_density > 0.15 AND is_shallow_dof THEN 'PLANO_DETALLE|0.75' WHEN edge_density > 0.1 THEN 'INSERT|0.6'
                 WHEN edge_density < 0.08 THEN 'PLANO_GENERAL_EXTREMO|0.7' ELSE 'PLANO_GENERAL|0.5' END AS k
        FROM com JOIN dep USING (video_id, frame_idx) LEFT JOIN fac USING (video_id, frame_idx) LEFT JOIN flow USING (video_id, frame_idx)))""",
    TILES_SQL, COMPOSITION_SQL, DEPTH_SQL, FACES_SQL, POINTS_SQL, FLOW_SQL,
)
