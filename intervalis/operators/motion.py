"""Camera and object motion from a table of tracked points; composition and depth of field from a table of tiles.

Points are (video_id, frame_idx, point_no, x, y, nx, ny): where a point was and
where it is in the next frame, nx and ny null if it was lost. Tiles are
(video_id, frame_idx, left, top, right, bottom, ...) with borders as parts of
the frame, any grid. A frame's rows may be spread over tasks: all figures are
sums, least and greatest values that are combined after partial aggregation.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervalis.operators.scoring import ladder
from intervalis.plans.scratch import dealt, materialize

FRAME = ["video_id", "frame_idx"]
#: Least tracked and least found points of a frame with motion, least found points of a camera model, and its tolerance in pixels.
LEAST_TRACKED, LEAST_FOUND, LEAST_MODEL, TOLERANCE = 10, 5, 8, 3.0
#: A sample of four points must not have three of them nearly on a line: least doubled area of each triangle, in square pixels.
LEAST_AREA = 1.0
HYPOTHESES = 64


def _vectors(points: DataFrame) -> DataFrame:
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    return points.select(*FRAME, "point_no", "x", "y", "nx", "ny", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("moved"), F.when(dx.isNotNull() & dy.isNotNull(), F.atan2(dy, dx)).alias("angle"))


def flow_statistics(points: DataFrame) -> DataFrame:
    """Per frame: points tracked and found, mean magnitude and direction, spread and consistency of directions, mean components.

    ``circular_direction`` and ``resultant`` (0 scattered, 1 all alike) are of the unit vectors, so that
    directions on both sides of pi meet. Frames of fewer than 10 tracked or 5 found points have no motion:
    their figures are 0.
    """
    found = _vectors(points).groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("tracked"), F.count("angle").alias("found"), F.avg("moved").alias("magnitude"), F.avg("angle").alias("direction"), F.stddev_pop("angle").alias("spread"),
        F.avg(F.abs("dx")).alias("horizontal"), F.avg(F.abs("dy")).alias("vertical"), F.avg(F.cos("angle")).alias("c"), F.avg(F.sin("angle")).alias("s"),
    )
    moving = (F.col("tracked") >= LEAST_TRACKED) & (F.col("found") >= LEAST_FOUND)
    zero = lambda c: F.when(moving, c).otherwise(0.0)
    return found.select(
        *FRAME, "tracked", "found", zero(F.col("magnitude")).alias("motion_magnitude"), zero(F.col("direction")).alias("motion_direction"), zero(F.col("spread")).alias("direction_spread"),
        zero(F.greatest(F.lit(0.0), 1 - F.col("spread") / math.pi)).alias("direction_consistency"), zero(F.col("horizontal")).alias("horizontal_component"), zero(F.col("vertical")).alias("vertical_component"),
        zero(F.atan2("s", "c")).alias("circular_direction"), zero(F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))).alias("resultant"),
    )


def _draw(point: Column, frame: Column, hypothesis: Column) -> Column:
    """A number below 2^31 - 1 of a point in a hypothesis: two steps of a Lehmer generator."""
    once = ((F.pmod(point, F.lit(1_000_003)) + 1) * (2 * hypothesis + 12_345) * 48_271 + F.pmod(frame, F.lit(1_000_003)) * 16_807 + hypothesis * 69_621) % 2_147_483_647
    return once * 48_271 % 2_147_483_647


def _areas(p: list[tuple[Column, Column]]) -> Column:
    """Whether no three of four points are nearly on a line."""
    def area(a: int, b: int, c: int) -> Column:
        (ax, ay), (bx, by), (cx, cy) = p[a], p[b], p[c]
        return F.abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) >= LEAST_AREA

    return reduce(lambda a, b: a & b, (area(*t) for t in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))))


def _from_square(p: list[tuple[Column, Column]]) -> list[Column]:
    """The nine entries of the map of the unit square's corners (0,0) (1,0) (1,1) (0,1) to four points."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = p
    ax, bx, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    ay, by, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    det = F.nullif(ax * by - bx * ay, F.lit(0.0))
    g, h = (sx * by - bx * sy) / det, (ax * sy - sx * ay) / det
    return [x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h, F.lit(1.0)]


def camera_models(points: DataFrame, hypotheses: int = HYPOTHESES) -> DataFrame:
    """(video_id, frame_idx, hypothesis, s0..s8, d0..d8): homographies through four seeded points of a frame.

    A hypothesis deals the frame's points into four slots and takes the first of each, by a drawn number;
    the map goes from the points' old places to the unit square (the adjugate of s) and on to the new ones (d).
    """
    residue = F.pmod(F.col("point_no").cast("long"), F.lit(1_000_003))
    # points of one residue have one drawn number in every hypothesis, others never: the least of them stands for all, so that no drawn numbers tie
    rows = points.filter("nx is not null and ny is not null").groupBy(*FRAME, residue.alias("residue")).agg(F.min(F.struct("x", "y", "nx", "ny")).alias("p")).select(*FRAME, "residue", "p.*")
    rows = rows.withColumn("hypothesis", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hypotheses - 1).cast("long"))))
    rows = rows.withColumn("drawn", _draw(F.col("residue"), F.col("frame_idx").cast("long"), F.col("hypothesis")))
    slot = [F.when(F.col("drawn") % 4 == k, F.col("drawn")) for k in range(4)]
    # numbers only, column by column: aggregates of structs would sort all points of all hypotheses
    firsts = [x for k in range(4) for x in (F.min(slot[k]).alias(f"r{k}"), *(F.min_by(c, slot[k]).alias(f"{c}{k}") for c in ("x", "y", "nx", "ny")))]
    picked = rows.groupBy(*FRAME, "hypothesis").agg(*firsts).filter(" and ".join(f"r{k} is not null" for k in range(4)))
    old, new = [(F.col(f"x{k}"), F.col(f"y{k}")) for k in range(4)], [(F.col(f"nx{k}"), F.col(f"ny{k}")) for k in range(4)]
    sound = picked.filter(_areas(old) & _areas(new))
    return sound.select(*FRAME, "hypothesis", *(c.alias(f"s{k}") for k, c in enumerate(_from_square(old))), *(c.alias(f"d{k}") for k, c in enumerate(_from_square(new))))


def _moved_by(model: str) -> tuple[Column, Column]:
    """Where a point (x, y) goes under a model's struct."""
    s, d = ([F.col(f"{model}.{side}{k}") for k in range(9)] for side in "sd")
    adjugate = [s[4] * s[8] - s[5] * s[7], s[2] * s[7] - s[1] * s[8], s[1] * s[5] - s[2] * s[4], s[5] * s[6] - s[3] * s[8], s[0] * s[8] - s[2] * s[6], s[2] * s[3] - s[0] * s[5], s[3] * s[7] - s[4] * s[6], s[1] * s[6] - s[0] * s[7], s[0] * s[4] - s[1] * s[3]]
    x, y = F.col("x"), F.col("y")
    u, v, w = (adjugate[3 * r] * x + adjugate[3 * r + 1] * y + adjugate[3 * r + 2] for r in range(3))
    a, b, c = (d[3 * r] * u + d[3 * r + 1] * v + d[3 * r + 2] * w for r in range(3))
    c = F.nullif(c, F.lit(0.0))
    return a / c, b / c


def _fits(model: str, tolerance: float) -> Column:
    px, py = _moved_by(model)
    return F.coalesce((px - F.col("nx")) * (px - F.col("nx")) + (py - F.col("ny")) * (py - F.col("ny")) <= tolerance * tolerance, F.lit(False))


def camera_motion(points: DataFrame, hypotheses: int = HYPOTHESES, tolerance: float = TOLERANCE) -> DataFrame:
    """``flow_statistics`` with motion_uniformity, camera_motion, object_motion and is_camera_shake of each frame.

    The camera's map is that of the hypothesis most points of the frame follow (of equal ones the first);
    points that follow it give the camera's motion, others that of objects. Frames of fewer than 8 found
    points, or without a sound hypothesis, have none: 0.
    """
    shape = [f"{side}{k}" for side in "sd" for k in range(9)]
    tasks = dealt(points, points.count(), *FRAME)
    points = points.repartition(*FRAME) if tasks is points else tasks  # all that follows goes by frame, so points move once a use
    models = materialize(camera_models(points, hypotheses).groupBy(*FRAME).agg(F.collect_list(F.struct("hypothesis", *shape)).alias("models")), "camera-models")  # as many as hypotheses, at most
    found = _vectors(points).filter("angle is not null")
    tried = found.join(models, FRAME).withColumn("m", F.explode("models")).groupBy(*FRAME, F.col("m.hypothesis").alias("hypothesis")).agg(F.count_if(_fits("m", tolerance)).alias("inliers"))
    best = tried.groupBy(*FRAME).agg(F.max(F.col("inliers") * hypotheses + (hypotheses - 1 - F.col("hypothesis"))).alias("best"))
    chosen = best.join(models, FRAME).withColumn("m", F.explode("models")).filter(F.col("m.hypothesis") == hypotheses - 1 - F.col("best") % hypotheses).select(*FRAME, "m")
    inside = _fits("m", tolerance)
    split = found.join(chosen, FRAME).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inliers"), F.avg(F.when(inside, F.col("moved"))).alias("camera"), F.avg(F.when(~inside, F.col("moved"))).alias("object"))
    rows = flow_statistics(points).join(split, FRAME, "left")
    modelled = F.col("n").isNotNull() & (F.col("found") >= LEAST_MODEL) & (F.col("tracked") >= LEAST_TRACKED)
    zero = lambda c: F.when(modelled, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    out = rows.withColumns({"motion_uniformity": zero(F.col("inliers") / F.col("n")), "camera_motion": zero(F.col("camera")), "object_motion": zero(F.col("object"))}).drop("n", "inliers", "camera", "object")
    return out.withColumn("is_camera_shake", (F.col("camera_motion") > 1.5) & (F.col("motion_uniformity") > 0.7) & ((F.col("direction_consistency") < 0.5) | (F.col("direction_spread") > 0.8)))


# --- tiles ------------------------------------------------------------------------------------


def _overlap(low: str, high: str, a: float, b: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(high), F.lit(b)) - F.greatest(F.col(low), F.lit(a)))


def _share(left: float, top: float, right: float, bottom: float) -> Column:
    """The area that a tile has in a box."""
    return _overlap("left", "right", left, right) * _overlap("top", "bottom", top, bottom)


def composition(tiles: DataFrame) -> DataFrame:
    """Balance and interest of each frame from the share of edge pixels of its tiles (column ``edges``, 0 to 1).

    A third's weight is the mean over the tiles that reach into it, by area, so any grid will do.
    """
    area = {(r, c): _share(c / 3, r / 3, (c + 1) / 3, (r + 1) / 3) for r in range(3) for c in range(3)}
    sums = [s for (r, c), a in area.items() for s in (F.sum(a).alias(f"a{r}{c}"), F.sum(a * F.col("edges")).alias(f"e{r}{c}"))]
    whole = _share(0.0, 0.0, 1.0, 1.0)
    found = tiles.groupBy(*FRAME).agg(*sums, F.sum(whole).alias("a"), F.sum(whole * F.col("edges")).alias("e"))
    part = lambda e, a: F.coalesce(F.col(e) / F.nullif(F.col(a), F.lit(0.0)), F.lit(0.0))
    weight = {(r, c): part(f"e{r}{c}", f"a{r}{c}") * 255 for r, c in area}
    side = lambda cells: reduce(lambda x, y: x + y, (weight[k] for k in cells))
    left, right, top, bottom = side([(0, 0), (1, 0), (2, 0)]), side([(0, 2), (1, 2), (2, 2)]), side([(0, 0), (0, 1), (0, 2)]), side([(2, 0), (2, 1), (2, 2)])
    even = lambda a, b: 1 - F.abs(a - b) / (a + b + 0.001)
    return found.select(*FRAME, even(left, right).alias("h_balance"), even(top, bottom).alias("v_balance"), (side([(1, 0), (1, 2), (0, 1), (2, 1)]) / 4).alias("thirds_interest"), part("e", "a").alias("edge_density"))


#: What makes the centre stand out from the borders, and the foreground blurred against it.
SHALLOW, FOREGROUND = 1.5, 0.3


def depth_of_field(tiles: DataFrame) -> DataFrame:
    """Sharpness of regions from tiles with the mean and variance of their Laplacian (columns ``lap_mean``, ``lap_var``).

    A region's variance is pooled over its tiles, weighted by area: the mean of squares less the square of the mean.
    """
    boxes = {"centre": (0.25, 0.25, 0.75, 0.75), "top": (0.0, 0.0, 1.0, 0.25), "bottom": (0.0, 0.75, 1.0, 1.0), "left": (0.0, 0.0, 0.25, 1.0), "right": (0.75, 0.0, 1.0, 1.0)}
    boxes |= {"front_left": (0.0, 2 / 3, 1 / 3, 1.0), "front_right": (2 / 3, 2 / 3, 1.0, 1.0), "middle": (1 / 3, 1 / 3, 2 / 3, 2 / 3)}
    mean, square = F.col("lap_mean"), F.col("lap_var") + F.col("lap_mean") * F.col("lap_mean")
    sums = [s for name, box in boxes.items() for a in [_share(*box)] for s in (F.sum(a).alias(f"{name}_a"), F.sum(a * mean).alias(f"{name}_m"), F.sum(a * square).alias(f"{name}_q"))]
    found = tiles.groupBy(*FRAME).agg(*sums)

    def variance(name: str) -> Column:
        a = F.nullif(F.col(f"{name}_a"), F.lit(0.0))
        return F.coalesce(F.greatest(F.lit(0.0), F.col(f"{name}_q") / a - F.col(f"{name}_m") / a * (F.col(f"{name}_m") / a)), F.lit(0.0))

    edge = (variance("top") + variance("bottom") + variance("left") + variance("right")) / 4
    rows = found.select(*FRAME, variance("centre").alias("center_sharpness"), edge.alias("edge_sharpness"), ((variance("front_left") + variance("front_right")) / 2).alias("foreground_sharpness"), variance("middle").alias("middle_sharpness"))
    blur = F.coalesce(1 - F.col("foreground_sharpness") / F.nullif(F.col("middle_sharpness"), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumns({"sharpness_ratio": F.col("center_sharpness") / (F.col("edge_sharpness") + 0.001), "foreground_blur_ratio": blur})
    return rows.withColumns({"is_shallow_dof": F.col("sharpness_ratio") > SHALLOW, "has_foreground_element": F.col("foreground_blur_ratio") > FOREGROUND})


def frame_classes(tiles: DataFrame, faces: DataFrame, motion: DataFrame) -> DataFrame:
    """(video_id, frame_idx, shot_type, confidence, face_count, primary_face_coverage, characteristics) of every frame with tiles.

    ``faces``: rows (video_id, frame_idx, face_no, coverage, position, in_focus, is_partial); the primary one
    has the greatest coverage, of equal ones the lower face_no. ``motion``: motion_magnitude and
    vertical_component by frame, and a motion_pattern, if any.
    """
    led = faces.groupBy(*FRAME).agg(F.count(F.lit(1)).cast("int").alias("face_count"), F.max(F.struct("coverage", (-F.col("face_no")).alias("first"), "position", "in_focus", "is_partial")).alias("primary"))
    pattern = F.col("motion_pattern") if "motion_pattern" in motion.columns else F.lit(None).cast("string")
    moving = motion.select(*FRAME, "motion_magnitude", "vertical_component", pattern.alias("motion_pattern"))
    rows = composition(tiles).join(depth_of_field(tiles), FRAME).join(led, FRAME, "left").join(moving, FRAME, "left")
    n, cover, edges = F.coalesce("face_count", F.lit(0)), F.coalesce("primary.coverage", F.lit(0.0)), F.col("edge_density")
    said = lambda c: F.coalesce(c, F.lit(False))
    some = n > 0
    shoulder = some & F.col("has_foreground_element") & said(F.col("primary.position").isin("left", "right", "center"))
    walking = ~some & said((F.col("motion_pattern") == "walking") | ((F.col("motion_magnitude") > 1.5) & (F.col("vertical_component") > 0.3)))
    detail = ~some & (edges > 0.15) & F.col("is_shallow_dof")
    # fixed values: shot names with their confidences and bounds
    steps = [
        (shoulder, "OVER_THE_SHOULDER", 0.75), (n >= 3, "PLANO_GRUPO", 0.85), (n == 2, "PLANO_DOS", 0.85), (some & (cover >= 0.35), "PRIMERÍSIMO_PLANO", 0.9), (some & (cover >= 0.15), "PRIMER_PLANO", 0.85),
        (some & (cover >= 0.08), "PLANO_MEDIO_CORTO", 0.8), (some & (cover >= 0.04), "PLANO_MEDIO", 0.75), (some & (cover >= 0.02), "PLANO_AMERICANO", 0.7), (some, "PLANO_GENERAL", 0.65),
        (walking, "PUNTO_DE_VISTA", 0.7), (detail, "PLANO_DETALLE", 0.75), (edges > 0.1, "INSERT", 0.6), (edges < 0.08, "PLANO_GENERAL_EXTREMO", 0.7),
    ]
    low = ~some & ~walking & ~detail & (edges < 0.08)
    marks = [("shallow_dof", F.col("is_shallow_dof")), ("face_in_focus", said(F.col("primary.in_focus"))), ("face_partial", said(F.col("primary.is_partial"))), ("foreground_blur", shoulder), ("pov_motion", walking), ("high_detail", detail & ~walking), ("low_detail", low)]
    kept = F.filter(F.array(*(F.when(c, name) for name, c in marks)), lambda m: m.isNotNull())
    return rows.select(
        *FRAME, ladder(*((c, name) for c, name, _ in steps), otherwise="PLANO_GENERAL").alias("shot_type"), ladder(*((c, sure) for c, _, sure in steps), otherwise=0.5).cast("double").alias("confidence"),
        n.alias("face_count"), cover.alias("primary_face_coverage"), kept.alias("characteristics"),
    )
