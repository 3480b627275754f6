import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervalis.operators import motion

POINTS = "video_id string, frame_idx long, point_no long, x double, y double, nx double, ny double"
TILES = "video_id string, frame_idx long, left double, top double, right double, bottom double, edges double, lap_mean double, lap_var double"


def draw(point, frame, h):
    once = ((point % 1_000_003 + 1) * (2 * h + 12_345) * 48_271 + frame % 1_000_003 * 16_807 + h * 69_621) % 2_147_483_647
    return once * 48_271 % 2_147_483_647


def homography(old, new):
    """The eight unknowns of the map through four pairs, by a linear system."""
    rows, right = [], []
    for (x, y), (u, v) in zip(old, new, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows), np.array(right)), 1).reshape(3, 3)


def brute(points, hypotheses):
    """uniformity, camera and object motion of one frame."""
    good = [p for p in points if p[5] is not None]
    if len(points) < 10 or len(good) < 8:
        return 0.0, 0.0, 0.0
    best = None
    for h in range(hypotheses):
        slots = [min((p for p in good if draw(p[2], p[1], h) % 4 == k), key=lambda p: draw(p[2], p[1], h), default=None) for k in range(4)]
        if None in slots:
            continue
        old, new = [p[3:5] for p in slots], [p[5:7] for p in slots]
        area = lambda a, b, c: abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1]))
        if any(area(*(q[k] for k in t)) < 1 for q in (old, new) for t in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))):
            continue
        there = homography(old, new) @ np.array([[p[3], p[4], 1] for p in good]).T
        inside = [math.hypot(a / c - p[5], b / c - p[6]) <= 3 for a, b, c, p in zip(*there, good, strict=True)]
        if best is None or sum(inside) > sum(best):
            best = inside
    if best is None:
        return 0.0, 0.0, 0.0
    moved = [math.hypot(p[5] - p[3], p[6] - p[4]) for p in good]
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
    return sum(best) / len(best), mean([m for m, i in zip(moved, best, strict=True) if i]), mean([m for m, i in zip(moved, best, strict=True) if not i])


def frame_of(rnd, frame, n, share, lost=0.0):
    rows = []
    for k in range(n):
        x, y = rnd.uniform(0, 480), rnd.uniform(0, 270)
        w = 1 + x / 5000
        nx, ny = (x * 1.02 + 6) / w, (y * 1.02 - 2) / w
        if rnd.random() < share:
            nx, ny = nx + rnd.uniform(20, 40), ny - rnd.uniform(10, 30)
        if rnd.random() < lost:
            nx = ny = None
        rows.append(("v", frame, k, x, y, nx, ny))
    return rows


def test_camera_and_objects_equal_brute_force(spark):
    """Frames of all sizes around the least ones, one on a line, one of equal points, one that holds a third of all points."""
    rnd = random.Random(6)
    frames = {f: frame_of(rnd, f, n, share, lost) for f, (n, share, lost) in enumerate([(9, 0, 0), (10, 0, 0.0), (12, 0.3, 0.4), (40, 0.25, 0.1), (100, 0.45, 0), (60, 0, 0), (15, 1.0, 0), (600, 0.3, 0.05)])}
    frames[8] = [("v", 8, k, float(k), 2.0 * k, k + 3.0, 2.0 * k) for k in range(30)]
    frames[9] = [("v", 9, k, 5.0, 5.0, 6.0, 6.0) for k in range(30)]
    rows = [r for v in frames.values() for r in v]
    found = motion.camera_motion(spark.createDataFrame(rows, POINTS).repartition(7), 32).collect()
    assert len(found) == len(frames)
    for r in found:
        assert (r.motion_uniformity, r.camera_motion, r.object_motion) == pytest.approx(brute(frames[r.frame_idx], 32), abs=1e-6), r.frame_idx
    by = {r.frame_idx: r for r in found}
    assert by[4].motion_uniformity == pytest.approx(sum(p[5] - (p[3] * 1.02 + 6) / (1 + p[3] / 5000) < 1 for p in frames[4]) / 100)
    assert by[8].camera_motion == by[9].camera_motion == 0 and by[8].motion_magnitude == 3


def test_shake_is_uniform_motion_without_direction(spark):
    """A turn about the middle moves all points alike by the map, in all directions."""
    rows = []
    for k in range(60):
        a, r = k * math.pi / 30, 40 + 7 * (k % 9)
        x, y = 240 + r * math.cos(a), 135 + r * math.sin(a)
        b = a + 0.2
        rows.append(("v", 0, k, x, y, 240 + r * math.cos(b), 135 + r * math.sin(b)))
        rows.append(("v", 1, k, x, y, x + 9, y))
    turn, pan = motion.camera_motion(spark.createDataFrame(rows, POINTS)).orderBy("frame_idx").collect()
    assert turn.motion_uniformity == 1 and turn.is_camera_shake and turn.resultant < 0.01
    assert pan.motion_uniformity == 1 and not pan.is_camera_shake and pan.direction_consistency == 1 and pan.camera_motion == pytest.approx(9)


def test_flow_statistics(spark):
    """Directions on both sides of pi: the plain mean is 0, the circular one pi; too few points are no motion."""
    near = [("v", 0, k, 0.0, 0.0, -5.0, 0.5 if k % 2 else -0.5) for k in range(10)]
    few = [("v", 1, k, 0.0, 0.0, 3.0, 4.0) for k in range(9)]
    lost = [("v", 2, k, 0.0, 0.0, *((3.0, 4.0) if k < 4 else (None, None))) for k in range(20)]
    enough = [("v", 3, k, 0.0, 0.0, *((3.0, 4.0) if k < 5 else (None, None))) for k in range(20)]
    rows = {r.frame_idx: r for r in motion.flow_statistics(spark.createDataFrame(near + few + lost + enough, POINTS)).collect()}
    assert rows[0].motion_direction == pytest.approx(0) and abs(rows[0].circular_direction) == pytest.approx(math.pi) and rows[0].resultant > 0.99
    assert [rows[k].motion_magnitude for k in (1, 2, 3)] == [0, 0, 5] and (rows[3].horizontal_component, rows[3].vertical_component) == (3, 4) and rows[3].tracked == 20
    assert motion.flow_statistics(spark.createDataFrame([], POINTS)).count() == 0 == motion.camera_motion(spark.createDataFrame([], POINTS)).count()


def grid(frame, n, m, edges, lap=lambda x, y: (0.0, 1.0)):
    return [("v", frame, c / n, r / m, (c + 1) / n, (r + 1) / m, edges((c + 0.5) / n, (r + 0.5) / m), *lap((c + 0.5) / n, (r + 0.5) / m)) for r in range(m) for c in range(n)]


def test_composition_is_the_same_on_any_grid_that_keeps_thirds(spark):
    left = lambda x, y: 0.6 if x < 1 / 3 else 0.1
    rows = grid(0, 3, 3, left) + grid(1, 12, 6, left) + grid(2, 3, 3, lambda x, y: 0.2) + [("v", 3, 0.0, 0.0, 0.5, 1.0, 0.4, 0.0, 1.0)]
    found = motion.composition(spark.createDataFrame(rows, TILES)).orderBy("frame_idx").collect()
    assert tuple(found[0])[2:] == pytest.approx(tuple(found[1])[2:]) and found[0].edge_density == pytest.approx(0.8 / 3)
    a, b = 3 * 0.6 * 255, 3 * 0.1 * 255
    assert found[0].h_balance == pytest.approx(1 - (a - b) / (a + b + 0.001)) and found[0].v_balance == pytest.approx(1)
    assert found[2].thirds_interest == pytest.approx(51) and found[2].h_balance == pytest.approx(1)
    # half a frame: a tile's value holds for what it covers, and nothing is known of the rest
    assert found[3].edge_density == pytest.approx(0.4) and found[3].h_balance == pytest.approx(0, abs=1e-5)


def test_depth_of_field_pools_variances(spark):
    rnd = np.random.default_rng(1)
    pixels = rnd.normal(0, 1, (48, 48)) * np.where(np.hypot(*np.mgrid[-1:1:48j, -1:1:48j]) < 0.6, 9, 2) + 3
    rows = [("v", 0, c / 24, r / 24, (c + 1) / 24, (r + 1) / 24, 0.0, float(t.mean()), float(t.var())) for r in range(24) for c in range(24) for t in [pixels[2 * r : 2 * r + 2, 2 * c : 2 * c + 2]]]
    found = motion.depth_of_field(spark.createDataFrame(rows, TILES)).first()
    edge = np.mean([pixels[:12].var(), pixels[36:].var(), pixels[:, :12].var(), pixels[:, 36:].var()])
    assert found.center_sharpness == pytest.approx(pixels[12:36, 12:36].var()) and found.edge_sharpness == pytest.approx(edge)
    assert found.foreground_sharpness == pytest.approx((pixels[32:, :16].var() + pixels[32:, 32:].var()) / 2) and found.middle_sharpness == pytest.approx(pixels[16:32, 16:32].var())
    assert found.is_shallow_dof and found.has_foreground_element


def test_frame_classes(spark):
    """One frame for each class, faces at the edges of their bands."""
    sharp = lambda x, y: (0.0, 50.0 if 0.25 < x < 0.75 and 0.25 < y < 0.75 else 1.0)
    flat = lambda x, y: (0.0, 4.0)
    cases = [
        ([(0.35, "top")], 0.1, flat, 0, "PRIMERÍSIMO_PLANO"), ([(0.349, "top")], 0.1, flat, 0, "PRIMER_PLANO"), ([(0.149, "top")], 0.1, flat, 0, "PLANO_MEDIO_CORTO"), ([(0.079, "top")], 0.1, flat, 0, "PLANO_MEDIO"),
        ([(0.039, "top")], 0.1, flat, 0, "PLANO_AMERICANO"), ([(0.019, "top")], 0.1, flat, 9, "PLANO_GENERAL"), ([(0.1, "top"), (0.1, "left")], 0.1, flat, 0, "PLANO_DOS"), ([(0.1, "top")] * 3, 0.1, sharp, 0, "PLANO_GRUPO"),
        ([(0.3, "left")], 0.1, sharp, 0, "OVER_THE_SHOULDER"), ([], 0.5, sharp, 2, "PUNTO_DE_VISTA"), ([], 0.5, sharp, 1, "PLANO_DETALLE"), ([], 0.5, flat, 0, "INSERT"), ([], 0.09, flat, 0, "PLANO_GENERAL"), ([], 0.05, flat, 0, "PLANO_GENERAL_EXTREMO"),
    ]
    tiles, faces, moving = [], [], []
    for k, (seen, edges, lap, speed, _) in enumerate(cases):
        tiles += grid(k, 8, 8, lambda x, y, e=edges: e, lap)
        faces += [("v", k, no, c, p, True, False) for no, (c, p) in enumerate(seen)]
        moving += [("v", k, float(speed), 0.5)] if speed else []
    found = motion.frame_classes(
        spark.createDataFrame(tiles, TILES).repartition(5), spark.createDataFrame(faces, "video_id string, frame_idx long, face_no int, coverage double, position string, in_focus boolean, is_partial boolean"),
        spark.createDataFrame(moving, "video_id string, frame_idx long, motion_magnitude double, vertical_component double"),
    )
    rows = found.orderBy("frame_idx").collect()
    assert [r.shot_type for r in rows] == [c[-1] for c in cases]
    assert rows[8].characteristics == ["shallow_dof", "face_in_focus", "foreground_blur"] and rows[13].characteristics == ["low_detail"] and rows[9].confidence == 0.7
    assert found.filter(F.size("characteristics") == 0).count() == 2


def test_points_of_all_hypotheses_are_not_sorted(spark):
    """Equal point numbers and shuffled rows change nothing, and no aggregate above the hypotheses needs its input in order."""
    rnd = random.Random(5)
    rows = [("v", f, rnd.randrange(40), float(x := rnd.randrange(480)), float(y := rnd.randrange(270)), x + 2.0 + rnd.randrange(3), y - 1.0) for f in range(4) for _ in range(60)]
    points = spark.createDataFrame(rows, POINTS)
    got = [sorted(motion.camera_models(p, 12).collect()) for p in (points.repartition(5), points.orderBy(F.desc("x")).coalesce(1))]
    assert got[0] == got[1] and got[0]
    plan = motion.camera_models(points, 12)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan[: plan.index("Generate")]
