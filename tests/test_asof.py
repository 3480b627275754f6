import bisect
import random

import duckdb
import pytest

from intervalis.operators import sketches
from intervalis.operators.asof import asof_join


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("width", [0.5, 7.0, 1e6])
def test_equals_asof_join_with_a_hot_key(spark, strict, width):
    """One video holds most rows; nulls, equal times and long gaps without a detection are there."""
    rnd = random.Random(3)
    left = [(i, rnd.choice(["hot", "hot", "a", "b", None]), rnd.choice([None, rnd.randrange(0, 40_000) / 2]) if i % 9 == 0 else rnd.randrange(0, 40_000) / 2, i % 3) for i in range(1500)]
    right = [(f"d{i}", rnd.choice(["hot", "a", "c", None]), float(t)) for i, t in enumerate(rnd.sample([*range(0, 400), *range(8000, 8300), *range(30_000, 30_050)], 300)) if t not in (5, 8001)] + [("null", "hot", None)]
    got = asof_join(table(spark, left, "id int, video string, at double, kind int"), table(spark, right, "kind string, video string, since double"), ["video"], "at", ["kind"], width, right_time="since", strict=strict)
    assert got.columns == ["id", "video", "at", "kind", "since_asof", "kind_asof"]
    want = []
    for i, v, t, k in left:
        seen = sorted((x, d) for d, w, x in right if w == v and v is not None and x is not None)
        place = 0 if t is None else (bisect.bisect_left if strict else bisect.bisect_right)([x for x, _ in seen], t)
        x, d = seen[place - 1] if place else (None, None)
        want.append((i, v, t, k, x, d))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ties_tolerance_and_empty_sides(spark):
    left, right = table(spark, [(1, "v", 10.0), (2, "v", 30.0)], "id int, video string, at double"), table(spark, [("x", "v", 9.0), ("y", "v", 9.0)], "kind string, video string, at double")
    assert sorted(map(tuple, asof_join(left, right, ["video"], "at", ["kind"], 5.0).select("id", "kind_asof").collect())) == [(1, "y"), (2, "y")]
    assert sorted(map(tuple, asof_join(left, right, ["video"], "at", ["kind"], 5.0, tolerance=2.0).select("id", "at_asof").collect())) == [(1, 9.0), (2, None)]
    none = right.filter("at < 0")
    assert [r.kind_asof for r in asof_join(left, none, ["video"], "at", ["kind"], 5.0).collect()] == [None, None] and asof_join(left.filter("id < 0"), right, ["video"], "at", ["kind"], 5.0).count() == 0


def test_sketches_add_up_within_their_error(spark):
    rnd = random.Random(8)
    rows = [("hot" if rnd.random() < 0.4 else f"v{rnd.randrange(9)}", rnd.randrange(30_000), rnd.choice([None, rnd.gauss(0, 1)])) for _ in range(40_000)]
    df = table(spark, rows, "video string, user long, value double")
    per_video = sketches.sketched(df, ["video"], "user", "value")
    one = sketches.read_sketches(sketches.merged(per_video, []), [], (0.1, 0.5, 0.9)).first()
    users, values = len({u for _, u, _ in rows}), sorted(v for *_, v in rows if v is not None)
    assert one.n == 40_000 and abs(one.distinct - users) <= sketches.COUNT_ERROR * users
    for q, x in ((0.1, one.q10), (0.5, one.q50), (0.9, one.q90)):
        assert abs(bisect.bisect_right(values, x) / len(values) - q) <= sketches.RANK_ERROR
    share = {r.point: r.share for r in sketches.rank_of(sketches.merged(per_video, []), [], [0.0, 9.0]).collect()}
    assert abs(share[0.0] - bisect.bisect_right(values, 0.0) / len(values)) <= sketches.RANK_ERROR and share[9.0] == 1
    hot = sketches.read_sketches(per_video, ["video"]).filter("video = 'hot'").first()
    exact = duckdb.sql("select count(distinct u) from (select unnest(?::bigint[]) u)", params=[[u for v, u, _ in rows if v == "hot"]]).fetchall()[0][0]
    assert abs(hot.distinct - exact) <= sketches.COUNT_ERROR * exact
