from typing import NamedTuple

import pytest

from intervalis.operators import search as S

class Clip(NamedTuple):
    index: int
    score: float | None
    tier: str | None
    duration: float
    start_time: float
    face_count: int | None
    tags: list[str] | None
    shot_type: str | None
    framing_type: str | None
    scene_group_id: int | None
    is_key_moment: bool | None
    is_best_take: bool | None
    is_repeated_take: bool | None


#: Eight clips of a harbour, with a null in every column but the times.
CLIPS = [
    Clip(10, 3.25, "bronze", 1.5, 30.0, None, ["harbour", "static"], "TILT", "WIDE", 4, None, False, True),
    Clip(11, None, "gold", 2.5, 31.5, 3, ["crew", "entrevista"], "ESTATICA", None, 4, False, True, False),
    Clip(12, 9.75, "gold", 7.0, 34.0, 1, None, "ESTATICA", "CLOSE_UP", None, True, None, False),
    Clip(13, 6.5, None, 0.5, 41.0, 0, ["crew"], None, "EXTREME_CLOSE_UP", 5, False, None, None),
    Clip(14, 6.5, "silver", 3.0, 41.5, 2, [], "TRAVELLING", "WIDE", 5, True, True, False),
    Clip(15, 7.125, "silver", 4.0, 44.5, 0, ["static", "crew"], "ESTATICA", "MEDIUM_WIDE", 6, False, None, True),
    Clip(16, 0.0, "discard", 9.0, 48.5, 5, ["crewless"], "TILT", "CLOSE_UP", 6, False, False, False),
    Clip(17, 8.0, "garbage", 2.0, 57.5, 0, ["harbour"], "PANEO", "WIDE", 6, False, None, False),
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(*c, c.start_time + c.duration, {"brightness_mean": 0.25, "motion_mean": 4.0, "motion_std": 0.125 * (c.index - 10)}) for c in CLIPS]
    schema = "index int, score double, tier string, duration double, start_time double, face_count int, tags array<string>, shot_type string, framing_type string, scene_group_id int, is_key_moment boolean, is_best_take boolean, is_repeated_take boolean, end_time double, metrics struct<brightness_mean:double,motion_mean:double,motion_std:double>"
    return spark.createDataFrame(data, schema)


def those(test):
    return [c.index for c in CLIPS if test(c)]


def found(df, *filters, logic="and"):
    return sorted(r["index"] for r in S.matching(df, S.Query(S.Group(logic, tuple(S.Filter(*f) for f in filters)))).collect())


@pytest.mark.parametrize(
    ("wanted", "test"),
    [
        (("tier", "eq", "gold"), lambda c: c.tier == "gold"),
        (("score", "between", [6.5, 7.125]), lambda c: c.score is not None and 6.5 <= c.score <= 7.125),
        (("tier", "in", ["bronze", "discard"]), lambda c: c.tier in ("bronze", "discard")),
        (("tags", "contains", "crew"), lambda c: "crew" in (c.tags or [])),
        (("is_repeated_take", "is_false", None), lambda c: not c.is_repeated_take),
        (("is_best_take", "is_true", None), lambda c: c.is_best_take is True),
        (("is_best_take", "neq", True), lambda c: c.is_best_take is not True),
        (("is_best_take", "not_in", [True]), lambda c: c.is_best_take is False),
        (("is_best_take", "exists", None), lambda c: c.is_best_take is not None),
        (("missing", "not_in", [1]), lambda c: False),
        (("missing", "neq", 1), lambda c: True),
        (("framing_type", "starts_with", "close"), lambda c: (c.framing_type or "").startswith("CLOSE")),
        (("framing_type", "ends_with", "wide"), lambda c: (c.framing_type or "").endswith("WIDE")),
        (("framing_type", "not_contains", "close"), lambda c: c.framing_type is not None and "CLOSE" not in c.framing_type),
        (("tags", "not_contains", "crew"), lambda c: c.tags is not None and "crew" not in c.tags),
        (("score", "not_contains", "6"), lambda c: c.score is not None),
        (("score", "contains", "6"), lambda c: False),
        (("score", "between", [1]), lambda c: False),
        (("quality", "gt", 6.5), lambda c: c.score is not None and c.score > 6.5),
        (("stability", "lte", 0.25), lambda c: c.index <= 12),
        (("score", "is_true", None), lambda c: False),
        (("tier", "in", "gold or silver"), lambda c: c.tier in ("gold", "silver")),
    ],
)
def test_predicates(rows, wanted, test):
    assert found(rows, wanted) == those(test)


def test_groups_and_wire_format(rows):
    assert found(rows, ("tier", "eq", "gold"), ("face_count", "gte", 5), logic="or") == [11, 12, 16]
    assert found(rows) == those(lambda c: True) and found(rows, logic="or") == []
    query = S.parse_query({"filters": {"operator": "XOR", "filters": [{"field": "tier", "value": "silver"}, {"operator": "or", "filters": [{"field": "face_count", "operator": "lt", "value": 1}]}]}})
    assert [r["index"] for r in S.page_of(rows, query).collect()] == [15]
    with pytest.raises(ValueError, match="unknown operator"):
        S.parse_group({"filters": [{"field": "tier", "operator": "resembles"}]})


def test_pages_and_sorts(rows):
    query = S.Query(page=3, page_size=3)
    assert [r["index"] for r in S.page_of(rows, query).collect()] == [16, 17]
    assert S.summary(rows, query) == {"found": 8, "showing": 2, "page": 3, "total_pages": 3, "has_next": False, "has_prev": True}
    empty = S.Query(S.Group("or"), page=2)
    assert S.summary(rows, empty) == {"found": 0, "showing": 0, "page": 1, "total_pages": 0, "has_next": False, "has_prev": False}
    assert S.page_of(rows, S.Query(page=12)).count() == 0
    by = lambda desc: [r["index"] for r in S.page_of(rows, S.Query(sort_by="is_key_moment", descending=desc)).collect()]
    assert by(False) == [11, 13, 15, 16, 17, 12, 14, 10] and by(True) == [10, 12, 14, 11, 13, 15, 16, 17]


def test_shortcuts(rows):
    indices = lambda *a: sorted(r["index"] for r in S.shortcut(rows, *a).collect())
    assert indices("usable") == those(lambda c: c.tier in ("gold", "silver") and not c.is_repeated_take) and indices("gold") == [11, 12]
    assert indices("time_range", 41.0, 48.5) == those(lambda c: c.start_time >= 41 and c.start_time + c.duration <= 48.5)
    assert indices("interview") == [11] and indices("scene", 6) == [15, 16, 17] and indices("best_takes") == [11, 14]
    assert indices("static") == [11, 12, 15] and indices("key_moments") == [12, 14]


def test_export_selection_without_any_best_take(rows):
    none = rows.withColumn("is_garbage", rows.tier == "none")
    assert sorted(r["index"] for r in S.export_selection(none, ["gold", "silver"], best_takes=True).collect()) == [11, 14]
    left = none.filter("is_best_take is not true")
    assert sorted(r["index"] for r in S.export_selection(left, ["gold", "silver"], best_takes=True).collect()) == [12]


def test_projection_and_arguments(rows):
    assert S.project(rows, include=["score", "index", "nope"]).columns == ["index", "score"]
    assert "tags" not in S.project(rows, exclude=["tags", "nope"]).columns
    assert S.arguments({"score_min": "7.5", "has_faces": "TRUE", "other": "1"}, {"score_min": float, "has_faces": bool}) == {"score_min": 7.5, "has_faces": True}
