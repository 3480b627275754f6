"""Structured search: a tree of typed predicates compiled to one Column, then sort, page and projection.

Null rules differ from SQL: a predicate never yields null. A null value fails
every operator but ``neq`` and ``is_false``. Ascending sorts put nulls last,
descending ones first, and ties keep the order of the tie key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intervalis.plans.scratch import TASK_ROWS
from intervalis.schemas import TIER_RANK

# Short names of fields.
ALIASES = {
    "quality": "score", "brightness": "metrics.brightness_mean", "contrast": "metrics.contrast_mean", "sharpness": "metrics.sharpness_mean",
    "motion": "metrics.motion_mean", "stability": "metrics.motion_std", "faces": "face_count", "scene": "scene_group_id", "take": "take_group_id",
}


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Group:
    """AND of nothing is true, OR of nothing is false."""

    logic: str = "and"
    filters: tuple[Filter | Group, ...] = ()


@dataclass(frozen=True)
class Query:
    filters: Group = field(default_factory=Group)
    sort_by: str = "index"
    descending: bool = False
    page: int = 1
    page_size: int = 50
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


def data_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Type of a dotted path, None if there is no such field."""
    here: T.DataType = schema
    for part in path.split("."):
        if not isinstance(here, T.StructType) or part not in here.names:
            return None
        here = here[part].dataType
    return here


def resolve(schema: T.StructType, name: str) -> tuple[Column, T.DataType | None]:
    """Column of a field or alias; a null literal where the table has none."""
    path = ALIASES.get(name, name)
    kind = data_type(schema, path)
    return (F.lit(None) if kind is None else F.col(path)), kind


def _text(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.StringType)


def _comparison(compare: Callable[[Column, Any], Column]) -> Callable:
    return lambda c, kind, v: compare(c, v)


def _member(c: Column, kind, v) -> Column:
    if isinstance(v, str):  # membership in a string is a substring test
        return F.lit(v).contains(c) if _text(kind) else F.lit(False)
    return c.isin(*v) if len(v) else F.lit(False)


def _contains(c: Column, kind, v) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.array_contains(c, v)
    return F.lower(c).contains(str(v).lower()) if _text(kind) else F.lit(False)


def _not_contains(c: Column, kind, v) -> Column:
    if isinstance(kind, T.ArrayType) or _text(kind):
        return ~F.coalesce(_contains(c, kind, v), F.lit(False))
    return F.lit(True)


def _is(value: bool) -> Callable:
    return lambda c, kind, v: (c == value) if isinstance(kind, T.BooleanType) else F.lit(False)


OPERATORS: dict[str, Callable[[Column, T.DataType | None, Any], Column]] = {
    "eq": _comparison(lambda c, v: c == v),
    "neq": _comparison(lambda c, v: c != v),
    "gt": _comparison(lambda c, v: c > v),
    "gte": _comparison(lambda c, v: c >= v),
    "lt": _comparison(lambda c, v: c < v),
    "lte": _comparison(lambda c, v: c <= v),
    "in": _member,
    "not_in": lambda c, kind, v: ~_member(c, kind, v),
    "contains": _contains,
    "not_contains": _not_contains,
    "starts_with": lambda c, kind, v: F.lower(c).startswith(str(v).lower()) if _text(kind) else F.lit(False),
    "ends_with": lambda c, kind, v: F.lower(c).endswith(str(v).lower()) if _text(kind) else F.lit(False),
    "between": lambda c, kind, v: c.between(v[0], v[1]) if isinstance(v, (list, tuple)) and len(v) == 2 else F.lit(False),
    "exists": lambda c, kind, v: c.isNotNull(),
    "is_true": _is(True),
    "is_false": _is(False),
}
_TRUE_ON_NULL = {"neq", "is_false"}


def predicate(schema: T.StructType, f: Filter) -> Column:
    if f.operator not in OPERATORS:
        raise ValueError(f"unknown operator: {f.operator}")
    column, kind = resolve(schema, f.field)
    on_null = F.lit(f.operator in _TRUE_ON_NULL)
    if kind is None:
        return on_null
    test = F.coalesce(OPERATORS[f.operator](column, kind, f.value), F.lit(False))
    return F.when(column.isNull(), on_null).otherwise(test)


def condition(schema: T.StructType, group: Group) -> Column:
    """The whole tree as one boolean Column without nulls."""
    parts = [condition(schema, f) if isinstance(f, Group) else predicate(schema, f) for f in group.filters]
    if group.logic == "or":
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def parse_group(data: dict) -> Group:
    """The wire format: {operator, filters: [...]} nested at will; an unknown logic is AND, a missing operator eq."""
    logic = "or" if str(data.get("operator", "and")).lower() == "or" else "and"
    parts: list[Filter | Group] = []
    for item in data.get("filters", []):
        if "filters" in item:
            parts.append(parse_group(item))
        else:
            operator = item.get("operator", "eq")
            if operator not in OPERATORS:
                raise ValueError(f"unknown operator: {operator}")
            parts.append(Filter(item["field"], operator, item.get("value")))
    return Group(logic, tuple(parts))


def parse_query(data: dict) -> Query:
    return Query(
        parse_group(data.get("filters") or {}), data.get("sort_by", "index"), str(data.get("sort_order", "asc")).lower() == "desc",
        int(data.get("page", 1)), int(data.get("page_size", 50)), tuple(data.get("include_fields") or ()), tuple(data.get("exclude_fields") or ()),
    )


def sort_values(schema: T.StructType, name: str, descending: bool, tie: str = "index") -> list[tuple[Column, bool]]:
    """What rows are sorted by, and whether downwards."""
    column, kind = resolve(schema, name)
    values = [] if kind is None else [(column, descending)]
    return [*values, *([(F.col(tie), False)] if tie in schema.names else [])]


def sort_keys(schema: T.StructType, name: str, descending: bool, tie: str = "index") -> list[Column]:
    return [value.desc_nulls_first() if down else value.asc_nulls_last() for value, down in sort_values(schema, name, descending, tie)]


def project(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Top-level columns to keep; include wins over exclude, unknown names are ignored."""
    if include:
        return df.select(*[c for c in df.columns if c in include])
    return df.drop(*exclude)


def matching(df: DataFrame, query: Query) -> DataFrame:
    return df.filter(condition(df.schema, query.filters))


def page_of(df: DataFrame, query: Query, tie: str = "index") -> DataFrame:
    """The wanted page, in order: a top-k of the matches, not a sort of all."""
    rows = matching(df, query).orderBy(*sort_keys(df.schema, query.sort_by, query.descending, tie))
    return project(rows.offset((query.page - 1) * query.page_size).limit(query.page_size), query.include, query.exclude)


def summary(df: DataFrame, query: Query) -> dict:
    """Envelope of a page: totals and neighbours. An empty result is page 1 of 0."""
    found = matching(df, query).count()
    pages = math.ceil(found / query.page_size)
    page = query.page if found else 1
    showing = max(0, min(query.page_size, found - (page - 1) * query.page_size))
    return {"found": found, "showing": showing, "page": page, "total_pages": pages, "has_next": page < pages, "has_prev": page > 1 and pages > 0}


_QUICK: dict[str, Callable[[Any], Sequence[Filter]]] = {
    "tier": lambda v: [Filter("tier", "eq", v)],
    "tiers": lambda v: [Filter("tier", "in", list(v))],
    "score_min": lambda v: [Filter("score", "gte", v)],
    "score_max": lambda v: [Filter("score", "lte", v)],
    "duration_min": lambda v: [Filter("duration", "gte", v)],
    "duration_max": lambda v: [Filter("duration", "lte", v)],
    "has_faces": lambda v: [Filter("face_count", "gt" if v else "eq", 0)],
    "shot_type": lambda v: [Filter("shot_type", "eq", v)],
    "framing_type": lambda v: [Filter("framing_type", "contains", v)],
    "tags": lambda v: [Filter("tags", "contains", t) for t in v],
    "has_tag": lambda v: [Filter("tags", "contains", v)],
    "scene_group": lambda v: [Filter("scene_group_id", "eq", v)],
    "is_key_moment": lambda v: [Filter("is_key_moment", "is_true" if v else "is_false")],
    "is_best_take": lambda v: [Filter("is_best_take", "is_true" if v else "is_false")],
    "is_repeated": lambda v: [Filter("is_repeated_take", "is_true" if v else "is_false")],
    "exclude_repeated": lambda v: [Filter("is_repeated_take", "is_false")] if v else [],
}


def _in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """All rows in order, by so many ranges that a task sorts about TASK_ROWS."""
    ranges = -(-rows.count() // TASK_ROWS) if order else 0
    if ranges <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows.orderBy(*order)
    return rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)


def quick_search(df: DataFrame, sort_by: str = "index", sort_desc: bool = False, **wanted: Any) -> DataFrame:
    """All matches of a conjunction of named filters, without pages; None leaves a filter out."""
    filters = [f for name, value in wanted.items() if value is not None for f in _QUICK[name](value)]
    return _in_order(matching(df, Query(Group("and", tuple(filters)))), sort_keys(df.schema, sort_by, sort_desc))


def shortcut(df: DataFrame, name: str, *args: Any) -> DataFrame:
    """The named searches; tiers are compared in lower case."""
    rows = df.withColumn("tier", F.lower("tier")) if "tier" in df.columns else df
    if name == "gold":
        return quick_search(rows, tier="gold")
    if name == "usable":
        return quick_search(rows, "score", True, tiers=["gold", "silver"], exclude_repeated=True)
    if name == "faces":
        return quick_search(rows, has_faces=True)
    if name == "key_moments":
        return quick_search(rows, is_key_moment=True)
    if name == "best_takes":
        return quick_search(rows, is_best_take=True)
    if name == "scene":
        return quick_search(rows, scene_group=args[0])
    if name == "shot_type":
        return quick_search(rows, shot_type=args[0])
    if name == "framing":
        return quick_search(rows, framing_type=args[0])
    if name == "static":
        return quick_search(rows, shot_type="ESTATICA")
    if name == "interview":
        return quick_search(rows, "score", True, has_faces=True, has_tag="entrevista")
    if name == "time_range":
        wanted = Group("and", (Filter("start_time", "gte", args[0]), Filter("end_time", "lte", args[1])))
        return page_of(rows, Query(wanted, sort_by="start_time"))
    raise ValueError(f"unknown shortcut: {name}")


# --- predicates of single endpoints ---------------------------------------------------------


def tier_rank(tier: Column, unknown: int = 1) -> Column:
    """Rank of a tier in lower or upper case; unknown ones, garbage too, count as ``unknown``."""
    ranks = F.create_map(*(F.lit(x) for name, rank in TIER_RANK.items() if name != "garbage" for x in (name, rank)))
    return F.coalesce(F.element_at(ranks, F.lower(tier)), F.lit(unknown))


def min_tier(df: DataFrame, tier: str) -> DataFrame:
    return df.filter(tier_rank(F.col("tier")) >= TIER_RANK[tier.lower()])


def without_garbage(df: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """Drops garbage rows, of the listed types only if there are any."""
    garbage = F.coalesce(F.col("is_garbage"), F.lit(False))
    listed = F.coalesce(F.col("garbage_type").isin(*types), F.lit(False)) if types else F.lit(True)
    return df.filter(~(garbage & listed))


def with_faces(df: DataFrame, least: int = 1, eyes_open: bool = False, in_focus: bool = False, tier: str | None = None) -> DataFrame:
    keep = F.coalesce(F.col("face_count"), F.lit(0)) >= least
    if eyes_open:
        keep &= ~F.coalesce(F.col("any_eyes_closed"), F.lit(False))
    if in_focus:
        keep &= F.coalesce(F.col("face_analysis.faces_in_focus_pct"), F.lit(0.0)) > 50
    if tier:
        keep &= F.lower("tier") == tier.lower()
    return df.filter(keep).orderBy(F.desc("face_count"), F.desc_nulls_last("score"), "index")


def videos_with(videos: DataFrame, segments: DataFrame, wanted: Column, key: str = "video_id") -> DataFrame:
    """Videos of which some segment fulfils a condition: a left semi join."""
    return videos.join(segments.filter(wanted).select(key), key, "left_semi")


def not_yet(uploads: DataFrame, analysed: DataFrame, key: str = "filename") -> DataFrame:
    return uploads.join(analysed.select(key), key, "left_anti")


def export_selection(df: DataFrame, tiers: Sequence[str], key_moments: bool = False, best_takes: bool = False, faces: bool = False) -> DataFrame:
    """Rows to export; asking for best takes has no effect where there are none at all."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    keep = F.lower("tier").isin([t.lower() for t in tiers]) & ~yes("is_garbage") & ~yes("is_repeated_take")
    if key_moments:
        keep &= yes("is_key_moment")
    if faces:
        keep &= F.coalesce(F.col("face_count"), F.lit(0)) > 0
    rows = df.filter(keep)
    if best_takes:
        any_best = df.agg(F.coalesce(F.bool_or(yes("is_best_take")), F.lit(False)).alias("any_best"))  # one row
        rows = rows.crossJoin(F.broadcast(any_best)).filter(yes("is_best_take") | ~F.col("any_best")).drop("any_best")
    return rows


def text_search(df: DataFrame, text: str, column: str = "filename") -> DataFrame:
    return df.filter(F.lower(column).contains(text.lower()))


def arguments(raw: dict[str, str], kinds: dict[str, type]) -> dict[str, Any]:
    """HTTP arguments by type; a boolean is true if its text is 'true'."""
    return {k: (v.lower() == "true" if kinds[k] is bool else kinds[k](v)) for k, v in raw.items() if k in kinds and v != ""}


def available_filters(spark) -> DataFrame:
    """Fields, operators and sort fields that a search form offers."""
    fields = ("score", "duration", "tier", "shot_type", "framing_type", "face_count", "tags", "scene_group_id", "is_key_moment", "is_best_take", "is_repeated_take")
    rows = [("field", f) for f in fields] + [("operator", o) for o in OPERATORS] + [("sort", s) for s in ("index", "score", "duration", "start_time", "tier")]
    return spark.createDataFrame(rows, "kind string, name string")
