"""Interval operators: overlap joins, priority de-duplication and consolidation of segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervalis.plans.scratch import dealt
from intervalis.schemas import GARBAGE_PRIORITY, TIER_RANK


def bucketed_overlap(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of rows of one key whose [start_time, end_time] meet; the right side's columns get the prefix ``r_``.

    Both sides are cut into time buckets of ``width``, so a key with very many
    intervals is many join keys; a pair is kept in the bucket where it begins.
    """
    def bucket(df: DataFrame) -> DataFrame:
        return df.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start_time") / width), F.floor(F.greatest("start_time", "end_time") / width))))

    other = right.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    other = other.withColumn("slot", F.explode(F.sequence(F.floor(F.col("r_start_time") / width), F.floor(F.greatest("r_start_time", "r_end_time") / width))))
    joined = bucket(left).join(other, [key, "slot"])
    first = F.floor(F.greatest("start_time", "r_start_time") / width)
    return joined.filter((F.col("slot") == first) & (F.col("start_time") < F.col("r_end_time")) & (F.col("r_start_time") < F.col("end_time"))).drop("slot")


def mark_garbage(segments: DataFrame, detections: DataFrame, share: float = 0.5, width: float = 60.0) -> DataFrame:
    """``segments`` with is_garbage, garbage_type and tier garbage where a detection covers more than ``share`` of one; the first in list order wins.

    ``segments``: video_id, index, start_time, end_time, tier; ``detections``: video_id, ordinal, kind, start_time, end_time.
    """
    met = bucketed_overlap(segments.select("video_id", "index", "start_time", "end_time"), detections.select("video_id", "ordinal", "kind", "start_time", "end_time"), "video_id", width)
    covered = (F.least("end_time", "r_end_time") - F.greatest("start_time", "r_start_time")) / (F.col("end_time") - F.col("start_time"))
    first = met.filter(covered > share).groupBy("video_id", "index").agg(F.min(F.struct("r_ordinal", "r_kind"))["r_kind"].alias("found_kind"))
    rows = segments.drop("is_garbage", "garbage_type").join(first, ["video_id", "index"], "left")
    hit = F.col("found_kind").isNotNull()
    return rows.withColumn("is_garbage", hit).withColumn("tier", F.when(hit, "garbage").otherwise(F.col("tier"))).withColumnRenamed("found_kind", "garbage_type")


def frames_in_segments(frames: DataFrame, segments: DataFrame, width: float = 60.0) -> DataFrame:
    """Frames joined to the segments that hold their time, bounds included; a shared boundary frame belongs to both."""
    spans = segments.select("video_id", F.col("segment_no"), F.col("start_time").alias("s"), F.col("end_time").alias("e"))
    spans = spans.withColumn("slot", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    rows = frames.withColumn("slot", F.floor(F.col("timestamp") / width)).join(spans, ["video_id", "slot"])
    return rows.filter(F.col("timestamp").between(F.col("s"), F.col("e"))).drop("slot", "s", "e")


# --- folds whose state depends on earlier decisions: one video's rows at a time --------------


def keep_by_priority(rows: Sequence[dict]) -> list[dict]:
    """Detections without those that overlap a kept one of the same or a higher priority by more than half of either."""
    if len(rows) <= 1:
        return list(rows)
    kept: list[dict] = []
    for d in sorted(rows, key=lambda r: r["start_time"]):
        for at, k in enumerate(kept):
            shared = min(d["end_time"], k["end_time"]) - max(d["start_time"], k["start_time"])
            spans = [x["end_time"] - x["start_time"] for x in (d, k)]
            if shared > 0 and any(span > 0 and shared / span > 0.5 for span in spans):
                if GARBAGE_PRIORITY.get(d["kind"], 0) > GARBAGE_PRIORITY.get(k["kind"], 0):
                    kept[at] = d
                break
        else:
            kept.append(d)
    return kept


def _walked(df: DataFrame, key: str, order: Sequence[str], run) -> DataFrame:
    """Apply ``run`` to the batches of each task's rows, ordered by key and order, with the same schema; a task reads many keys in one stream."""
    tasks = dealt(df, df.count(), key)
    return (df.repartition(key) if tasks is df else tasks).sortWithinPartitions(key, *(F.asc_nulls_last(c) for c in order)).mapInArrow(run, df.schema)


def _folded(df: DataFrame, key: str, fold, order: Sequence[str]) -> DataFrame:
    """Apply a fold over the ordered rows of each key, with the same schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # the rows of the key that may go on in the next batch
        for batch in batches:
            out: list[dict] = []
            for value, group in groupby(batch.to_pylist(), lambda r: r[key]):
                if held and held[0][key] != value:
                    out += fold(held)
                    held = []
                held += group
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        yield pa.RecordBatch.from_pylist(fold(held), schema=arrow)

    return _walked(df, key, order, run)


def priority_dedupe(detections: DataFrame) -> DataFrame:
    """``keep_by_priority`` for each video; equal starts keep the order of ``ordinal``."""
    return _folded(detections, "video_id", keep_by_priority, ["ordinal"])


_FAMILIES = ({"ESTATICA", "TRIPOD", "LOCKED"}, {"MOVIMIENTO_FLUIDO", "PANEO", "TILT", "TRACKING", "DOLLY"})
_SPECIAL = ("is_key_moment", "is_best_take", "key_moment_type", "key_moment_reason")


def _length(s: dict) -> float:
    return s["end_time"] - s["start_time"]


def _merged(a: dict, b: dict) -> dict:
    da, db = _length(a), _length(b)
    total = da + db or 1.0
    out = dict(a, end_time=b["end_time"], duration=b["end_time"] - a["start_time"])
    out["score"] = ((a["score"] or 0.0) * da + (b["score"] or 0.0) * db) / total
    if TIER_RANK.get(b["tier"], 0) > TIER_RANK.get(a["tier"], 0):
        out["tier"] = b["tier"]
    if "tags" in a:
        out["tags"] = sorted({*(a["tags"] or []), *(b["tags"] or [])})
    for c in _SPECIAL:
        if c in a:
            out[c] = a[c] or b[c]
    if "metrics" in a and (a["metrics"] or b["metrics"]):
        x, y = a["metrics"] or {}, b["metrics"] or {}
        out["metrics"] = {k: ((x.get(k) or 0.0) * da + (y.get(k) or 0.0) * db) / total for k in {*x, *y}}
    if "face_count" in a:
        out["face_count"] = max(a["face_count"] or 0, b["face_count"] or 0)
    out["merged_count"] = (a["merged_count"] or 1) + (b["merged_count"] or 1)
    return out


def _is_garbage(s: dict) -> bool:
    return bool(s.get("is_garbage")) or s["tier"] == "garbage"


def _similar(a: dict, b: dict) -> bool:
    tiers = {a["tier"], b["tier"]}
    alike = all(bool(a.get(c)) == bool(b.get(c)) for c in ("is_key_moment", "is_best_take", "is_garbage"))
    return (
        abs(b["start_time"] - a["end_time"]) <= 0.1 and a["shot_type"] == b["shot_type"] and (len(tiers) == 1 or tiers <= {"gold", "silver"})
        and not _is_garbage(a) and not _is_garbage(b) and abs((a["score"] or 0.0) - (b["score"] or 0.0)) <= 2 and alike
    )


def _same_family(a: dict, b: dict, with_shaky: bool = False) -> bool:
    families = [_FAMILIES[0], _FAMILIES[1] | ({"SHAKY"} if with_shaky else set())]
    return a["shot_type"] == b["shot_type"] or any({a["shot_type"], b["shot_type"]} <= f for f in families)


def _relaxed(a: dict, b: dict, micro: float) -> bool:
    """Whether a micro segment may join its neighbour; if either is a repeated one below ``micro`` seconds, nearly any two may."""
    if abs(b["start_time"] - a["end_time"]) > 0.15 or _is_garbage(a) or _is_garbage(b):
        return False
    if any(_length(s) < micro and s.get("is_repeated_take") for s in (a, b)):
        return _same_family(a, b, True) or min(_length(a), _length(b)) < 1
    return _same_family(a, b)


class Consolidation:
    """The fold of one video's ordered segments: similar neighbours merge, then short ones join a neighbour.

    It holds three rows: the run of similar ones that grows, the merged one that waits for the next, and the
    last one before it, which may still take a short neighbour in.
    """

    def __init__(self, micro: float = 2.0):
        self.micro = micro
        self.growing: dict | None = None
        self.waiting: dict | None = None
        self.before: dict | None = None
        self.runs = 0

    def push(self, row: dict) -> list[dict]:
        """Takes the next row; returns rows that no later one changes."""
        row = dict(row, merged_count=row.get("merged_count") or 1)
        if self.growing is None:
            self.growing, self.runs = row, 1
        elif _similar(self.growing, row):
            self.growing = _merged(self.growing, row)
        else:
            done, self.growing, self.runs = self.growing, row, self.runs + 1
            return self._next(done)
        return []

    def finish(self) -> list[dict]:
        """The rest, when no rows follow."""
        if self.growing is None:
            return []
        if self.runs == 1:
            return [self.growing]
        out = self._next(self.growing) + self._settle(None)
        return out + [dict(s, duration=_length(s)) for s in (self.before,) if s]

    def _next(self, run: dict) -> list[dict]:
        if self.waiting is None:
            self.waiting = run
            return []
        return self._settle(run)

    def _settle(self, following: dict | None) -> list[dict]:
        """Decides on the waiting row, knowing the one that follows, which waits then."""
        s, self.waiting, out = self.waiting, following, []
        special = (s.get("is_key_moment") or s.get("is_best_take")) and not s.get("is_repeated_take")
        if _length(s) >= self.micro or (_length(s) >= 1 and special):
            out, self.before = [self.before] if self.before else [], s
        elif self.before and _relaxed(self.before, s, self.micro):
            self.before = _merged(self.before, s)
        elif following and _relaxed(s, following, self.micro):
            self.waiting = _merged(s, following)
        elif self.before:
            self.before = dict(self.before, end_time=s["end_time"])
        elif following:
            self.waiting = dict(following, start_time=s["start_time"])
        else:
            self.before = s
        return [dict(x, duration=_length(x)) for x in out]


def consolidated(rows: Sequence[dict], micro: float = 2.0) -> list[dict]:
    """Ordered segments with similar neighbours merged, then short ones joined to a neighbour."""
    fold = Consolidation(micro)
    out = [done for r in sorted(rows, key=lambda r: r["start_time"]) for done in fold.push(r)]
    return out + fold.finish()


def consolidate(segments: DataFrame, micro: float = 2.0) -> DataFrame:
    """``consolidated`` for each video; adds merged_count. Equal starts keep the order of ``index``."""
    from intervalis.operators.consolidation import ArrowConsolidation

    rows = segments if "merged_count" in segments.columns else segments.withColumn("merged_count", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = ArrowConsolidation(micro)
        for batch in batches:
            yield from fold.push(batch)
        yield from fold.finish()

    return _walked(rows, "video_id", ["start_time", "index"], run)


def guard_garbage(segments: DataFrame) -> DataFrame:
    """Garbage rows have tier garbage and no flags."""
    bad = F.coalesce("is_garbage", F.lit(False))
    out = segments.withColumn("tier", F.when(bad, "garbage").otherwise(F.col("tier")))
    for c in ("is_best_take", "is_key_moment", "is_repeated_take"):
        if c in out.columns:
            out = out.withColumn(c, F.when(bad, False).otherwise(F.col(c)))
    return out


def clip_islands(clips: DataFrame, key: Sequence[str] = ("filename", "tier"), order: Sequence[str] = ("filename", "start_time", "clip_no"), gap: float = 0.1) -> DataFrame:
    """Consecutive clips of one file and tier with a gap below ``gap`` become one: its first clip with the last end."""
    along = Window.partitionBy(key[0]).orderBy(*order)
    breaks = ~((F.lag(key[1]).over(along) == F.col(key[1])) & (F.col("start_time") - F.lag("end_time").over(along) < gap))
    clips = dealt(clips, clips.count(), key[0])
    rows = clips.withColumn("island", F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(along))
    return rows.groupBy(*key, "island").agg(F.min("start_time").alias("start_time"), F.max_by("end_time", F.struct(*order)).alias("end_time"), F.min_by("score", F.struct(*order)).alias("score"), F.count(F.lit(1)).alias("clips")).drop("island")
