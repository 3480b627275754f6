"""The fold of ``intervals.Consolidation`` over Arrow batches of many videos' rows.

Which neighbours may merge is decided for a whole batch but for the running score, and most rows are neither merged
nor short: only runs of candidates and short rows are walked, and only rows that change are rebuilt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from intervalis.operators.intervals import _FAMILIES, _SPECIAL
from intervalis.operators.ranking import _begins
from intervalis.schemas import TIER_RANK

_CHANGED = ("start_time", "end_time", "duration", "score", "tier", "tags", *_SPECIAL, "metrics", "face_count", "merged_count")


class ArrowConsolidation:
    """Takes batches of rows ordered by video, start and index; returns batches of rows that no later one changes.

    Between batches it holds three rows of the last video at most: the settled one before, the one that waits for
    the next, and the run that grows.
    """

    def __init__(self, micro: float = 2.0, key: str = "video_id"):
        self.micro, self.key = micro, key
        self.held: pa.RecordBatch | None = None
        self.settled = self.several = False

    def push(self, batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        batch = _counted(batch)
        if self.held is not None:
            batch = pa.Table.from_batches([self.held, batch.cast(self.held.schema)]).combine_chunks().to_batches()[0] if batch.num_rows else self.held
        return self._step(batch, False) if batch.num_rows else []

    def finish(self) -> list[pa.RecordBatch]:
        """The rest, when no rows follow."""
        return [] if self.held is None else self._step(self.held, True)

    def _step(self, rows: pa.RecordBatch, final: bool) -> list[pa.RecordBatch]:
        closed = 0 if self.held is None else self.held.num_rows - 1  # the held rows but the one that grows
        new = _begins(rows.column(self.key), None)
        new[0] = True
        start, end, score = (_numbers(rows, c) for c in ("start_time", "end_time", "score"))
        score = np.where(rows.column("score").is_null().to_numpy(zero_copy_only=False), 0.0, score)
        best, key_moment, again = (_flag(rows, c) for c in ("is_best_take", "is_key_moment", "is_repeated_take"))
        usable = _in(rows, ["gold", "silver"])
        garbage = _flag(rows, "is_garbage") | _in(rows, ["garbage"])
        alike = ~new
        alike[1:] &= (np.abs(start[1:] - end[:-1]) <= 0.1) & ~garbage[1:] & ~garbage[:-1] & (key_moment[1:] == key_moment[:-1]) & (best[1:] == best[:-1])
        alike[1:] &= ~_begins(rows.column("tier"), None)[1:] | (usable[1:] & usable[:-1])
        alike &= ~_begins(rows.column("shot_type"), None)
        alike[: closed + 1] = False

        s, e, scores = start.tolist(), end.tolist(), score.tolist()
        merges: list[tuple[int, int, float, float, float]] = []
        dead, moved = np.zeros(rows.num_rows, bool), set()

        def merge(a: int, b: int) -> None:
            da, db = e[a] - s[a], e[b] - s[b]
            total = da + db or 1.0
            scores[a], e[a] = (scores[a] * da + scores[b] * db) / total, e[b]
            key_moment[a] |= key_moment[b]
            best[a] |= best[b]
            merges.append((a, b, da, db, total))
            dead[b] = True

        head, last = -1, -2
        for r in np.flatnonzero(alike).tolist():
            if r - 1 != last:
                head = r - 1
            if abs(scores[head] - scores[r]) <= 2:
                merge(head, r)
            else:
                head = r
            last = r

        row = np.flatnonzero(~dead)  # of each run; where a short one takes the next in, the next's place holds its row
        video = np.cumsum(new)[row]
        ends = np.array(e)[row] if merges else end[row]
        runs = np.bincount(video)
        many = runs[video] > 1
        if self.several:
            many |= video == video[0]
        known = len(row) if final else len(row) - min(2, int(runs[video[-1]]))  # runs whose next one is whole
        long = ends - start[row]
        short = many & ~((long >= self.micro) | ((long >= 1) & (key_moment | best)[row] & ~again[row]))
        short[0] &= not self.settled
        short[known:] = False

        def length(r: int) -> float:
            return e[r] - s[r]

        def is_short(r: int) -> bool:
            return not (length(r) >= self.micro or (length(r) >= 1 and (key_moment[r] or best[r]) and not again[r]))

        def relaxed(a: int, b: int) -> bool:
            if abs(s[b] - e[a]) > 0.15 or garbage[a] or garbage[b]:
                return False
            wide = any(length(r) < self.micro and again[r] for r in (a, b))
            shots = {rows.column("shot_type")[a].as_py(), rows.column("shot_type")[b].as_py()}
            kin = len(shots) == 1 or shots <= _FAMILIES[0] or shots <= (_FAMILIES[1] | {"SHAKY"} if wide else _FAMILIES[1])
            return kin or (wide and min(length(a), length(b)) < 1)

        stands: dict[int, int] = {}  # a run that is gone: the one before it then, or -1
        todo, done, again_at = iter(np.flatnonzero(short).tolist()), -1, -1

        def before(k: int) -> int:
            return stands.get(k - 1, k - 1) if k and video[k - 1] == video[k] else -1

        while True:
            k, again_at = (next(todo, -1), -1) if again_at < 0 else (again_at, -1)
            if k < 0:
                break
            if k <= done:
                continue
            done, r = k, int(row[k])
            if not is_short(r):
                continue
            b = before(k)
            f = k + 1 if k + 1 < len(row) and video[k + 1] == video[k] else -1
            if b >= 0 and relaxed(int(row[b]), r):
                merge(int(row[b]), r)
                stands[k] = b
            elif f >= 0 and relaxed(r, int(row[f])):
                merge(r, int(row[f]))
                row[f] = r
                stands[k] = b
            elif b >= 0:
                e[row[b]] = e[r]
                moved.add(int(row[b]))
                stands[k] = b
            elif f >= 0:
                s[row[f]] = s[r]
                moved.add(int(row[f]))
                stands[k] = b
            if k in stands and 0 <= f < known:
                again_at = f

        alive = np.ones(len(row), bool)
        alive[list(stands)] = False
        kept: list[int] = []
        if not final:
            kept = list(range(known, len(row)))
            at = before(kept[0]) if len(kept) == 2 else -1
            self.settled = at >= 0
            kept = [at, *kept] if at >= 0 else kept
            self.several = bool(many[-1])
            alive[kept] = False
        changed = {a for a, *_ in merges} | moved
        out = np.flatnonzero(alive)
        dirty = np.isin(row[out], np.fromiter(changed, np.int64, len(changed)))
        content = _contents(rows, merges, moved, s, e, scores)
        made = [_clean(rows.take(pa.array(row[out[~dirty]])), many[out[~dirty]])]
        if dirty.any():
            made.append(_rebuilt(rows, row[out[dirty]].tolist(), content))
        if final:
            self.held, self.settled, self.several = None, False, False
        else:
            self.held = _rebuilt(rows, row[kept].tolist(), content)
        return [m for m in made if m.num_rows]


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``batch`` with a merged_count of 1 where there is none."""
    at = batch.schema.get_field_index("merged_count")
    if at < 0:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ones(batch.num_rows, np.int64))], names=[*batch.schema.names, "merged_count"])
    counts = pc.fill_null(batch.column(at), 1)
    return batch.set_column(at, batch.schema.field(at), pc.if_else(pc.equal(counts, 0), pa.scalar(1, counts.type), counts))


def _numbers(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.fill_null(rows.column(name).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)


def _flag(rows: pa.RecordBatch, name: str) -> np.ndarray:
    if name not in rows.schema.names:
        return np.zeros(rows.num_rows, bool)
    return np.array(pc.fill_null(rows.column(name).cast(pa.bool_()), False).to_numpy(zero_copy_only=False))


def _in(rows: pa.RecordBatch, tiers: list[str]) -> np.ndarray:
    return pc.is_in(rows.column("tier"), pa.array(tiers, rows.column("tier").type)).to_numpy(zero_copy_only=False)


def _values(column: pa.Array) -> list:
    """The column's values, structs and maps as dicts."""
    if pa.types.is_struct(column.type):
        names = [f.name for f in column.type]
        parts = zip(*(_values(c) for c in column.flatten()), strict=True)
        return [dict(zip(names, v, strict=True)) if ok else None for v, ok in zip(parts, column.is_valid().to_pylist(), strict=True)]
    if pa.types.is_map(column.type):
        return [None if v is None else dict(v) for v in column.to_pylist()]
    return column.to_pylist()


def _contents(rows: pa.RecordBatch, merges: list[tuple], moved: set[int], s: list, e: list, scores: list) -> dict[int, dict]:
    """The changed columns of the rows that merge or move, after all merges."""
    some = sorted({r for a, b, *_ in merges for r in (a, b)} | moved)
    if not some:
        return {}
    names = [c for c in _CHANGED if c in rows.schema.names]
    part = rows.take(pa.array(some))
    content = {r: dict(zip(names, v, strict=True)) for r, v in zip(some, zip(*(_values(part.column(c)) for c in names), strict=True), strict=True)}
    for a, b, da, db, total in merges:
        x, y = content[a], content[b]
        if TIER_RANK.get(y["tier"], 0) > TIER_RANK.get(x["tier"], 0):
            x["tier"] = y["tier"]
        if "tags" in x:
            x["tags"] = sorted({*(x["tags"] or []), *(y["tags"] or [])})
        for c in _SPECIAL:
            if c in x:
                x[c] = x[c] or y[c]
        if "metrics" in x and (x["metrics"] or y["metrics"]):
            p, q = x["metrics"] or {}, y["metrics"] or {}
            x["metrics"] = {k: ((p.get(k) or 0.0) * da + (q.get(k) or 0.0) * db) / total for k in {*p, *q}}
        if "face_count" in x:
            x["face_count"] = max(x["face_count"] or 0, y["face_count"] or 0)
        x["merged_count"] += y["merged_count"]
    for a, *_ in merges:
        content[a]["score"] = scores[a]
    for r in {a for a, *_ in merges} | moved:
        content[r] |= {"start_time": s[r], "end_time": e[r], "duration": e[r] - s[r]}
    return content


def _rebuilt(rows: pa.RecordBatch, picked: list[int], content: dict[int, dict]) -> pa.RecordBatch:
    """The picked rows, with what has changed."""
    part = rows.take(pa.array(picked, pa.int64()))
    if not any(r in content for r in picked):
        return part
    columns = list(part.columns)
    for i, f in enumerate(rows.schema):
        if f.name in _CHANGED:
            old = _values(columns[i])
            new = [content[r][f.name] if r in content else v for r, v in zip(picked, old, strict=True)]
            if pa.types.is_map(f.type):
                new = [None if v is None else list(v.items()) for v in new]
            columns[i] = pa.array(new, f.type)
    return pa.RecordBatch.from_arrays(columns, schema=rows.schema)


def _clean(part: pa.RecordBatch, many: np.ndarray) -> pa.RecordBatch:
    """Rows as they came; where a video has several, the duration is the length."""
    at = part.schema.get_field_index("duration")
    kind = part.schema.field(at).type
    length = pc.subtract(part.column("end_time"), part.column("start_time")).cast(kind)
    return part.set_column(at, part.schema.field(at), pc.if_else(pa.array(many), length, part.column(at)))
