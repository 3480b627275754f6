"""Best-fit packing by the configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits a sequence. The program asks
for the least total number of configurations that covers the histogram; it has
a row for each length (at most ``capacity`` of them, whatever the table's size)
and far too many columns to write down, so it is solved from its dual:

* each length has a price, at first its share of a sequence, that falls
  exponentially as the length gets covered (multiplicative weights);
* pricing finds the configuration worth most, a bounded knapsack solved by
  dynamic programming; the same table gives the best one around each of the
  lengths that are covered least;
* a configuration is used for a part of its scarcest length, prices change, and
  so on until the covered tokens are all tokens.

Rounding takes each configuration, the most used first, for the whole part of
its use, once at least, as far as all its pieces are left; what is left over is
a histogram again, for the same program, and the last pieces go best fit
decreasing. Every piece is placed exactly once, so sequences have no gaps.

Spark encodes each text once, counts lengths, numbers the pieces of a length by
prefix sums of the counts of each task, and finds every piece's place by a
binary search in the plan (at most a few entries for each of ``capacity``
lengths and configuration, independent of the table). Texts stay where they are.

Documents longer than the capacity are cut into pieces of the capacity, the
last one shorter; no others are cut. Null text is an empty document (its closing
id alone); null ids are kept; repeated rows are packed each; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from intervalis.llm._batches import bound_batches, tidy
from intervalis.llm.word_bpe import WordEncoder
from intervalis.plans.scratch import materialize

CAPACITY = 4096
END_ID = 1
#: Prices fall by exp(-FALL) as a length is covered once; with so many lengths or more a configuration is used for all of its scarcest one at once.
FALL, LENGTHS = 3.0, 1000
#: Configurations taken from one pricing, pricings of a pass, and passes over the histogram until prices have settled.
AT_ONCE, PRICINGS, PASSES = 48, 60, 2
#: Configurations around a length that are worth less than this part of the best one are not used.
NEAR_BEST = 0.95
#: Programs solved, each on what rounding leaves; with each, the rest also goes best fit, and the least plan is taken.
ROUNDS = 5


class Knapsack:
    """Best value of each capacity over items (length, most copies) with prices, and what attains it."""

    def __init__(self, lengths: np.ndarray, most: np.ndarray, prices: np.ndarray, capacity: int):
        self.items: list[tuple[int, int]] = []  # (place of the length, copies)
        for k, m in enumerate(np.minimum(most, capacity // lengths).tolist()):
            part = 1
            while m > 0:  # bounded copies as parts 1, 2, 4, ... and a rest
                self.items.append((k, min(part, m)))
                m, part = m - part, 2 * part
        self.sizes = [int(lengths[k]) * c for k, c in self.items]
        best = np.zeros(capacity + 1)
        self.prices, self.taken = prices, np.zeros((len(self.items), capacity + 1), dtype=bool)
        for row, ((k, c), size) in enumerate(zip(self.items, self.sizes, strict=True)):
            with_it = best[: capacity + 1 - size] + prices[k] * c
            better = with_it > best[size:]
            self.taken[row, size:] = better
            np.copyto(best[size:], with_it, where=better)
        self.best = float(best[capacity])

    def worth(self, config: Counter) -> float:
        """A configuration's value as a part of the best one's."""
        return sum(self.prices[k] * c for k, c in config.items()) / self.best

    def within(self, capacity: int) -> Counter:
        """Copies by place of the best filling of a capacity."""
        out: Counter = Counter()
        column = self.taken[:, capacity]
        row = len(self.items)
        while row and (used := np.flatnonzero(column[:row])).size:
            row = int(used[-1])
            k, c = self.items[row]
            out[k] += c
            capacity -= self.sizes[row]
            column = self.taken[:, capacity]
        return out


def fractional(lengths: np.ndarray, counts: np.ndarray, covered: np.ndarray, capacity: int, passes: int) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations ((place, copies), ...) and their use, which together cover about all of the histogram.

    ``covered``, how often each length's count has been covered so far, sets the prices and is
    updated; passes before the last one only settle the prices.
    """
    tokens = float(lengths @ counts)
    most, step = np.minimum(counts, capacity // lengths), min(1.0, max(len(lengths) / LENGTHS, 0.02))
    use: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(passes):
        use, left = {}, tokens
        for _ in range(PRICINGS):
            prices = lengths / capacity * np.exp(-FALL * (covered - covered.min()))
            table = Knapsack(lengths, most, prices, capacity)
            around = np.argsort(covered - lengths / capacity, kind="stable")[: min(AT_ONCE, len(lengths) // 8)]  # covered least; of those the longest
            for k in (-1, *around.tolist()):
                config = table.within(capacity - (int(lengths[k]) if k >= 0 else 0))
                if k >= 0:
                    config[k] += 1
                    if config[k] > most[k] or table.worth(config) < NEAR_BEST:
                        continue
                places, copies = np.array(list(config)), np.array(list(config.values()))
                part = step * float((counts[places] / copies).min())
                key = tuple(sorted(config.items()))
                use[key] = use.get(key, 0.0) + part
                covered[places] += part * copies / counts[places]
                left -= part * float(lengths[places] @ copies)
            if left < 0.02 * tokens:
                break
    return use


def rounded(use: dict[tuple[tuple[int, int], ...], float], counts: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(configuration, whole number of uses), most used first, out of ``counts``, which loses the pieces used."""
    out = []
    for config, x in sorted(use.items(), key=lambda e: (-e[1], e[0])):
        n = min(max(1, int(x)), *(int(counts[k]) // c for k, c in config))
        if n > 0:
            for k, c in config:
                counts[k] -= n * c
            out.append((config, n))
    return out


def best_fit_decreasing(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Each piece, longest first, goes where it leaves least room; sequences that are alike are filled together."""
    alike: dict[int, Counter] = {}  # room: how many sequences have which configuration

    def put(config: tuple, room: int, k: int, copies: int, n: int) -> None:
        if n and copies:
            alike.setdefault(room - copies * int(lengths[k]), Counter())[(*config, (k, copies))] += n

    for k in np.argsort(-lengths, kind="stable").tolist():
        size, n = int(lengths[k]), int(counts[k])
        for room in sorted(r for r in alike if r >= size):
            if not n:
                break
            for config, m in sorted(alike.pop(room).items()):
                per = room // size
                full = min(m, n // per)
                put(config, room, k, per, full)
                part = min(n - full * per, per - 1) if full < m else 0
                put(config, room, k, part, 1)
                n -= full * per + part
                if rest := m - full - (part > 0):
                    alike.setdefault(room, Counter())[config] += rest
        per = capacity // size
        put((), capacity, k, per, n // per)
        put((), capacity, k, n % per, 1)
    return sorted((config, n) for group in alike.values() for config, n in group.items())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations of (length, copies), longest first, and how many sequences have each; together exactly the histogram."""
    lengths = np.array(sorted(histogram, reverse=True), dtype=np.int64)
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    chosen: list[tuple[tuple[tuple[int, int], ...], int]] = []
    covered, found, bound = np.zeros(len(lengths)), [], -(-int(lengths @ counts) // capacity)
    for turn in range(ROUNDS + 1):
        found.append(chosen + best_fit_decreasing(lengths, counts, capacity))
        there = np.flatnonzero(counts)
        if turn == ROUNDS or not len(there) or (turn and sum(n for _, n in found[-1]) == bound):
            break
        left, so_far = counts[there], covered[there]
        used = rounded(fractional(lengths[there], left, so_far, capacity, 1 if turn else PASSES), left)
        if not used:
            break
        chosen = chosen + [(tuple((int(there[k]), c) for k, c in config), n) for config, n in used]
        counts[there], covered[there] = left, so_far
    out = min(reversed(found), key=lambda plan: sum(n for _, n in plan))  # the program's, of equal ones
    return [(tuple(sorted(((int(lengths[k]), c) for k, c in config), reverse=True)), n) for config, n in out]


_SCHEMA = ["piece int", "start long", "length long", "ids_crc32 long"]


def _pieces(path: str, capacity: int, id_type: pa.DataType):
    """Pieces of each text, and their number among those of their length in the task."""
    schema = pa.schema([("id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])

    def of(encoder: WordEncoder, text: str) -> Iterator[np.ndarray]:
        held: list[np.ndarray] = []
        size = 0
        for ids in (*encoder.parts(text), np.array([END_ID], dtype="<u4")) if len(text) < 1 << 16 else _with_end(encoder.parts(text)):
            while size + len(ids) >= capacity:
                yield np.concatenate([*held, ids[: capacity - size]])
                held, ids, size = [], ids[capacity - size :], 0
            held.append(ids)
            size += len(ids)
        if size:
            yield np.concatenate(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = WordEncoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = 0
                for number, ids in enumerate(of(encoder, text or "")):
                    n = len(ids)
                    rows.append((doc, number, start, n, zlib.crc32(ids.astype("<u4").tobytes()), task, seen[n]))
                    seen[n] += 1
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return run


def _with_end(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    yield from parts
    yield np.array([END_ID], dtype="<u4")


class Places:
    """Where the r-th piece of a length goes: sorted starts of runs of ranks, and for each run its sequences, copies and offset."""

    def __init__(self, configs: list[tuple[tuple[tuple[int, int], ...], int]]):
        taken: Counter = Counter()
        rows, first = [], 0
        for config, n in configs:
            offset = 0
            for length, copies in config:
                rows.append((length, taken[length], first, copies, offset))
                taken[length] += n * copies
                offset += length * copies
            first += n
        self.sequences = first
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.rank, self.first, self.copies, self.offset = (np.ascontiguousarray(table[:, k]) for k in range(1, 5))
        self.lengths, begins = np.unique(table[:, 0], return_index=True)
        self.bounds = np.append(begins, len(table))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        values, starts = np.unique(length[order], return_index=True)
        for value, a, b in zip(values, starts, np.append(starts[1:], len(order)), strict=True):
            k = np.searchsorted(self.lengths, value)
            low, high = self.bounds[k], self.bounds[k + 1]
            rows = order[a:b]
            at = low + np.searchsorted(self.rank[low:high], rank[rows], side="right") - 1
            inside = rank[rows] - self.rank[at]
            sequence[rows] = self.first[at] + inside // self.copies[at]
            offset[rows] = self.offset[at] + inside % self.copies[at] * value
        return sequence, offset


def _placed(places: Places, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places.of(*(np.asarray(batch.column(c)) for c in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, found)], names=[*names, "sequence_id", "offset"])

    return run


def pack_best(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: the id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a BPE file with word ends of the tokenizers library, present on every worker.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    cut = rows.mapInArrow(tidy(_pieces(tokenizer, capacity, to_arrow_type(rows.schema["id"].dataType))), f"id {kind}, {', '.join(_SCHEMA)}, task int, nth long")
    cut = materialize(cut, "packing-pieces")
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    per_task = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    # at most ``capacity`` rows
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(plan(histogram, capacity))
    ranked = cut.join(per_task.select("length", "task", "before"), ["length", "task"]).withColumn("rank", F.col("nth") + F.coalesce("before", F.lit(0)))
    names = ["id", *(c.split()[0] for c in _SCHEMA)]
    out = ranked.select(*names, "rank").mapInArrow(_placed(places, names), f"id {kind}, {', '.join(_SCHEMA)}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
