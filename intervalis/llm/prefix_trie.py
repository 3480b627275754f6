"""The trie of conversations that begin alike, by an external mergesort that knows common prefixes.

A turn is named by 128 bits of (role, text), a conversation by the row of its
turns' names. The trie is never held: conversations are sorted, and equal first
turns are neighbours then.

1. Equal conversations become one: rows are dealt by ranges of (name of the
   whole conversation, id), so that a conversation that a third of all repeat is
   many ranges; each task folds its ids in order into the hash of their list.
   A list that may go on in another range, or a long one, leaves as bounded
   chunks, which one streaming pass hashes in order.
2. The distinct conversations are dealt by ranges of their turns' names. Every
   task writes sorted runs of bounded size; a run carries, beside each
   conversation, how many turns it shares with the one before it (LCP).
3. A range's runs meet in a loser tree. Of two candidates the one that shares
   more turns with the last winner is the smaller; only equal LCPs make it look
   at turns, and only at those behind the shared ones. The merged stream drives
   a stack, the open path: a conversation that shares l turns closes all nodes
   deeper than l, and closed nodes are finished.
4. Nodes that a neighbouring range continues (on its first or last path, as far
   as the edge keys agree) are summed over ranges. Every count is a sum over
   ranges: a node and its bytes count where it was opened first.

A range's turns are held by one task, and so is one conversation's row of names
(24 bytes a turn); texts never leave the first step.

Turns are ordered by turn, null first, then by the digest of role and text;
null role or text is empty; repeated rows are turns each; rows with a null id
take no part; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervalis.llm._batches import bound_batches, tidy
from intervalis.plans.scratch import materialize

#: Bytes of a turn's name.
WIDE = 16
#: Turns of a sorted run, and of a range of runs.
RUN_TURNS, RANGE_TURNS = 1 << 15, 1 << 20
#: Ids of a chunk of a list that is hashed later.
CHUNK_IDS = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _name(data: Column) -> Column:
    return F.unhex(F.substring(F.sha2(data, 256), 1, 2 * WIDE))


def paths(conversations: DataFrame, near: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, near, path array<struct<d, b>>): the turns' names and their texts' bytes, in order.

    ``near``, a column of ``id``, says which conversations are dealt to one task; the id itself if missing.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")).cast("binary") for c in (role_col, text_col))
    named = _name(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role, text))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).alias("turn"), named.alias("d"), F.octet_length(text).cast("long").alias("b"))
    rows = rows.withColumn("near", F.col("id") if near is None else near)
    found = rows.repartition("near").groupBy("near", "id").agg(F.sort_array(F.collect_list(F.struct("turn", "d", "b"))).alias("turns"))
    return found.select("id", "near", F.transform("turns", lambda t: F.struct(t["d"].alias("d"), t["b"].alias("b"))).alias("path"))


def with_heads(found: DataFrame, heads: int) -> DataFrame:
    """(id, path): the first crc32(id) % (heads + 1) turns of each path give way to those of the path whose id is ``near``."""
    h = (F.crc32(F.col("id").cast("string")) % (heads + 1)).cast("int")
    leader = F.first(F.when(F.col("id") == F.col("near"), F.slice("path", 1, heads)), ignorenulls=True).over(Window.partitionBy("near"))
    rows = found.withColumn("h", h).withColumn("head", F.coalesce(leader, F.slice("path", 1, 0)))
    return rows.select("id", F.concat(F.slice("head", 1, F.col("h")), F.slice("path", F.col("h") + 1, F.size("path"))).alias("path"))


_DISTINCT = pa.schema([("name", pa.binary()), ("least", pa.int64()), ("n", pa.int64()), ("ids", pa.string()), ("ends", pa.string()), ("ds", pa.list_(pa.binary())), ("bs", pa.list_(pa.int64()))])
_DISTINCT_DDL = "name binary, least long, n long, ids string, ends string, ds array<binary>, bs array<long>"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _folded(chunk_ids: int):
    """Equal conversations, sorted by (name, id), become one row; lists of ids that may go on elsewhere, or are long, stay chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, path, first, chunked, out = None, [], (None, None), True, False, []

        def chunk() -> tuple:
            return (name, ids[0], len(ids), ",".join(map(str, ids)), None, *path)

        for batch in batches:
            for key, i, ds, bs in zip(*(batch.column(c).to_pylist() for c in ("name", "id", "ds", "bs")), strict=True):
                if key != name:
                    if ids and not (first or chunked):
                        out.append((name, ids[0], len(ids), None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), *path))
                    elif ids:
                        out.append(chunk())
                    first, chunked = name is None, False
                    name, ids, path = key, [], (ds, bs)
                elif len(ids) == chunk_ids:
                    out.append(chunk())
                    ids, path, chunked = [], (None, None), True
                ids.append(i)
            yield _table(out, _DISTINCT)
            out = []
        if ids:
            yield _table([chunk()], _DISTINCT)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks, sorted by (name, least id), become one row a name."""
    name, state, row, out = None, None, [], []
    for batch in batches:
        for key, least, n, ids, ds, bs in zip(*(batch.column(c).to_pylist() for c in ("name", "least", "n", "ids", "ds", "bs")), strict=True):
            if key != name:
                if row:
                    out.append((name, row[0], row[1], None, state.hexdigest(), *row[2:]))
                name, state, row = key, hashlib.sha256(ids.encode()), [least, n, ds, bs]
            else:
                state.update(b"," + ids.encode())
                row[1] += n
        yield _table(out, _DISTINCT)
        out = []
    if row:
        yield _table([(name, row[0], row[1], None, state.hexdigest(), *row[2:])], _DISTINCT)


def distinct_paths(found: DataFrame) -> DataFrame:
    """(name, least, n, ends, ds, bs): each distinct path with its least id, number of ids, and the hash of their list."""
    ds = F.transform("path", lambda t: t["d"])
    rows = found.select("id", ds.alias("ds"), F.transform("path", lambda t: t["b"]).alias("bs"))
    rows = rows.withColumn("name", _name(F.array_join(F.transform("ds", F.hex), "").cast("binary")))
    rows = materialize(rows, "trie-paths")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = rows.repartitionByRange(parts, "name", "id").sortWithinPartitions("name", "id").mapInArrow(tidy(_folded(CHUNK_IDS)), _DISTINCT_DDL)
    once = materialize(once, "trie-folded")
    whole = once.filter("ends is not null").drop("ids")
    late = once.filter("ends is null").repartition("name").sortWithinPartitions("name", "least").mapInArrow(tidy(_hashed), _DISTINCT_DDL).drop("ids")
    return materialize(whole.unionByName(late), "trie-distinct")


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """How many turns two keys share, where they are known to share ``at``."""
    most = min(len(a), len(b)) // WIDE
    if a[: most * WIDE] == b[: most * WIDE]:
        return most
    while a[at * WIDE : (at + 1) * WIDE] == b[at * WIDE : (at + 1) * WIDE]:
        at += 1
    return at


_RUN = pa.schema([("range", pa.int32()), ("run", pa.int32()), ("pos", pa.int32()), ("key", pa.binary()), ("lcp", pa.int32()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string()), ("bs", pa.list_(pa.int64()))])
_RUN_DDL = "range int, run int, pos int, key binary, lcp int, n long, least long, ends string, bs array<long>"


def _runs(run_turns: int):
    """Sorted runs of one range; each row says how many turns it shares with the row before it."""

    def sorted_run(of_range: int, run: int, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0])
        lcps = [0, *(shared(a[0], b[0]) for a, b in pairwise(rows))]
        return _table([(of_range, run, pos, r[0], lcp, *r[1:]) for pos, (r, lcp) in enumerate(zip(rows, lcps, strict=True))], _RUN)

    def of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, turns, run = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            for ds, *rest in zip(*(batch.column(c).to_pylist() for c in ("ds", "n", "least", "ends", "bs")), strict=True):
                rows.append((b"".join(ds), *rest))
                turns += len(ds) + 1
                if turns >= run_turns:
                    yield sorted_run(number, run, rows)
                    rows, turns, run = [], 0, run + 1
        if rows:
            yield sorted_run(number, run, rows)

    return of_range


class LoserTree:
    """Merges sorted runs of (keys, lcps); a candidate's LCP is with the key that came out last, or that beat it."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.lcp = [0 if k < len(runs) and runs[k][0] else -1 for k in range(self.leaves)]
        self.loser = [0] * self.leaves
        self.compared = 0
        winners = [0] * self.leaves + list(range(self.leaves))
        for node in range(self.leaves - 1, 0, -1):
            winners[node], self.loser[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if self.leaves > 1 else 0

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); only equal LCPs look at turns."""
        lcp = self.lcp
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        if lcp[a] < 0:
            return a, b
        x, y = self.runs[a][0][self.at[a]], self.runs[b][0][self.at[b]]
        self.compared += 1
        l = shared(x, y, lcp[a])
        if x[l * WIDE :] <= y[l * WIDE :]:
            lcp[b] = l
            return a, b
        lcp[a] = l
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in it, LCP with the key before) in the order of the keys."""
        while self.lcp[self.winner] >= 0:
            w = self.winner
            yield w, self.at[w], self.lcp[w]
            self.at[w] += 1
            keys, lcps = self.runs[w]
            self.lcp[w] = lcps[self.at[w]] if self.at[w] < len(keys) else -1
            node = (w + self.leaves) // 2
            while node:
                w, self.loser[node] = self._play(w, self.loser[node])
                node //= 2
            self.winner = w


_NODE = pa.schema(
    [("range", pa.int32()), ("node", pa.binary()), ("up", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("bytes_all", pa.int64()), ("bytes_once", pa.int64()), ("ends_sha256", pa.string())]
)
_NODE_DDL = "range int, node binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, bytes_all long, bytes_once long, ends_sha256 string"


class Node:
    """A node of the open path; ``waiting`` are its closed children, whose rows need its least member."""

    __slots__ = ("before", "bytes_all", "bytes_once", "children", "ends", "inner", "least", "leaves", "n", "own", "waiting")

    def __init__(self, own: int, before: bool):
        self.own, self.before = own, before  # before: an earlier range has opened it
        self.n = self.children = self.leaves = self.bytes_all = self.bytes_once = 0
        self.least, self.ends, self.inner, self.waiting = None, None, False, []


def finished(merged: Iterator[tuple[bytes, int, int, int, str, list[int]]], last_before: bytes | None, first_after: bytes | None, of_range: int) -> Iterator[tuple]:
    """Rows of nodes from the merged stream of (key, LCP, n, least id, ends, bytes of each turn) of one range.

    Whole nodes carry their parent's least member, or the parent's name in ``up`` where other
    ranges share the parent; nodes that other ranges share carry their own name in ``node``.
    """
    path: list[Node] = []
    key = b""

    def name(depth: int) -> bytes:
        return hashlib.sha256(b"%d:" % depth + key[: depth * WIDE]).digest()[:WIDE]

    def close(down_to: int, after: int) -> Iterator[tuple]:
        """Closes all nodes deeper than ``down_to``; those down to depth ``after`` go on in the next range."""
        while len(path) - 1 > down_to:
            depth, x = len(path) - 1, path.pop()
            x.leaves += not x.inner and depth > after
            x.bytes_all += x.n * x.own
            x.bytes_once += 0 if x.before else x.own
            counts = (x.n, x.children, x.leaves, x.bytes_all, x.bytes_once, x.ends)
            partial = x.before or depth <= after
            up = path[-1] if path else None
            if partial:
                me = name(depth)
                yield of_range, me, name(depth - 1) if up else None, x.least, depth, None, *counts
                yield from ((of_range, None, me, least, depth + 1, None, *rest) for least, rest in x.waiting)
            else:
                yield from ((of_range, None, None, least, depth + 1, x.least, *rest) for least, rest in x.waiting)
                if up:
                    up.waiting.append((x.least, counts))
                else:
                    yield of_range, None, None, x.least, depth, None, *counts
            if up:
                up.inner = True
                up.n, up.leaves, up.children = up.n + x.n, up.leaves + x.leaves, up.children + (not x.before)
                up.bytes_all, up.bytes_once = up.bytes_all + x.bytes_all, up.bytes_once + x.bytes_once
                up.least = x.least if up.least is None else min(up.least, x.least)

    for following, lcp, n, least, ends, own in merged:
        opened = -1 if path or last_before is None else shared(following, last_before)
        if path:
            yield from close(lcp, -1)
        key = following
        while len(path) - 1 < len(own):
            depth = len(path)
            path.append(Node(own[depth - 1] if depth else 0, depth <= opened))
        tip = path[-1]
        tip.n, tip.least, tip.ends = tip.n + n, least if tip.least is None else min(tip.least, least), ends
    if path:
        yield from close(-1, -1 if first_after is None else shared(key, first_after))


def _trie_of_range(rows: pa.Table, edges: pa.Table) -> pa.Table:
    rows = rows.sort_by([("run", "ascending"), ("pos", "ascending")])
    keys, lcps, ns, least, ends, own = (rows.column(c).to_pylist() for c in ("key", "lcp", "n", "least", "ends", "bs"))
    run = np.asarray(rows.column("run"))
    starts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
    tree = LoserTree([(keys[a:b], lcps[a:b]) for a, b in pairwise(starts)])
    merged = ((keys[k], lcp, ns[k], least[k], ends[k], own[k]) for r, pos, lcp in tree for k in [starts[r] + pos])
    (before,), (after,) = (edges.column(c).to_pylist() for c in ("last_before", "first_after"))
    nodes = list(finished(merged, before, after, rows.column("range")[0].as_py()))
    return pa.Table.from_batches([_table(nodes, _NODE)])


def prefix_trie(found: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``found`` (id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = found.sparkSession
    bound_batches(spark)
    once = distinct_paths(found)
    turns = once.agg(F.coalesce(F.sum(F.size("ds") + 1), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // RANGE_TURNS))
    runs = materialize(once.repartitionByRange(ranges, "ds").mapInArrow(tidy(_runs(RUN_TURNS)), _RUN_DDL), "trie-runs")
    # every range but the last holds its own upper bound, so its neighbours are the numbers beside it
    edge = runs.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    before = edge.select((F.col("range") + 1).alias("range"), F.col("high").alias("last_before"))
    after = edge.select((F.col("range") - 1).alias("range"), F.col("low").alias("first_after"))
    edges = edge.select("range").join(before, "range", "left").join(after, "range", "left").withColumnRenamed("range", "of")
    nodes = materialize(runs.groupBy("range").cogroup(edges.groupBy("of")).applyInArrow(_trie_of_range, _NODE_DDL), "trie-nodes")

    counts = ["n_convs", "n_children", "n_leaves", "bytes_all", "bytes_once"]
    parts = nodes.filter("node is not null")
    common = materialize(parts.groupBy("node", "up", "depth").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in counts), F.max("ends_sha256").alias("ends_sha256")), "trie-common")
    names = common.select(F.col("node").alias("up"), F.col("conv_id").alias("parent"))
    above = parts.select("range", F.col("node").alias("up")).join(names, "up")  # a row for each range, so no key is hot
    open_ = nodes.filter("node is null and up is not null").join(above, ["range", "up"]).withColumn("parent_conv_id", F.col("parent"))
    shape = ["conv_id", "depth", "parent_conv_id", *counts, "ends_sha256"]
    whole = nodes.filter("node is null and up is null").select(shape)
    summed = common.join(names, "up", "left").withColumnRenamed("parent", "parent_conv_id").select(shape)
    out = whole.unionByName(open_.select(shape)).unionByName(summed)
    return out.select(*shape[:3], "n_convs", "n_children", "n_leaves", (F.col("bytes_all") - F.col("bytes_once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
