"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives every vector a string of hash bits, the sides of random
hyperplanes through the mean of a bounded sample, and keeps the strings sorted.
A query descends each tree to its longest matching prefix and then ascends all
trees together, a bit at a time: the rows that share the shorter prefix join
the candidates. It stops at the level where a neighbour at the distance of its
kth nearest so far would have met it in some tree with the wanted probability;
close neighbours thus end the ascent early, and spread-out data late.

The index is cut by row into blocks, each with its own sorted arrays, so no
bucket is too large for a task; every row is in every tree. Queries meet one
block first, which gives the kth distances with which they enter the others.
Candidates' distances are exact.

Null, zero and non-finite vectors and null ids take no part; shorter vectors
end in zeros; rows that share an id are rows of their own; ties go
to the smaller id; an empty table or query set gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalis.llm import _vectors as V
from intervalis.llm._batches import bound_batches
from intervalis.plans.scratch import materialize

TREES, BITS, MEET = 64, 24, 0.92
FOUND = "query_row long, query_id long, vec_id long, score double"


def hyperplanes(width: int, trees: int, bits: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, trees * bits))


def strings(points: np.ndarray, mean: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """(rows x trees) hash strings, the first bit the highest."""
    sides = ((points - mean) @ planes > 0).reshape(len(points), -1, bits)
    return sides @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


class Forest:
    def __init__(self, codes: np.ndarray, bits: int):
        self.bits = bits
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=0)

    def ranges(self, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For queries x trees: where the rows that share the first ``level`` bits lie."""
        rest = (1 << (self.bits - level)) - 1
        low, high = np.empty(codes.shape, dtype=np.int64), np.empty(codes.shape, dtype=np.int64)
        for t in range(codes.shape[1]):
            low[:, t] = np.searchsorted(self.sorted[:, t], codes[:, t] & ~rest)
            high[:, t] = np.searchsorted(self.sorted[:, t], codes[:, t] | rest, side="right")
        return low, high

    def members(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The distinct rows in one query's ranges."""
        mask = np.zeros(len(self.order), dtype=bool)
        for t in np.flatnonzero(high > low):
            mask[self.order[low[t] : high[t], t]] = True
        return np.flatnonzero(mask)


def stop_level(distance: float, radius: float, trees: int, meet: float) -> int:
    """The longest prefix that a neighbour at this distance shares in some tree with probability ``meet``."""
    angle = 2 * np.arcsin(min(1.0, distance / (2 * radius))) if radius > 0 else np.pi
    agree = 1 - angle / np.pi
    if agree <= 0:
        return 0
    each = 1 - (1 - meet) ** (1 / trees)
    return int(np.log(each) / np.log(agree)) if agree < 1 else 1 << 30


def _searched(shared, k: int, trees: int, bits: int, meet: float):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        q, d = V.two_matrices(queries, data)
        mean = np.zeros(q.shape[1])
        mean[: len(shared.value)] = shared.value[: len(mean)]
        planes = hyperplanes(q.shape[1], trees, bits)
        q_codes, forest = strings(q, mean, planes, bits), Forest(strings(d, mean, planes, bits), bits)
        radius = np.linalg.norm(q - mean, axis=1)
        squares, ids, rows = (d**2).sum(axis=1), data["id"].to_numpy(), data["row"].to_numpy()
        own_ids, own_rows = queries["id"].to_numpy(), queries["row"].to_numpy()
        near = queries["least"].fill_null(np.inf).to_numpy().copy()
        out: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        waiting = np.arange(len(q))
        for level in range(bits, -1, -1):  # all trees ascend together
            if not len(waiting):
                break
            low, high = forest.ranges(q_codes[waiting], level)
            reached = (high - low).sum(axis=1)
            for j, i in enumerate(waiting):
                known = np.isfinite(near[i])
                if level and (level > stop_level(near[i], radius[i], trees, meet) if known else reached[j] < 4 * k):
                    continue
                at = forest.members(low[j], high[j])
                at = at[rows[at] != own_rows[i]]
                about = squares[at] - 2 * (d[at] @ q[i])
                if len(at) > k:
                    at = at[about <= np.partition(about, k - 1)[k - 1] + 1e-9 * (1 + np.abs(about).max())]
                exact = np.sqrt(((d[at] - q[i]) ** 2).sum(axis=1))
                order = np.lexsort((ids[at], exact))[:k]
                kept[i] = ids[at][order], exact[order]
                if len(order) == k:
                    near[i] = min(near[i], exact[order[-1]])
            waiting = np.array([i for i in waiting if not np.isfinite(near[i]) or level > stop_level(near[i], radius[i], trees, meet)], dtype=np.int64)
        for i, (found, exact) in enumerate(kept):
            out["query_row"] += [own_rows[i]] * len(found)
            out["query_id"] += [own_ids[i]] * len(found)
            out["vec_id"] += found.tolist()
            out["score"] += exact.tolist()
        return pa.table(out, schema=pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return run


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, bits: int = BITS, meet: float = MEET) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found, by Euclidean distance; ``is_query`` is over the column id."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = V.usable(vectors, id_col, vector_col, nonzero=True).withColumn("grp", F.lit(0).cast("long"))
    placed = materialize(V.dealt(rows, V.DATA_ROWS), "forest-rows")
    some = V.sample(placed)
    mean = spark.sparkContext.broadcast(some.mean(axis=0) if len(some) else np.zeros(0))
    data = placed.select("row", "id", "v", "grp", "block")
    asked = materialize(V.dealt(placed.filter(is_query).select("row", "id", "v", "grp"), V.QUERY_ROWS), "forest-queries").select("row", "id", "v", "grp", "block")
    d_blocks = placed.select(F.col("grp").alias("d_grp"), F.col("block").alias("d_block")).distinct()
    q_blocks = asked.select(F.col("grp").alias("q_grp"), F.col("block").alias("q_block")).distinct()
    pairs = q_blocks.join(d_blocks, F.col("q_grp") == F.col("d_grp"))
    search = _searched(mean, k, trees, bits, meet)
    first = materialize(V.in_pairs(asked.withColumn("least", F.lit(None).cast("double")), data, pairs.filter("d_block = 0"), search, FOUND), "forest-first")
    kth = V.best(first, ["score"], k).filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("least"))
    second = V.in_pairs(asked.join(kth, "row", "left"), data, pairs.filter("d_block <> 0"), search, FOUND)
    return V.best(first.unionByName(second), ["score"], k).drop("query_row")
