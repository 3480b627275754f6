"""Exact top-k inner products by a dual-tree search over cover trees.

The upper level of the tree is a net of centres chosen farthest-first from a
bounded sample; every row and query goes to its nearest centre, with the
covering radius of all that do. Below, each block of rows and of queries has a
cover tree of its own: children's centres are at least half the parent's
radius apart and cover it (a node that such a net would only crumble stays a
leaf). For a pair of nodes with centres c, d and radii r, s no product exceeds
c.d + r|d| + s|c| + rs, so the pair is pruned if that is below the worst kth
score of the query node. Queries meet a block of their own centre first, which
gives kth scores; whole pairs of blocks that cannot beat them are never joined.

Components become floor(256 x); products are exact integers (beyond 2^63 they
wrap). Shorter vectors end in zeros. Null vectors, null or non-finite
components and null ids take no part; rows that share an id
are rows of their own, as queries and as candidates; an empty table or query set gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalis.llm import _vectors as V
from intervalis.llm._batches import bound_batches
from intervalis.plans.scratch import materialize

CENTRES, LEAF, CRUMBLES = 32, 64, 32
_NONE = np.iinfo(np.int64).min
FOUND = "query_row long, query_id long, vec_id long, score long"


class Node:
    def __init__(self, points: np.ndarray, members: np.ndarray):
        self.members, self.centre = members, points[members[0]]
        self.norm = float(np.linalg.norm(self.centre))
        self.distances = np.linalg.norm(points[members] - self.centre, axis=1)
        self.radius = float(self.distances.max())
        self.children: list[Node] = []


def cover_tree(points: np.ndarray) -> Node:
    """Nesting: a node's first child has its centre. Covering and separation: children lie within, and centres beyond, half its radius."""
    root = Node(points, np.arange(len(points)))
    open_ = [root]
    while open_:
        node = open_.pop()
        if len(node.members) <= LEAF or not node.radius:
            continue
        rest, parts = node.members, []
        while len(rest):
            near = np.linalg.norm(points[rest] - points[rest[0]], axis=1) <= node.radius / 2
            parts.append(rest[near])
            rest = rest[~near]
            if len(parts) == CRUMBLES and len(node.members) - len(rest) < len(node.members) / 4:
                parts = []
                break
        if len(parts) > 1:
            node.children = [Node(points, p) for p in parts]
            open_ += node.children
    return root


def upper_bound(a: Node, b: Node) -> float:
    return float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius


class Search:
    """The k best data rows of every query so far; rows are told apart by their numbers, ids may repeat."""

    def __init__(self, queries: np.ndarray, query_rows: np.ndarray, data: np.ndarray, data_rows: np.ndarray, data_ids: np.ndarray, k: int, least: np.ndarray):
        self.q, self.qr, self.d, self.dr, self.di, self.k = queries, query_rows, data, data_rows, data_ids, k
        self.exact = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(1, data.shape[1]) < 2**53
        self.scores = np.full((len(queries), k), _NONE)
        self.ids = np.zeros((len(queries), k), dtype=np.int64)
        self.worst = least.copy()  # kth score known of each query

    def pairs(self, a: Node, b: Node) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            bound = upper_bound(a, b)
            if bound + 1e-6 * (1 + abs(bound)) < self.worst[a.members].min():
                continue
            if not a.children and not b.children:
                self.leaves(a.members, b.members)
            elif b.children and (not a.children or b.radius >= a.radius):
                stack += sorted(((a, c) for c in b.children), key=lambda p: upper_bound(*p))
            else:
                stack += [(c, b) for c in a.children]

    def leaves(self, rows: np.ndarray, cols: np.ndarray) -> None:
        if self.exact:
            products = self.q[rows] @ self.d[cols].T
        else:
            products = self.q[rows].astype(np.int64) @ self.d[cols].astype(np.int64).T
        own = self.qr[rows][:, None] == self.dr[cols]
        floor = self.worst[rows]
        if len(cols) > self.k + 1:  # one may be the query itself
            floor = np.maximum(floor, np.partition(products, len(cols) - self.k - 1, axis=1)[:, len(cols) - self.k - 1].astype(np.int64))
        r, c = np.nonzero((products >= floor[:, None]) & ~own)
        touched = np.unique(r)
        old_r, old_c = np.nonzero(self.scores[rows[touched]] != _NONE)
        row = np.concatenate([touched[old_r], r])
        score = np.concatenate([self.scores[rows[touched]][old_r, old_c], products[r, c].astype(np.int64)])
        ids = np.concatenate([self.ids[rows[touched]][old_r, old_c], self.di[cols[c]]])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        row, place = rows[row[keep]], place[keep]
        self.scores[row, place], self.ids[row, place] = score[keep], ids[keep]
        self.worst[rows] = np.maximum(self.worst[rows], self.scores[rows, self.k - 1])


def _searched(k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        q, d = V.two_matrices(queries, data)
        ids, own, least = queries["id"].to_numpy(), queries["row"].to_numpy(), queries["least"].fill_null(_NONE).to_numpy()
        search = Search(q, own, d, data["row"].to_numpy(), data["id"].to_numpy(), k, least.astype(np.int64))
        if len(q) and len(d):
            search.pairs(cover_tree(q), cover_tree(d))
        r, c = np.nonzero(search.scores != _NONE)
        return pa.table({"query_row": own[r], "query_id": ids[r], "vec_id": search.ids[r, c], "score": search.scores[r, c]}, schema=pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    return run


def _net(points: np.ndarray) -> np.ndarray:
    """Farthest-first centres."""
    if not len(points):
        return np.zeros((1, 0))
    chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < CENTRES and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = V.matrix(batch.column("v"), centres.shape[1])
            own = np.pad(centres, ((0, 0), (0, points.shape[1] - centres.shape[1])))
            squares = (points**2).sum(axis=1)[:, None] + (own**2).sum(axis=1) - 2 * points @ own.T
            grp = squares.argmin(axis=1)
            reach = np.linalg.norm(points - own[grp], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("v"), pa.array(grp, pa.int64()), pa.array(reach)], names=["row", "id", "v", "grp", "reach"])

    return run


def top_k_products(vectors: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest integer inner products; ``is_query`` is over the column id."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = V.usable(vectors, id_col, vector_col)
    rows = rows.select("row", "id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    rows = materialize(rows, "cover-rows")
    centres = spark.sparkContext.broadcast(_net(V.sample(rows)))

    def assigned(some: DataFrame, most: int) -> DataFrame:
        """To the nearest of the first centres, which are a coarser net."""
        return some.mapInArrow(lambda batches: _assigned(centres.value[:most])(batches), "row long, id long, v array<double>, grp long, reach double")

    placed = materialize(V.dealt(assigned(rows, CENTRES), V.DATA_ROWS), "cover-placed")
    queries = rows.filter(is_query)
    asked = materialize(V.dealt(assigned(queries, max(1, min(CENTRES, queries.count() // V.QUERY_ROWS))), V.QUERY_ROWS), "cover-queries")
    d_blocks = placed.select(F.col("grp").alias("d_grp"), F.col("block").alias("d_block")).distinct()
    q_blocks = asked.select(F.col("grp").alias("q_grp"), F.col("block").alias("q_block")).distinct()
    home = q_blocks.join(d_blocks.filter("d_block = 0"), F.col("q_grp") == F.col("d_grp"))
    schema = "row long, id long, v array<double>, grp long, block long, least long, reach double"
    first = materialize(V.in_pairs(asked.select("row", "id", "v", "grp", "block", F.lit(None).cast("long").alias("least")), placed.select("row", "id", "v", "grp", "block"), home, _searched(k), FOUND), "cover-first")

    kth = V.best(first, [F.desc("score")], k).filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("least"))
    asked = materialize(asked.join(kth, "row", "left").selectExpr(*(c.split()[0] for c in schema.split(", "))), "cover-queries")
    pairs = q_blocks.join(_allowed(spark, placed, asked, centres.value), "q_grp").join(d_blocks, "d_grp").filter("q_grp <> d_grp or d_block <> 0")
    second = V.in_pairs(asked.drop("reach"), placed.select("row", "id", "v", "grp", "block"), pairs.select("q_grp", "q_block", "d_grp", "d_block"), _searched(k), FOUND)
    return V.best(first.unionByName(second), [F.desc("score")], k).drop("query_row")


def _allowed(spark, placed: DataFrame, asked: DataFrame, centres: np.ndarray) -> DataFrame:
    """(q_grp, d_grp) whose bound reaches the worst kth score; at most CENTRES squared rows. Queries lie in a net of their own, so their reach isn't that of the rows."""
    reach = {r.grp: r.reach for r in placed.groupBy("grp").agg(F.max("reach").alias("reach")).collect()}
    worst = {r.grp: (r.worst, r.reach) for r in asked.groupBy("grp").agg(F.min(F.coalesce("least", F.lit(_NONE))).alias("worst"), F.max("reach").alias("reach")).collect()}
    norms, out = np.linalg.norm(centres, axis=1), []
    for q, (least, own) in worst.items():
        for d, radius in reach.items():
            bound = centres[q] @ centres[d] + own * norms[d] + radius * norms[q] + own * radius
            if bound + 1e-6 * (1 + abs(bound)) >= least:
                out.append((q, d))
    return spark.createDataFrame(out, "q_grp long, d_grp long")
