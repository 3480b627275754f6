"""Vectors in blocks: a stated query set against all rows, block by block.

Rows and queries are dealt into blocks of a bounded number of rows; a task
gets one block of each, as two Arrow tables. A group that holds a third of all
rows is many blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DATA_ROWS, QUERY_ROWS, SAMPLE_ROWS = 8192, 1024, 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """(row, id, v array<double>): rows with an id and a finite vector. ``row`` numbers them, for ids that repeat; it holds once the table is written."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0) if nonzero else F.lit(True)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & some).withColumn("row", F.monotonically_increasing_id())


def sample(rows: DataFrame) -> np.ndarray:
    """At most SAMPLE_ROWS vectors, the same in every run: those whose ids' hashes are least."""
    return matrix(pa.array([r.v for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE_ROWS).collect()], pa.list_(pa.float64())))


def matrix(lists: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """A matrix of list values; shorter vectors end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.asarray(lists.value_lengths().fill_null(0)) if len(lists) else np.zeros(0, dtype=np.int64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(lists.flatten(), dtype=np.float64)
    return out


def two_matrices(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    a, b = matrix(x["v"]), matrix(y["v"])
    width = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))), np.pad(b, ((0, 0), (0, width - b.shape[1])))


def dealt(rows: DataFrame, per_block: int) -> DataFrame:
    """``rows`` (with a grp) and the block of each: a group is cut into as many blocks as its size asks for."""
    cuts = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / per_block).alias("cuts"))
    return rows.join(cuts, "grp").withColumn("block", F.pmod(F.xxhash64("row", F.lit(9)), "cuts")).drop("cuts")


def in_pairs(queries: DataFrame, data: DataFrame, pairs: DataFrame, search: Callable, schema: str) -> DataFrame:
    """search(query table, data table) for each pair (q_grp, q_block, d_grp, d_block)."""
    keys = ["q_grp", "q_block", "d_grp", "d_block"]
    left = queries.withColumnsRenamed({"grp": "q_grp", "block": "q_block"}).join(pairs, ["q_grp", "q_block"])
    right = data.withColumnsRenamed({"grp": "d_grp", "block": "d_block"}).join(pairs, ["d_grp", "d_block"])
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(search, schema)


def best(found: DataFrame, order: list, k: int) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): the first k of each query row, ties to the smaller vec_id."""
    along = Window.partitionBy("query_row").orderBy(*order, "vec_id")
    return found.withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")
