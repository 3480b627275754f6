"""Places and pages in an order that no task holds whole.

Rows are dealt into ranges of the order (Spark samples the cuts), so that equal
shares of a table, or of one key's rows, are sorted in different tasks; a row's
place is its place in its range and the number of rows in the ranges before it.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervalis.operators import search
from intervalis.plans.scratch import TASK_ROWS, materialize, shared_folder

#: Rows of a range, at about.
RANGE_ROWS = 1 << 20


def _ranges(rows: DataFrame, most: int | None) -> int:
    """As many ranges as there are shuffle partitions; more where a range would have over RANGE_ROWS rows."""
    return most or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "place", ranges: int | None = None) -> DataFrame:
    """``df`` with each row's place (from 1) among the rows of its keys; a key of any size is many ranges.

    ``order`` should leave no ties; rows that tie on it are in any order, as with row_number. Null keys are
    a key of their own.
    """
    rows = materialize(df, "ranked-rows")
    dealt = rows.repartitionByRange(_ranges(rows, ranges), *keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranked-ranges")
    near = dealt.withColumn("_near", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    per_range = dealt.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = per_range.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return near.join(before, same).select(*df.columns, (F.col("_near") + F.col("_before")).cast("long").alias(name))


def _begins(column: pa.Array, last: object) -> np.ndarray:
    """Where a sorted column's value differs from the one before, nulls alike; ``last`` is the value before the first."""
    known = pa.concat_arrays([pa.array([last], column.type), column])
    differs, missing = pc.not_equal(known[1:], known[:-1]), pc.is_null(known).to_numpy(zero_copy_only=False)
    return np.where(missing[1:] | missing[:-1], missing[1:] != missing[:-1], pc.fill_null(differs, False).to_numpy(zero_copy_only=False))


def _along(keys: Sequence[str], amount: str, schema: pa.Schema):
    """Adds each row's place and the sum of the amounts before it, among the rows of its keys in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, total = None, 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = pc.fill_null(batch.column(amount).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            new = np.zeros(batch.num_rows, bool)
            for i, k in enumerate(keys):
                new |= _begins(batch.column(k), None if last is None else last[i])
            new[0] |= last is None
            place, before = np.empty(len(values), np.int64), np.empty(len(values))
            cuts = np.unique(np.concatenate(([0], np.flatnonzero(new), [len(values)])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if new[a]:
                    n, total = 0, 0.0
                sums = np.add.accumulate(np.concatenate(([total], values[a:b])))
                place[a:b], before[a:b] = np.arange(n + 1, n + 1 + b - a), sums[:-1]
                n, total = n + b - a, float(sums[-1])
            last = [batch.column(k)[-1].as_py() for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(before)], schema=schema)

    return run


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], amount: str, place: str = "place", before: str = "before", ranges: int | None = None) -> DataFrame:
    """``df`` with each row's place (from 1) and the sum of ``amount`` over the rows before it, among the rows of its keys.

    A key of any size is many ranges; a range's rows are added in their order, and the sums of the ranges before
    are added to them. ``order`` should leave no ties; null amounts count as 0.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    if ranges is None:
        n = df.count()
        ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * n // TASK_ROWS), -(-n // TASK_ROWS))
    sorted_ = df.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_range", F.spark_partition_id())
    near = spark.createDataFrame([], sorted_.schema).withColumns({place: F.lit(0).cast("long"), before: F.lit(0.0)}).schema
    rows = materialize(sorted_.mapInArrow(_along(keys, amount, to_arrow_schema(near)), near), "running-rows", compression="zstd")
    per_range = rows.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(F.col(amount).cast("double"), F.lit(0.0))).alias("_sum"))
    along = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    left = per_range.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.sum("_n").over(along).alias("_earlier"), F.sum("_sum").over(along).alias("_sums")).filter("_earlier > 0")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(F.broadcast(left), same, "left")  # what goes on from a range before: one key a range, so as few rows as ranges
    return out.select(*df.columns, (F.col(place) + F.coalesce("_earlier", F.lit(0))).alias(place), (F.col(before) + F.coalesce("_sums", F.lit(0.0))).alias(before))


class PageIndex:
    """The matches of a query, written once by ranges of its order; a page reads the ranges it lies in, however deep it is.

    Written are the query's columns and what it is ordered by, not whole rows.
    """

    def __init__(self, df: DataFrame, query: search.Query, tie: str = "index", ranges: int | None = None):
        self.query, self.spark = query, df.sparkSession
        self.columns = search.project(df, query.include, query.exclude).columns
        by = search.sort_values(df.schema, query.sort_by, query.descending, tie)
        found = search.matching(df, query).select(*self.columns, *(value.alias(f"_by{i}") for i, (value, _) in enumerate(by)))
        self.order = [F.desc_nulls_first(f"_by{i}") if down else F.asc_nulls_last(f"_by{i}") for i, (_, down) in enumerate(by)]
        path = f"{shared_folder(self.spark)}/pages-{uuid.uuid4().hex}"
        dealt = found.repartitionByRange(_ranges(found, ranges), *self.order) if self.order else found
        dealt.withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
        self.rows = self.spark.read.schema(f"{_ddl(found)}, `_range` int").parquet(path)
        counts = sorted((r["_range"], r["count"]) for r in self.rows.groupBy("_range").count().collect())  # a row for each range
        self.ranges = [k for k, _ in counts]
        self.starts = [0, *accumulate(n for _, n in counts)]

    @property
    def found(self) -> int:
        return self.starts[-1]

    def page(self, number: int) -> DataFrame:
        """The wanted page, in order, with the query's columns."""
        size = self.query.page_size
        low = (number - 1) * size
        high = min(low + size, self.found)
        if number < 1 or low >= high:
            inside, skipped = [], 0
        else:
            first, last = bisect_right(self.starts, low) - 1, bisect_right(self.starts, high - 1) - 1
            inside, skipped = self.ranges[first : last + 1], low - self.starts[first]
        return self.rows.filter(F.col("_range").isin(inside)).orderBy(*self.order).offset(skipped).limit(size).select(*self.columns)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
