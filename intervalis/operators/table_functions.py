"""Folds as table functions, for SQL: the schema, the partitioning and the order come from the analysed table.

    SELECT * FROM change_points(TABLE(frames))
    SELECT * FROM consolidated_segments(TABLE(segments), 1.5)

A call reads one video after another in order and keeps the fold's state only,
so a video's length doesn't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, arrow_udtf, udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from intervalis.operators.consolidation import ArrowConsolidation
from intervalis.operators.intervals import Consolidation
from intervalis.operators.timeseries import CHANGE_SCORE, MIN_ROWS


def _needs(table: AnalyzeArgument, *columns: str) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(name)")
    missing = [c for c in columns if c not in table.dataType.names]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return table.dataType


def _constant(argument: AnalyzeArgument, name: str) -> float:
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} is a constant")
    return float(argument.value)


class ChangePoints:
    """Segments of each video's frames between change points; the optional second argument is the score that makes one."""

    def __init__(self):
        self.video, self.row, self.n = None, -1, 0
        self.threshold = CHANGE_SCORE

    @staticmethod
    def analyze(frames: AnalyzeArgument, threshold: AnalyzeArgument | None = None) -> AnalyzeResult:
        table = _needs(frames, "video_id", "frame_idx", "timestamp", "motion_magnitude", "motion_direction", "brightness")
        if threshold is not None:
            _constant(threshold, "threshold")
        fields = [StructField("video_id", table["video_id"].dataType), StructField("first_row", LongType()), StructField("last_row", LongType()), StructField("start_time", DoubleType()), StructField("end_time", DoubleType()), StructField("n_rows", IntegerType())]
        return AnalyzeResult(StructType(fields), partitionBy=[PartitioningColumn("video_id")], orderBy=[OrderingColumn("timestamp"), OrderingColumn("frame_idx")])

    def eval(self, frames: Row, threshold: float | None = None) -> Iterator[tuple]:
        self.threshold = CHANGE_SCORE if threshold is None else float(threshold)
        at = frames["timestamp"]
        now = (frames["motion_magnitude"] or 0.0, frames["motion_direction"] or 0.0, 0.5 if frames["brightness"] is None else frames["brightness"])
        self.row += 1
        if self.row == 0:
            self.video, self.first, self.start, self.sums = frames["video_id"], 0, at, (0.0, 0.0, 0.0)
        far = False
        if self.n and self.n + 1 >= MIN_ROWS:
            m, d, b = (s / self.n for s in self.sums)
            far = 0.4 * abs(now[0] - m) / (m + 0.1) + 0.4 * abs(now[1] - d) / (math.pi + 0.1) + 0.2 * abs(now[2] - b) > self.threshold
        self.n, self.sums, self.last = self.n + 1, tuple(s + x for s, x in zip(self.sums, now, strict=True)), at
        if far:
            yield self.video, self.first, self.row, self.start, at, self.n
            self.first, self.start, self.n, self.sums = self.row, at, 1, now

    def terminate(self) -> Iterator[tuple]:
        if self.n >= MIN_ROWS:
            yield self.video, self.first, self.row, self.start, self.last, self.n


class ConsolidatedSegments:
    """Each video's segments with similar neighbours merged and short ones joined; the optional second argument is what is short, in seconds.

    The result has the table's columns and merged_count.
    """

    def __init__(self, analysis: AnalyzeResult):
        self.columns, self.fold = analysis.schema.names, None

    @staticmethod
    def analyze(segments: AnalyzeArgument, micro: AnalyzeArgument | None = None) -> AnalyzeResult:
        table = _needs(segments, "video_id", "index", "start_time", "end_time", "duration", "score", "tier", "shot_type")
        if micro is not None:
            _constant(micro, "micro")
        fields = [f for f in table.fields if f.name != "merged_count"] + [StructField("merged_count", LongType())]
        return AnalyzeResult(StructType(fields), partitionBy=[PartitioningColumn("video_id")], orderBy=[OrderingColumn("start_time"), OrderingColumn("index")])

    def _rows(self, done: list[dict]) -> Iterator[tuple]:
        for row in done:
            yield tuple(row[c] for c in self.columns)

    def eval(self, segments: Row, micro: float | None = None) -> Iterator[tuple]:
        if self.fold is None:
            self.fold = Consolidation(2.0 if micro is None else float(micro))
        yield from self._rows(self.fold.push(segments.asDict(recursive=True)))

    def terminate(self) -> Iterator[tuple]:
        if self.fold is not None:
            yield from self._rows(self.fold.finish())


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("change_points", udtf(ChangePoints))
    spark.udtf.register("consolidated_segments", udtf(ConsolidatedSegments))


#: Blocks of videos that the Arrow function is called for: a call must have many rows, and a task several blocks.
BLOCKS = 2048


def register_consolidation(spark: SparkSession, name: str, schema: StructType) -> str:
    """Makes ``consolidated_segments`` for tables of one schema known to SQL, over Arrow batches; returns the clauses that follow TABLE(...).

    An Arrow table function cannot analyse its argument, so its schema is given, and the call says how rows are
    dealt: whole blocks of videos, each in order. Two arguments: the table and what is short, in seconds.
    """
    names = [f.name for f in schema if f.name != "merged_count"] + ["merged_count"]
    fields = [schema[n] if n != "merged_count" else StructField(n, LongType()) for n in names]

    class ConsolidatedBlocks:
        def __init__(self):
            self.fold = None

        def _tables(self, done: list[pa.RecordBatch]) -> Iterator[pa.Table]:
            for batch in done:
                yield pa.Table.from_batches([batch]).select(names)

        def eval(self, segments: pa.RecordBatch, micro: pa.Array) -> Iterator[pa.Table]:
            if self.fold is None:
                self.fold = ArrowConsolidation(micro[0].as_py())
            yield from self._tables(self.fold.push(segments))

        def terminate(self) -> Iterator[pa.Table]:
            if self.fold is not None:
                yield from self._tables(self.fold.finish())

    spark.udtf.register(name, arrow_udtf(ConsolidatedBlocks, returnType=StructType(fields)))
    return f"PARTITION BY pmod(xxhash64(video_id), {BLOCKS}) ORDER BY (video_id, start_time NULLS LAST, index NULLS LAST)"
