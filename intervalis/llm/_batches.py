"""Text batches inside tasks: bounded chunks, word hashes and word runs, all in numpy.

Words are the maximal runs of bytes other than space and \\t to \\r, after
lower-casing A-Z; hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 21
_BLANKS = b" \t\n\x0b\x0c\r"


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep the Arrow batches that reach Python small: long texts come in few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, returning freed memory to the system at a task's end: later stages reuse the worker."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return tidied


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names for work columns that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def all_of(docs: DataFrame) -> Column:
    """A hash of all columns of a row but maps, which have no order."""
    return F.xxhash64(F.lit(0), *(F.col(f"`{name}`") for name, kind in docs.dtypes if "map<" not in kind))


def row_key(*columns: Column) -> Column:
    """128 bits that name a row's values, nulls too; never null itself."""
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("h"), F.xxhash64(F.lit(2), *columns).alias("l"))


@np.errstate(over="ignore")
def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection that spreads every bit."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values of a seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(_BLANKS)] = False
_BYTE_HASH = stream(1, 256)[_LOWER]
_BASE = np.uint64(0x5851F42D4C957F2D)
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 256), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and where each text's words begin (one entry more than texts)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = _IS_WORD[joined]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    first = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), first
    lengths = ends - starts
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    terms = _BYTE_HASH[joined[inside]] * _power_table(int(lengths.max()))[within]
    return mix(np.add.reduceat(terms, at) + lengths.astype(np.uint64)), first


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes each (one text at least)."""
    start = size = 0
    for k, text in enumerate(texts):
        n = len(text or b"") + 1
        if k > start and size + n > limit:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
