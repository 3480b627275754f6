"""Harmonic packing of token ids into sequences of a power-of-two capacity.

Lengths are put in reciprocal-capacity classes: class j holds pieces of more
than capacity / (j + 1) and at most capacity / j ids, and a bin takes j of
them, whatever they are; the last class takes all shorter ones. A document is
cut into whole sequences, then into pieces of exactly a half, a quarter, ... of
the capacity down to TAIL ids, whose bins are full to the last id, and one tail
below TAIL, whose class is 1 / 17 or shorter: its bins waste little, and a
document has few pieces. Every worker fills the bins of its own split, without
a shuffle, and holds one open bin a class. At its end the open bins of exact
fractions are split into bins of 2^t pieces (sequences of a power-of-two length
need no padding), and the tails left over fill bins one after the other.

A document's longest pieces come first. Null text is an empty document (its
closing id alone); repeated rows are packed each; a null id is kept; texts the
fast encoder refuses (very long runs of blanks) take the tokenizer file's own;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalis.llm._batches import bound_batches, tidy

CAPACITY = 2048
END_ID = 1
#: Shorter rests of a document are not cut on; they are a sixteenth of the capacity at most.
TAIL = 128
#: The last class takes all shorter pieces.
LAST_CLASS = 256
#: The published split pattern of this family of byte-level BPE vocabularies.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_PROBE = "It's\n\n  a probe: été, 12345 naïve-words 東京!?\n don't   end \U0001f600 "


def shown_bytes() -> dict[str, int]:
    """The byte behind each printable character of a byte-level vocabulary's file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def _ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Byte strings of a byte-level vocabulary."""
    byte_of = shown_bytes()
    return {bytes(byte_of[c] for c in word): i for word, i in vocabulary.items() if all(c in byte_of for c in word)}


class Encoder:
    """Byte-level BPE ids of whole texts, as the tokenizer file gives them.

    Where the file's vocabulary is one of plain ranks, a faster library encodes
    with these ranks (checked on a probe); texts that hold the string of a
    special token, and other vocabularies, take the file's own rules.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        try:
            words = {w: i for w, i in self.whole.get_vocab(with_added_tokens=False).items() if w not in self.special}
            fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=_ranks(words), special_tokens={})
            if fast.encode_ordinary(_PROBE) == self.whole.encode(_PROBE, add_special_tokens=False).ids:
                self.fast = fast
        except (ValueError, KeyError):  # not a vocabulary of plain ranks
            pass

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its pattern gives up on some texts
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of n ids: capacities, falling powers of two, and a tail."""
    least = min(TAIL, capacity // 16)
    halves = [1 << b for b in range(capacity.bit_length() - 2, -1, -1) if n >> b & 1 and 1 << b >= least]
    rest = n % capacity - sum(halves)
    return [capacity] * (n // capacity) + halves + [rest] * (rest > 0)


class Bins:
    """The bins of one worker; numbers begin at ``first``. A piece is (length, row)."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.next, self.capacity = first, capacity
        self.open: dict[int, list[tuple[int, tuple]]] = {}

    def _placed(self, pieces: list[tuple[int, tuple]]) -> Iterator[tuple[tuple, int, int]]:
        """The rows of one bin with its number and their offsets."""
        at = 0
        for size, row in pieces:
            yield row, self.next, at
            at += size
        self.next += 1

    def add(self, size: int, row: tuple) -> Iterator[tuple[tuple, int, int]]:
        """What is placed as a class gets another piece: the pieces of its bin if that is full now."""
        kind = min(self.capacity // size, LAST_CLASS)
        pieces = self.open.setdefault(kind, [])
        pieces.append((size, row))
        if len(pieces) == kind:
            yield from self._placed(self.open.pop(kind))

    def rest(self) -> Iterator[tuple[tuple, int, int]]:
        """The pieces of all open bins: exact fractions in bins of 2^t pieces, tails one after the other."""
        tails: list[tuple[int, tuple]] = []
        for _, pieces in sorted(self.open.items()):
            if any(size & (size - 1) or size != pieces[0][0] for size, _ in pieces):
                tails += pieces
                continue
            for b in range(len(pieces).bit_length() - 1, -1, -1):
                if len(pieces) >> b & 1:
                    yield from self._placed(pieces[: 1 << b])
                    pieces = pieces[1 << b :]
        self.open = {}
        filled, room = [], self.capacity
        for size, row in tails:
            if size > room:
                yield from self._placed(filled)
                filled, room = [], self.capacity
            filled.append((size, row))
            room -= size
        if filled:
            yield from self._placed(filled)


_SCHEMA = ["start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long"]


def _packed(path: str, capacity: int, id_type: pa.DataType, with_ids: bool):
    schema = pa.schema([("id", id_type), *((c.split()[0], pa.int64()) for c in _SCHEMA), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = Encoder(path), Bins(TaskContext.get().partitionId() << 36, capacity)

        def final(row: tuple, number: int, offset: int) -> tuple:
            return (*row[:5], number, offset, *row[5:])

        for batch in batches:
            ready: list[tuple] = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encoder.encode(text or ""), np.uint32(END_ID)).astype("<u4")
                start = 0
                for size in cut(len(ids), capacity):
                    part = ids[start : start + size]
                    row = (doc, start, size, zlib.crc32(part.tobytes()), len(ids), *([part.view("<i4")] if with_ids else []))
                    ready += [final(*x) for x in bins.add(size, row)]
                    start += size
            yield table(ready)
        yield table([final(*x) for x in bins.rest()])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves if ``with_ids``.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library, present on every worker.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    from pyspark.sql.pandas.types import to_arrow_type

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(tidy(_packed(tokenizer, capacity, to_arrow_type(rows.schema["id"].dataType), with_ids)), f"id {kind}, {', '.join(_SCHEMA)}" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)
