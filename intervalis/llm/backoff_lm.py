"""LM scoring with a weighted backoff automaton.

Training tokens are words and one end per text. A state is an n-gram context
that occurs in training; its arc for a seen word carries the log10 of
(1 - fall) * c(context, word) / c(context) + fall * P(word | shorter context),
its failure arc carries log10(fall) and leads to the shorter context; the root
holds the additively smoothed unigrams. A text is traversed once, left to
right: the state is the longest seen suffix, and arcs taken are summed. The
probabilities of every state add up to one.

The counts cover the whole corpus and grow with it, so no task holds them all.
Texts are packed into blocks of a bounded number of words; a block asks for the
counts of its distinct n-grams from buckets that n-gram hashes spread evenly,
and gets them back in the order it asked. What is shuffled are compressed
arrays of distinct n-grams per block, not tokens. A block builds the states and
arcs that its texts can reach from these counts and traverses them side by side.

Null texts count as empty (one end token); repeated rows are scored, and
counted, each; a null id is a training row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalis.llm._batches import bound_batches, chunks, mix, text_bytes, word_hashes
from intervalis.plans.scratch import materialize

BLOCK_BYTES = 12 << 20
ADD = 0.1
#: Tokens of a text that are traversed side by side with the text's others.
SEGMENT = 512
_BEGIN, _END = mix(np.array([11, 13], dtype=np.uint64))
_SHIFT = np.uint64(32)


def pack(values: np.ndarray) -> bytes:
    """Compressed byte planes of an array of integers."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def _sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Begin, words and end of each text, one after the other, and where each text begins."""
    parts, sizes = [], []
    for a, b in chunks(texts):
        words, first = word_hashes(texts[a:b])
        n = np.diff(first)
        begins = np.concatenate(([0], np.cumsum(n + 2)))
        seq = np.empty(begins[-1], dtype=np.uint64)
        seq[begins[:-1]], seq[begins[1:] - 1] = _BEGIN, _END
        inner = np.ones(len(seq), dtype=bool)
        inner[begins[:-1]] = inner[begins[1:] - 1] = False
        seq[inner] = words
        parts.append(seq)
        sizes.append(n + 2)
    return np.concatenate(parts), np.concatenate(sizes)


def _blocks(id_type: pa.DataType, block_bytes: int) -> Callable:
    def close(ids: list, held: list, texts: list, number: int) -> pa.RecordBatch:
        seq, sizes = _sequence(texts)
        words, index, counts = np.unique(seq, return_inverse=True, return_counts=True)
        rank = np.empty(len(words), dtype=np.uint32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words), dtype=np.uint32)
        by_rank = np.empty_like(words)
        by_rank[rank] = words
        train = int((sizes - 1)[~np.array(held, dtype=bool)].sum())
        block = (TaskContext.get().partitionId() << 24) + number
        return pa.RecordBatch.from_arrays(
            [pa.array([x]) for x in (block, len(words), len(seq), train, int((~np.array(held, dtype=bool)).sum()), by_rank.tobytes(), pack(rank[index]))]
            + [pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes.tolist()], pa.list_(pa.int64()))],
            names=["block", "n_words", "n_seq", "train", "texts", "words", "tokens", "ids", "held", "sizes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size, number = [], [], [], 0, 0
        for batch in batches:
            for i, h, t in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), text_bytes(batch.column("text")), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield close(ids, held, texts, number)
                    ids, held, texts, size, number = [], [], [], 0, number + 1
        if ids:
            yield close(ids, held, texts, number)

    return run


def _grams(seq: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length k: hashes of the k-grams that end at each position, and where there is one. Begins are no unigrams."""
    place = np.arange(len(seq)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gram = seq
    yield gram, place > 0
    for k in range(2, order + 1):
        longer = np.zeros_like(gram)
        longer[1:] = mix(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + seq[1:] + np.uint64(k))
        gram = longer
        yield gram, place >= k - 1


def _load(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = np.frombuffer(row["words"], dtype=np.uint64)
    seq = words[unpack(row["tokens"], row["n_seq"], np.uint32)]
    sizes = np.array(row["sizes"], dtype=np.int64)
    return seq, sizes, np.repeat(~np.array(row["held"], dtype=bool), sizes)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's slice of sorted keys begins."""
    edges = ((np.arange(1, buckets, dtype=np.uint64) << _SHIFT) + np.uint64(buckets - 1)) // np.uint64(buckets)
    return np.concatenate(([0], np.searchsorted(keys >> _SHIFT, edges), [len(keys)]))


def _asked(buckets: int, order: int):
    """A block's distinct n-grams and their counts in its own training texts, a row for each bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("gram", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seq, sizes, train = _load(row)
                for k, (gram, there) in enumerate(_grams(seq, sizes, order), 1):
                    keys, index = np.unique(gram[there], return_inverse=True)
                    counts = np.bincount(index[train[there]], minlength=len(keys)).astype(np.uint32)
                    cuts = _cuts(keys, buckets)
                    deltas = np.diff(keys, prepend=np.uint64(0))
                    out = []
                    for b in range(buckets):
                        s, e = int(cuts[b]), int(cuts[b + 1])
                        if s < e:
                            own = deltas[s:e].copy()
                            own[0] = keys[s]
                            out.append((b, k, row["block"], e - s, pack(own), pack(counts[s:e])))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _answered(rows: pa.Table) -> pa.Table:
    """The corpus counts of what each block asked of a bucket; new: the distinct training n-grams here, on the first row."""
    rows = rows.to_pylist()
    keys = [np.cumsum(unpack(r["keys"], r["n"], np.uint64), dtype=np.uint64) for r in rows]
    counts = np.concatenate([unpack(r["counts"], r["n"], np.uint32) for r in rows])
    every, index = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(every), dtype=np.uint64)
    np.add.at(total, index, counts.astype(np.uint64))  # exact beyond 2^53
    found = np.split(total[index], np.cumsum([r["n"] for r in rows])[:-1])
    return pa.table({
        "block": pa.array([r["block"] for r in rows], pa.int64()), "gram": pa.array([r["gram"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int64()),
        "n": pa.array([r["n"] for r in rows], pa.int64()), "totals": pa.array([pack(x) for x in found], pa.binary()),
        "new": pa.array([int((total > 0).sum())] + [0] * (len(rows) - 1), pa.int64()),
    })


class Automaton:
    """States, arcs and failure arcs for the texts of a block; state 0 is the root.

    ``grams`` and ``totals``: for each length, the hashes of the n-grams that end
    at each position, where there is one, and their corpus counts.
    """

    def __init__(self, seq: np.ndarray, sizes: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], fall: float, tokens: int, vocabulary: int, texts: int):
        starts = np.cumsum(sizes) - sizes
        _, first, self.word = np.unique(seq, return_index=True, return_inverse=True)
        self.words, self.seq_starts, self.sizes, self.fall = len(first), starts, sizes, float(np.log10(fall))
        counts = levels[0][2].astype(np.float64)
        chance = (counts + ADD) / (tokens + ADD * (vocabulary + 1))
        self.base, self.known = np.log10(chance), counts > 0
        counts = np.where(levels[0][1], counts, texts)  # a begin is a context as often as there are texts
        self.root_weight = self.base[first]
        fails, state, keys, weights, targets = [np.zeros(1, np.int64)], np.zeros(len(seq), np.int64), [], [], []
        made = 1
        for k, (gram, there, total) in enumerate(levels, 1):
            total = counts if k == 1 else total.astype(np.float64)
            seen = (total > 0) & (there if k > 1 else True)
            _, at, index = np.unique(gram[seen], return_index=True, return_inverse=True)
            at = np.flatnonzero(seen)[at]  # a position of each n-gram
            if k > 1:
                context = np.maximum(np.arange(len(seq)) - 1, 0)
                longer = seen & (below[context] > 0)
                arc = np.divide(total, counts_below[context], out=np.zeros(len(seq)), where=longer)
                has = there & (below[context] > 0) & (counts_below[context] > 0)
                chance = np.where(has, (1 - fall) * arc + fall * chance, chance)
                keys.append(below[at - 1] * self.words + self.word[at])
                weights.append(np.log10(chance[at]))
            if k < len(levels):  # the n-gram is a state; it fails to the one without its first word
                own = np.zeros(len(seq), np.int64)
                own[seen] = made + index
                fails.append(state[at])
                made += len(at)
                state = np.where(seen, own, state)
                below, counts_below = own, total
                if k == 1:
                    self.root_target = state[first]
            if k > 1:
                targets.append(state[at])
        if len(levels) == 1:
            self.root_target = np.zeros(self.words, np.int64)
        self.fail, self.state_at = np.concatenate(fails), state
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        order = np.argsort(key)
        self.keys = key[order]
        self.weight, self.target = (np.concatenate([np.zeros(0, kind), *v])[order] for kind, v in ((np.float64, weights), (np.int64, targets)))

    def scores(self) -> np.ndarray:
        """log10 probabilities of the texts, traversed left to right, side by side; each carries its state.

        A state depends on the last words only, so a long text is traversed in segments, each from the state before it.
        """
        segments = np.maximum(1, -(-(self.sizes - 1) // SEGMENT))
        text = np.repeat(np.arange(len(self.sizes)), segments)
        place = (np.arange(len(text)) - np.repeat(np.cumsum(segments) - segments, segments)) * SEGMENT
        steps = np.minimum(SEGMENT, self.sizes[text] - 1 - place) + 1
        longest = np.argsort(-steps, kind="stable")
        text, steps, starts = text[longest], steps[longest], (self.seq_starts[text] + place)[longest]
        score, state = np.zeros(len(text)), self.state_at[starts]
        still = len(steps) - np.searchsorted(steps[::-1], np.arange(steps.max(initial=1)), side="right")
        for t in range(1, len(still)):
            n = still[t]
            word, now = self.word[starts[:n] + t], state[:n]
            waiting = np.arange(n)
            while len(waiting):
                at_root = now[waiting] == 0
                done = waiting[at_root]
                score[done] += self.root_weight[word[done]]
                state[done] = self.root_target[word[done]]
                waiting = waiting[~at_root]
                if not len(waiting):
                    break
                key = now[waiting] * self.words + word[waiting]
                at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
                hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
                done, at = waiting[hit], at[hit]
                score[done] += self.weight[at]
                waiting = waiting[~hit]
                score[waiting] += self.fall
                moved = self.fail[now[waiting]]
                state[done] = self.target[at]
                now[waiting] = moved
        return np.bincount(text, weights=score, minlength=len(self.sizes))


def _scored(id_type: pa.DataType, order: int, fall: float, tokens: int, vocabulary: int, texts: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("ids", "held", "n_tokens", "n_known", "base", "score")}
        replies = sorted(answers.to_pylist(), key=lambda r: (r["gram"], r["bucket"]))
        for row in blocks.to_pylist():
            seq, sizes, _ = _load(row)
            levels = []
            for k, (gram, there) in enumerate(_grams(seq, sizes, order), 1):
                total = np.concatenate([np.zeros(0, np.uint64), *(unpack(r["totals"], r["n"], np.uint64) for r in replies if r["gram"] == k)])
                _, index = np.unique(gram[there], return_inverse=True)
                seen = np.zeros(len(seq), np.uint64)
                seen[there] = total[index]
                levels.append((gram, there, seen))
            machine = Automaton(seq, sizes, levels, fall, tokens, vocabulary, texts)
            starts = np.cumsum(sizes) - sizes
            token = np.ones(len(seq))
            token[starts] = 0
            out["ids"] += row["ids"]
            out["held"] += row["held"]
            out["n_tokens"] += (sizes - 1).tolist()
            out["n_known"] += np.add.reduceat(machine.known * token, starts).tolist()
            out["base"] += np.add.reduceat(machine.base * token, starts).tolist()
            out["score"] += machine.scores().tolist()
        n = len(out["ids"])
        return pa.table({
            "id": pa.array(out["ids"], id_type), "held_out": pa.array(out["held"], pa.bool_()), "n_tokens": pa.array(out["n_tokens"], pa.int64()),
            "n_known": pa.array([int(x) for x in out["n_known"]], pa.int64()), "train_tokens": pa.array([tokens] * n, pa.int64()),
            "base_score": pa.array(out["base"], pa.float64()), "score": pa.array(out["score"], pa.float64()),
        })

    return run


def score_texts(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, fall: float = 0.4, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``held_out`` is false or null. base_score sums
    the root's unigrams alone; score is the automaton's log10 probability.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    kind, id_type = dict(rows.dtypes)["id"], _arrow_type(rows)
    blocks = materialize(
        rows.mapInArrow(_blocks(id_type, block_bytes), f"block long, n_words long, n_seq long, train long, texts long, words binary, tokens binary, ids array<{kind}>, held array<boolean>, sizes array<long>"),
        "lm-blocks",
    )
    n, tokens, texts = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("train"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    asked = blocks.mapInArrow(_asked(max(1, n), order), "bucket long, gram long, block long, n long, keys binary, counts binary")
    answers = materialize(asked.groupBy("bucket", "gram").applyInArrow(_answered, "block long, gram long, bucket long, n long, totals binary, new long"), "lm-answers")
    vocabulary = answers.filter("gram = 1").agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0]
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scored(id_type, order, fall, tokens, vocabulary, texts), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.withColumnRenamed("id", id_col)


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["id"].dataType)
