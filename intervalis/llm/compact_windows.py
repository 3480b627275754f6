"""Substring dedup with compact windows.

A text is the sequence of its 5-word shingles. Two passages of at least 50
words with a Jaccard similarity of 0.8 share a run of at least 25 words
(``core_shingles``): the gaps between shared runs cost eight shingles each, of
which there are few. All subsequences of 25 words are grouped by the min-hash
of their grams of 14 words: the Cartesian tree over a text's gram hashes gives
compact windows (left, centre, right), and every subsequence within a window
that holds its centre has the centre's gram as signature. Subsequences that are
equal have equal signatures, so one hash function finds every shared run;
windows of different texts with one signature are joined at their centres.

Each window also carries a hash bit of each of the 32 shingles before and after
its centre. The bits that agree bound the run that two windows share, and only
joins that leave room for 25 words go on. Within a signature, a window meets
the ones nearest to what most agree on, and those before it in the orders of what follows and of what
goes before the centre if they share more; so a group of copies costs a few
pairs for each member. Windows that lie in different classes of spans after that, or in none, are
paired in full in blocks, verified and classed again. Up to HEADS windows of a signature have all met before. A
stretch of one word is one shingle of a passage of several runs, which has other windows too: at its edges only
runs that are a passage alone are paired. A task joins its own windows first and
hands on one of those whose bits show one passage, so a passage in a third of
all texts arrives at its key once a task.

A candidate pair of texts is verified exactly: matches are extended from the
centres along their diagonals and on across gaps, close ones are joined, and a
passage counts if both sides have the least number of words and the Jaccard
similarity of their shingles is at least 0.8. All pairs of a block are extended
together, in numpy.

Texts that are equal word for word are one node. Null texts and texts below the
least length hold no passage; a passage repeated within one text only isn't
reported; equal spans, and spans that overlap, are one; repeated rows are
documents; columns other than the id and the text are not looked at; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervalis.llm._batches import _power_table, bound_batches, chunks, mix, stream, text_bytes, tidy, word_hashes
from intervalis.llm.parity_join import BLOOM_WORDS, WORDS, _COEFFICIENTS
from intervalis.operators.graph import connected_components
from intervalis.plans.scratch import materialize

LEAST_WORDS = 50
SIMILAR = 0.8
GRAM_WORDS = 14
#: Shingles on each side of a centre that a window has a bit of.
SIDE = 32
#: Bits that must agree beyond a passage's least length, as a bit agrees by chance too.
SPARE = 8
#: Matches at most so many shingles apart may be one passage.
JOIN_GAP = 24
#: Middle windows of a signature that a window meets: the first one, and the others if it isn't surely similar to that.
HEADS = 3
#: Windows that a task joins at a time, and pairs of texts that one task verifies at a time.
JOIN_ROWS, BLOCK_PAIRS = 1 << 20, 2048
#: Windows of a signature that are paired in full in one block, and pairs that are compared at a time.
BLOCK_WINDOWS, COMPARED = 1024, 1 << 21
_POSITION_BITS = 26
#: The bit of a key that tells windows at the edges of stretches of one word.
EDGE = np.uint64(2)
_SCATTER = 0x2C1B3C7  # odd: equal hashes are ordered by scattered positions, so that repetition makes no deep tree
_UNSCATTER = pow(_SCATTER, -1, 1 << _POSITION_BITS)


def core_shingles(least: int) -> int:
    """Shingles of the longest run that two similar passages of at least ``least`` shingles share.

    Their union has 2 least / 1.8 shingles or more, of which 0.8 are shared;
    g gaps between runs need 8 g that aren't.
    """
    union = 2 * least / (1 + SIMILAR)
    return min(math.ceil(SIMILAR * max(union, 8 * g / (1 - SIMILAR)) / (g + 1)) for g in range(least))


def sequences(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The shingle hashes of each text, in order."""
    for a, b in chunks(texts):
        words, first = word_hashes([t or b"" for t in texts[a:b]])
        full = mix(sum((words[k : len(words) - WORDS + 1 + k] * _COEFFICIENTS[k] for k in range(WORDS)), np.uint64(WORDS))) if len(words) >= WORDS else words[:0]
        for s, e in zip(first[:-1], first[1:], strict=True):
            yield full[s : max(s, e - WORDS + 1)]


def name_of(sequence: np.ndarray) -> int:
    place = np.arange(1, len(sequence) + 1, dtype=np.uint64)
    return int(mix(np.add.reduce(mix(sequence + place * np.uint64(0x9E3779B97F4A7C15))) + np.uint64(len(sequence))).astype(np.int64))


def compact_windows(hashes: np.ndarray, least: int, begins: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """(left, centre, right) of the nodes of the Cartesian trees that are at least ``least`` wide, level by level.

    ``hashes`` holds one sequence, or those from ``begins`` to ``ends``.
    """
    left = np.zeros(1, dtype=np.int64) if begins is None else np.asarray(begins, dtype=np.int64)
    end = np.full(1, len(hashes), dtype=np.int64) if ends is None else np.asarray(ends, dtype=np.int64)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    place = np.arange(len(hashes), dtype=np.uint64) * np.uint64(_SCATTER) & low
    ranked = (np.asarray(hashes, dtype=np.uint64) & ~low) | place if len(hashes) <= int(low) else None
    if ranked is None:
        raise ValueError("a batch of texts is too long")
    out = []
    while True:
        wide = end - left >= least
        left, end = left[wide], end[wide]
        if not len(left):
            break
        widths = end - left
        at = np.cumsum(widths) - widths
        inside = np.arange(int(widths.sum())) + np.repeat(left - at, widths)
        least_of = np.minimum.reduceat(ranked[inside], at)
        centre = ((least_of & low) * np.uint64(_UNSCATTER) & low).astype(np.int64)
        out.append(np.stack([left, centre, end - 1], axis=1))
        left, end = np.stack([left, centre + 1], axis=1).ravel(), np.stack([centre, end], axis=1).ravel()
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def _bits_ahead(bits: np.ndarray) -> np.ndarray:
    """For each place the SIDE bits from it on, the first one the highest."""
    out, have = bits.astype(np.uint64), 1
    while have < SIDE:
        ahead = np.zeros_like(out)
        ahead[:-have] = out[have:]
        out, have = (out << np.uint64(have)) | ahead, 2 * have
    return out


def signatures(found: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, centres, text numbers and contexts of the compact windows of the texts' grams.

    A stretch of one word has windows of odd keys, and two of even keys of their own (EDGE), at its first and its last gram:
    two stretches share no longer run, nor one that goes beyond both, than where their beginnings or their ends meet.
    The context of these begins beyond ``edge_shingles``.
    """
    core = core_shingles(least)
    gram = max(1, min(GRAM_WORDS - WORDS + 1, core - 2))  # in shingles
    long = np.array([k for k, s in enumerate(found) if len(s) >= least], dtype=np.int64)
    if not len(long):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), long, np.zeros(0, np.uint64)
    sizes = np.array([len(found[k]) for k in long])
    joined, begins = np.concatenate([found[k] for k in long]), np.cumsum(sizes) - sizes
    offsets = sorted({*range(0, gram, WORDS), gram - 1})  # these shingles hold all words of the gram
    content = mix(sum((joined[o : len(joined) - gram + 1 + o] * c for o, c in zip(offsets, _COEFFICIENTS, strict=False)), np.uint64(gram)))
    centre = compact_windows(mix(content), core - gram + 1, begins, begins + sizes - gram + 1)[:, 1]
    turns = np.flatnonzero(np.append(True, joined[1:] != joined[:-1]))
    turns = np.append(np.union1d(turns, begins), len(joined))
    stretch = np.searchsorted(turns, centre, side="right") - 1
    even = turns[stretch + 1] - centre >= gram
    keys = (content[centre] & ~(EDGE | np.uint64(1))) | even.astype(np.uint64)
    first, last = (np.unique(v[even]) for v in (turns[stretch], turns[stretch + 1] - gram))
    edges = [mix(content[v] + np.uint64(k)) & ~np.uint64(1) | EDGE for k, v in enumerate((first, last), 1)]
    between, more = first[1:] - last[:-1] - gram, edge_shingles(least, gram) - gram
    of_text = np.searchsorted(begins, first, side="right")
    apart, loose = np.flatnonzero((between > gram) & (between < least + SIDE) & (of_text[1:] == of_text[:-1])), np.zeros(len(first), bool)
    loose[apart] = loose[apart + 1] = True  # runs of one stretch and few words on its sides may be a passage together
    weak = [mix(content[v[loose]] + np.uint64(k)) & ~(EDGE | np.uint64(1)) for k, v in enumerate((first, last), 3)]
    extra, before = (np.repeat([0, more * a, more * b, 0], [len(centre), len(first), len(last), 2 * loose.sum()]) for a, b in ((1, 0), (0, 1)))
    keys, centre = np.concatenate([keys, *edges, *weak]), np.concatenate([centre, first, last, first[loose], last[loose]])
    owner = np.searchsorted(begins, centre, side="right") - 1
    bits = joined >> np.uint64(63)
    none = np.zeros(gram + least, np.uint64)
    ahead = np.append(_bits_ahead(bits), none)[centre + gram + extra]
    behind = np.append(_bits_ahead(bits[::-1]), none)[len(joined) - centre + before]
    return keys, centre - begins[owner], long[owner], (behind << np.uint64(SIDE)) | ahead


def edge_shingles(least: int, gram: int) -> int:
    """Shingles of a stretch that the contexts of its edge windows leave out, so that they reach as far as ``least`` shingles."""
    return max(gram, least - SIDE)


def shared_words(x: np.ndarray, y: np.ndarray, gram_words: int) -> np.ndarray:
    """At least the words of the run around two windows' centres, for runs that end within their contexts."""
    apart, low = x ^ y, np.uint64((1 << SIDE) - 1)
    return _leading(apart >> np.uint64(SIDE)) + gram_words + _leading(apart & low)


def _leading(bits: np.ndarray) -> np.ndarray:
    """How many of SIDE bits are 0 before the first 1."""
    return SIDE - np.frexp(bits.astype(np.float64))[1]


def surely_similar(x: np.ndarray, y: np.ndarray, gram_words: int, least: int) -> np.ndarray:
    """Whether the contexts of two windows show a passage: ``least`` shingles around the centres, and SPARE more, with one changed word at most."""
    low = np.uint64((1 << SIDE) - 1)
    straight, jumped = [], []
    for apart in ((x ^ y) >> np.uint64(SIDE), (x ^ y) & low):
        run = _leading(apart)
        skip = np.minimum(run + WORDS, SIDE)  # a changed word is in so many shingles
        rest = (apart << skip.astype(np.uint64)) & low
        straight.append(run)
        jumped.append(np.minimum(skip + _leading(rest), SIDE))
    gram = gram_words - WORDS + 1
    one_gap = np.maximum(straight[0] + jumped[1], jumped[0] + straight[1])
    return np.maximum(one_gap, straight[0] + straight[1]) + gram >= least + SPARE


class Windows:
    """Rows of compact windows: signature, text, centre and context."""

    def __init__(self, sig: np.ndarray, fp: np.ndarray, at: np.ndarray, context: np.ndarray):
        self.sig, self.fp, self.at, self.context = sig, fp, at, context

    def __len__(self) -> int:
        return len(self.sig)

    def take(self, rows: np.ndarray) -> Windows:
        return Windows(self.sig[rows], self.fp[rows], self.at[rows], self.context[rows])

    @staticmethod
    def of(parts: list[Windows]) -> Windows:
        return Windows(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("sig", "fp", "at", "context")))

    def shared(self) -> tuple[Windows, np.ndarray]:
        """The rows whose signature others have too, in order, and the numbers of the rest."""
        order = np.argsort(self.sig)
        same = self.sig[order[1:]] == self.sig[order[:-1]]
        several = np.append(same, False) | np.insert(same, 0, False) if len(order) else np.zeros(0, bool)
        some = self.take(order[several])
        return some.take(np.lexsort((some.at, some.fp, some.sig))), order[~several]

    def room(self, rows: np.ndarray, others: np.ndarray, core_words: int, gram_words: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """At least the words that pairs of one signature share around their centres, and whether these leave room for a passage that is found here.

        A stretch of one word is one shingle to a passage of several runs, so such a passage has a run with other windows
        (or stretches near each other, which have windows of other keys): windows at an edge meet for a passage of one run.
        """
        edge = self.sig[rows] & EDGE != 0
        more = edge_shingles(least, gram_words - WORDS + 1) + WORDS - 1 - gram_words
        shared = shared_words(self.context[rows], self.context[others], gram_words) + np.where(edge, more, 0)
        return shared, shared >= np.where(edge, least + WORDS - 1, core_words)

    def _middle(self, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The HEADS rows of each signature whose contexts differ least from the bits that three quarters of its rows agree on: originals rather than changed copies."""
        out = first + np.minimum(np.arange(HEADS)[:, None], sizes - 1)
        many = np.flatnonzero(sizes > 2)
        if not len(many):
            return out
        width, rows = sizes[many], np.flatnonzero(np.repeat(sizes > 2, sizes))
        at = np.cumsum(width) - width
        bits = np.unpackbits(self.context[rows].view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        agreed = np.abs(2 * ones - width[:, None]) * 2 >= width[:, None]
        group = np.repeat(np.arange(len(many)), width)
        off = ((bits != (2 * ones > width[:, None])[group]) & agreed[group]).sum(axis=1)
        out[:, many] = rows[np.lexsort((rows, off, group))[at + np.minimum(np.arange(HEADS)[:, None], width - 1)]]
        return out

    def any_of(self, flag: np.ndarray) -> np.ndarray:
        """Of ordered rows: whether the flag holds for any row of the signature."""
        if not len(self):
            return flag
        new = np.concatenate(([True], self.sig[1:] != self.sig[:-1]))
        return np.logical_or.reduceat(flag, np.flatnonzero(new))[np.cumsum(new) - 1]

    def unequal(self) -> Windows:
        """Of ordered rows one of each place of a text."""
        new = np.concatenate(([True], (self.sig[1:] != self.sig[:-1]) | (self.fp[1:] != self.fp[:-1]) | (self.at[1:] != self.at[:-1])))
        return self.take(np.flatnonzero(new[: len(self)]))

    def links(self, core_words: int, gram_words: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ordered rows: pairs (row, other row) to verify, and which rows others have yet to meet: those of the middle one's text, and those not surely similar to it."""
        n = len(self)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        first = np.flatnonzero(np.concatenate(([True], self.sig[1:] != self.sig[:-1])))
        sizes, every = np.diff(np.append(first, n)), np.arange(n)
        head, *more_heads = np.repeat(self._middle(first, sizes), sizes, axis=1)
        begin, end = np.repeat(first, sizes), np.repeat(first + sizes - 1, sizes)
        of_head = self.fp == self.fp[head]
        other = np.where(of_head, np.where(self.fp[begin] != self.fp, begin, end), head)
        apart = self.fp[other] != self.fp
        shared, enough = self.room(every, other, core_words, gram_words, least)
        shared = np.where(apart, shared, 0)
        meets = apart & enough & (every != head)
        sure = meets & surely_similar(self.context, self.context[other], gram_words, least)
        rows, others = [every[meets]], [other[meets]]
        for h in more_heads:
            a = np.flatnonzero(~sure & (self.fp[h] != self.fp) & (h != other))
            a = a[self.room(a, h[a], core_words, gram_words, least)[1]]
            rows.append(a)
            others.append(h[a])
        low = np.uint64((1 << SIDE) - 1)
        for side in (self.context & low, self.context >> np.uint64(SIDE)):
            order = np.lexsort((self.fp, side, self.sig))
            a, b = order[1:], order[:-1]
            near = (self.sig[a] == self.sig[b]) & (self.fp[a] != self.fp[b])
            a, b = a[near], b[near]
            more, enough = self.room(a, b, core_words, gram_words, least)
            better = enough & (more > np.minimum(shared[a], shared[b]))
            rows.append(a[better])
            others.append(b[better])
        rows, others = np.concatenate(rows), np.concatenate(others)
        stay = of_head | ~sure | (sizes <= HEADS)[np.cumsum(np.bincount(first, minlength=n)) - 1]
        return rows, others, stay


def _anchors(windows: Windows, rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, i, j) of pairs, a below b; of centres on one diagonal and at most JOIN_GAP apart one is enough."""
    up = windows.fp[rows] < windows.fp[others]
    x, y = np.where(up, rows, others), np.where(up, others, rows)
    a, b, i, j = windows.fp[x], windows.fp[y], windows.at[x], windows.at[y]
    order = np.lexsort((i, i // JOIN_GAP, i - j, b, a))
    a, b, i, j = a[order], b[order], i[order], j[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (np.diff(i - j) != 0) | (np.diff(i // JOIN_GAP) != 0)
    return a[new], b[new], i[new], j[new]


_ROW = pa.schema([("sig", pa.int64()), ("fp", pa.int64()), ("at", pa.int32()), ("context", pa.int64()), ("b", pa.int64()), ("j", pa.int32())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("context", pa.int64())])
_IS_WINDOW = -1  # in place of j: the row is a window of a shared signature, not a pair


def _lengths(least: int) -> tuple[int, int, int]:
    core = core_shingles(least)
    return core + WORDS - 1, max(1, min(GRAM_WORDS - WORDS + 1, core - 2)) + WORDS - 1, least


def _keyed(least: int):
    """A task's windows, but for those that are linked to others of it: these are pairs (fp, b), dealt to any key, as are the windows (signature b) that shared one in the task."""

    def joined(parts: list[Windows]) -> Iterator[pa.RecordBatch]:
        every = Windows.of(parts)
        windows, alone = every.shared()
        rows, others, stay = windows.links(*_lengths(least))
        kept = Windows.of([every.take(alone), windows.take(np.flatnonzero(stay))])
        held_back = windows.any_of(~stay)
        more = np.concatenate([np.zeros(len(alone), np.int32), held_back[stay].astype(np.int32)])
        yield pa.RecordBatch.from_arrays([pa.array(kept.sig.view(np.int64)), pa.array(kept.fp), pa.array(kept.at.astype(np.int32)), pa.array(kept.context.view(np.int64)), pa.nulls(len(kept), pa.int64()), pa.array(more)], schema=_ROW)
        a, b, i, j = _anchors(windows, rows, others)
        spread = mix(a.view(np.uint64) + mix(b.view(np.uint64) + i.astype(np.uint64))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(a), pa.array(i.astype(np.int32)), pa.nulls(len(a), pa.int64()), pa.array(b), pa.array(j.astype(np.int32))], schema=_ROW)
        windows = windows.take(np.flatnonzero(held_back & (windows.sig & np.uint64(1) == 0)))
        spread = mix(windows.fp.view(np.uint64) + mix(windows.sig + windows.at.astype(np.uint64))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(windows.fp), pa.array(windows.at.astype(np.int32)), pa.array(windows.context.view(np.int64)), pa.array(windows.sig.view(np.int64)), pa.array(np.full(len(windows), _IS_WINDOW, np.int32))], schema=_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[Windows] = []
        for batch in batches:
            fresh, names = [], []
            for sequence in sequences(text_bytes(batch.column("text"))):
                if len(sequence) >= least and (name := name_of(sequence)) not in seen:
                    seen.add(name)
                    fresh.append(sequence)
                    names.append(name)
            keys, centres, owner, context = signatures(fresh, least)
            if len(keys):
                parts.append(Windows(keys, np.array(names, dtype=np.int64)[owner], centres, context))
            if sum(map(len, parts)) >= JOIN_ROWS:
                yield from joined(parts)
                parts = []
        if parts:
            yield from joined(parts)

    return run


def _linked(least: int):
    """Pairs of windows from rows in the order of their signatures, and the windows of shared ones; a signature of very many rows is read in pieces, each with its first row."""

    def pairs(every: Windows, more: set[int]) -> Iterator[pa.RecordBatch]:
        windows, _ = every.shared()
        windows = windows.unequal()
        rows, others, _ = windows.links(*_lengths(least))
        a, b, i, j = _anchors(windows, rows, others)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.nulls(len(a), pa.int64())], schema=_PAIR)
        _, group, sizes = np.unique(windows.sig, return_inverse=True, return_counts=True)
        unmet = (sizes[group] > HEADS) | np.isin(windows.sig, np.array(sorted(more), np.uint64))
        windows = windows.take(np.flatnonzero(unmet & (windows.sig & np.uint64(1) == 0)))
        yield _window_rows(pa.array(windows.sig.view(np.int64)), pa.array(windows.fp), pa.array(windows.at.astype(np.int32)), pa.array(windows.context.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Windows] = []
        more: set[int] = set()  # signatures of the parts that have other windows elsewhere: few at a time
        for batch in batches:
            done = batch.filter(batch.column("b").is_valid())
            paired = pa.array(done.column("j").to_numpy() != _IS_WINDOW)
            met, windows = done.filter(paired), done.filter(pc.invert(paired))
            yield pa.RecordBatch.from_arrays([met.column(c) for c in ("fp", "b", "at", "j", "context")], schema=_PAIR)
            yield _window_rows(*(windows.column(c) for c in ("b", "fp", "at", "context")))
            rest = batch.filter(batch.column("b").is_null())
            if rest.num_rows:
                more.update(rest.filter(pc.equal(rest.column("j"), 1)).column("sig").to_numpy().view(np.uint64).tolist())
                parts.append(Windows(rest.column("sig").to_numpy().view(np.uint64), rest.column("fp").to_numpy(), rest.column("at").to_numpy().astype(np.int64), rest.column("context").to_numpy().view(np.uint64)))
            if sum(map(len, parts)) >= JOIN_ROWS:
                windows = Windows.of(parts)
                last = int(np.flatnonzero(windows.sig != windows.sig[-1]).max(initial=-1)) + 1
                if last:
                    yield from pairs(windows.take(np.arange(last)), more)
                    parts = [windows.take(np.arange(last, len(windows)))]
                    more &= {int(windows.sig[-1])}
                else:
                    yield from pairs(windows, more | {int(windows.sig[0])})
                    parts = [windows.take(np.arange(1))]
                    more = {int(windows.sig[0])}
        if parts:
            yield from pairs(Windows.of(parts), more)

    return run


def _window_rows(sig: pa.Array, fp: pa.Array, at: pa.Array, context: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([sig, fp, at, pa.array(np.full(len(at), _IS_WINDOW, np.int32)), context], schema=_PAIR)


def _rest(least: int):
    """Pairs (a, b, i, j) of all windows of a block (rows in the order of signature and block) that lie in different classes and leave room for a passage."""
    schema = pa.schema([(f.name, f.type) for f in _PAIR][:4])

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sig, one, two, block, fp, at, context, label = (table[c].to_numpy() for c in ("sig", "one", "two", "block", "fp", "at", "context", "label"))
        every = Windows(sig.view(np.uint64), fp, at.astype(np.int64), context.view(np.uint64))
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        ends = np.append(np.flatnonzero(new)[1:], len(sig))[np.cumsum(new) - 1]
        later = np.cumsum(ends - np.arange(len(sig)) - 1)  # each row meets those after it in its block
        low = 0
        while low < len(sig):
            high = max(low + 1, int(np.searchsorted(later, (later[low - 1] if low else 0) + COMPARED, side="right")))
            counts = ends[low:high] - np.arange(low, high) - 1
            x = np.repeat(np.arange(low, high), counts)
            y = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts) + x + 1
            meets = (fp[x] != fp[y]) & (label[x] != label[y]) & ((one[x] == two[x]) | (block[x] != block[y]))
            x, y = x[meets], y[meets]
            far = every.room(x, y, *_lengths(least))[1]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(_anchors(every, x[far], y[far]), schema, strict=True)], schema=schema)
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            parts.append(batch)
            if sum(p.num_rows for p in parts) >= JOIN_ROWS:
                table = pa.Table.from_batches(parts)
                keys = [table[c].to_numpy() for c in ("sig", "one", "two")]
                last = int(np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys])).max(initial=-1)) + 1
                yield from pairs(table.slice(0, last))
                parts = table.slice(last).to_batches()
        if parts:
            yield from pairs(pa.Table.from_batches(parts))

    return run


class Aligner:
    """Extends matches of pairs of sequences, all pairs of a block at once."""

    def __init__(self, found: list[np.ndarray]):
        self.size = np.array([len(s) for s in found], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([np.zeros(0, np.uint64), *found]).astype(np.uint64)
        self.power = _power_table(len(self.flat) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(self.flat) * self.power[: len(self.flat)], dtype=np.uint64)))

    def _equal(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        with np.errstate(over="ignore"):
            return (self.sums[lo + n] - self.sums[lo]) * self.power[hi - lo] == self.sums[hi + n] - self.sums[hi]

    def _longest(self, most: np.ndarray, equal) -> np.ndarray:
        """The largest n up to ``most`` for which ``equal(rows, n)`` holds, by bisection."""
        low, high = np.zeros(len(most), dtype=np.int64), most.copy()
        while len(rows := np.flatnonzero(low < high)):
            mid = (low[rows] + high[rows] + 1) // 2
            same = equal(rows, mid)
            low[rows] = np.where(same, mid, low[rows])
            high[rows] = np.where(same, high[rows], mid - 1)
        return low

    def runs(self, pair: np.ndarray, tx: np.ndarray, ty: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """(pair, start, end, shift) of the runs of equal shingles around i, j; distinct, in order."""
        inside = (i < self.size[tx]) & (j < self.size[ty])
        pair, tx, ty, i, j = (v[inside] for v in (pair, tx, ty, i, j))
        x, y = self.begin[tx] + i, self.begin[ty] + j
        same = self.flat[x] == self.flat[y]
        pair, tx, ty, i, j, x, y = (v[same] for v in (pair, tx, ty, i, j, x, y))
        after = self._longest(np.minimum(self.size[tx] - i, self.size[ty] - j), lambda r, n: self._equal(x[r], y[r], n))
        before = self._longest(np.minimum(i, j), lambda r, n: self._equal(x[r] - n, y[r] - n, n))
        return np.unique(np.stack([pair, i - before, i + after, i - j], axis=1), axis=0)

    def beyond(self, tx: np.ndarray, ty: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
        """For places i, j: (row, i, j) of the nearest equal shingles in steps of ``step``, over all shifts and on the same diagonal."""
        reach = np.arange(JOIN_GAP + 1)
        u, v = np.meshgrid(reach, reach, indexing="ij")
        rank = (np.maximum(u, v) * (2 * JOIN_GAP) + np.abs(u - v)).ravel()
        order = np.argsort(rank, kind="stable")
        out: list[tuple[np.ndarray, ...]] = []
        for s in range(0, len(i), 4096):
            part = slice(s, s + 4096)
            px, py = i[part, None] + step * reach, j[part, None] + step * reach
            in_x, in_y = (px >= 0) & (px < self.size[tx[part], None]), (py >= 0) & (py < self.size[ty[part], None])
            x = self.flat[np.where(in_x, self.begin[tx[part], None] + px, 0)]
            y = self.flat[np.where(in_y, self.begin[ty[part], None] + py, 0)]
            hits = (x[:, :, None] == y[:, None, :]) & in_x[:, :, None] & in_y[:, None, :]
            some = np.flatnonzero(hits.any(axis=(1, 2)))
            flat = hits[some].reshape(len(some), len(rank))
            best = order[flat[:, order].argmax(axis=1)]
            straight = hits[some][:, reach, reach]
            has = straight.any(axis=1)
            near = straight.argmax(axis=1)[has]
            for row, a, b in ((some, best // (JOIN_GAP + 1), best % (JOIN_GAP + 1)), (some[has], near, near)):
                row = row + s
                out.append((row, i[row] + step * a, j[row] + step * b))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def extended(self, text_x: np.ndarray, text_y: np.ndarray, pair: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """All runs that are reached from the matches (pair, i, j), on across gaps.

        A match whose two places lie in runs of its pair already isn't followed: in texts that repeat themselves every shift would be a run.
        """
        new = self.runs(pair, text_x[pair], text_y[pair], i, j)
        every = new
        while len(new):
            p, start, end, shift = new.T
            tx, ty = text_x[p], text_y[p]
            right, left = self.beyond(tx, ty, end, end - shift, 1), self.beyond(tx, ty, start - 1, start - 1 - shift, -1)
            rows, i, j = (np.concatenate(c) for c in zip(right, left, strict=True))
            p = p[rows]
            known = every[np.isin(every[:, 0], p)]
            fresh = ~(_covered(known[:, 0], known[:, 1], known[:, 2], p, i) & _covered(known[:, 0], known[:, 1] - known[:, 3], known[:, 2] - known[:, 3], p, j))
            p, i, j = p[fresh], i[fresh], j[fresh]
            new = self.runs(p, text_x[p], text_y[p], i, j)
            if len(new):
                every = np.concatenate([every, new])
        return np.unique(every, axis=0)


def _covered(pair: np.ndarray, start: np.ndarray, end: np.ndarray, asked_pair: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether places lie in intervals of their pair."""
    if not len(pair):
        return np.zeros(len(asked), dtype=bool)
    order = np.lexsort((start, pair))
    starts = (pair[order] << 32) + start[order]
    ends = np.maximum.accumulate((pair[order] << 32) + end[order])
    key = (asked_pair << 32) + asked
    at = np.searchsorted(starts, key, side="right") - 1
    return (at >= 0) & (ends[np.maximum(at, 0)] > key)


def _similar_parts(chain: list[tuple[int, int, int]], least: int) -> Iterator[tuple[int, int]]:
    """For each run of a chain (start, end, other start), the longest part from it on that has ``least`` shingles, of which enough are aligned; parts within the part before are left out."""
    a, b, c = np.array(chain, dtype=np.int64).T
    d, sums, done = c + b - a, np.concatenate(([0], np.cumsum(b - a))), 0
    for s in range(0, len(a), 64):
        rows = slice(s, s + 64)
        both = sums[1:] - sums[:-1][rows, None]
        wide, other = b - a[rows, None], d - c[rows, None]
        fits = (both >= SIMILAR * (wide + other - both)) & (np.minimum(wide, other) >= least)
        fits &= np.arange(len(a)) >= np.arange(len(a))[rows, None]
        last = len(a) - fits[:, ::-1].argmax(axis=1)
        for k in np.flatnonzero(fits.any(axis=1)).tolist():
            if last[k] > done:
                done = int(last[k])
                yield s + k, done


def _passages_of(x: np.ndarray, y: np.ndarray, runs: list[list[int]], least_words: int) -> list[tuple[int, int, int, int]]:
    """Verified passages (x start, x end, y start, y end) in words of the runs (start, end, shift) of one pair."""
    open_: list[list[tuple[int, int, int]]] = []
    joined: list[list[tuple[int, int, int]]] = []
    for a, b, c in sorted((a, b, a - k) for a, b, k in runs):
        open_ = [chain for chain in open_ if chain[-1][1] >= a - JOIN_GAP]
        for chain in reversed(open_):
            s, e, t = chain[-1]
            if 0 <= a - e and 0 <= c - (t + e - s) <= JOIN_GAP:
                chain.append((a, b, c))
                break
        else:
            joined.append([(a, b, c)])
            open_.append(joined[-1])
    out, least = [], least_words - WORDS + 1
    for chain in joined:
        (first, end, _), length = chain[0], chain[-1][1] - chain[0][0]
        if length < least:
            continue
        if len(chain) == 1:
            out.append((first, end + WORDS - 1, chain[0][2], chain[0][2] + length + WORDS - 1))
            continue
        for k, n in _similar_parts(chain, least):
            (a, _, c), (s, b, t) = chain[k], chain[n - 1]
            d = t + b - s
            p, q = set(x[a:b].tolist()), set(y[c:d].tolist())
            both = len(p & q)
            if both >= SIMILAR * (len(p) + len(q) - both):
                out.append((a, b + WORDS - 1, c, d + WORDS - 1))
    return out


def verified(found: list[np.ndarray], text_x: np.ndarray, text_y: np.ndarray, pair: np.ndarray, i: np.ndarray, j: np.ndarray, least_words: int) -> list[tuple[int, int, int, int, int]]:
    """(pair, x start, x end, y start, y end) of the passages of pairs (text_x, text_y) around their matches (pair, i, j)."""
    runs = Aligner(found).extended(text_x, text_y, pair, i, j)
    first = np.flatnonzero(np.concatenate(([True], runs[1:, 0] != runs[:-1, 0]))) if len(runs) else np.zeros(0, np.int64)
    out = []
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(runs)], strict=False):
        p = int(runs[s, 0])
        out += [(p, *q) for q in _passages_of(found[text_x[p]], found[text_y[p]], runs[s:e, 1:].tolist(), least_words)]
    return out


def passages(x: np.ndarray, y: np.ndarray, anchors: list[tuple[int, int]], least_words: int) -> list[tuple[int, int, int, int]]:
    """The verified passages of one pair around matches (x place, y place). A passage begins and ends with a shared shingle."""
    i, j = np.array(anchors, dtype=np.int64).reshape(-1, 2).T
    return [p[1:] for p in verified([x, y], np.array([0]), np.array([1]), np.zeros(len(i), np.int64), i, j, least_words)]


def _read_again(least: int, bitmap: np.ndarray):
    """A thin row for each text, and its sequence, 32 bits a shingle, if it may be wanted; once each and task."""
    schema = [("n_words", pa.int64()), ("fp", pa.int64()), ("members", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, names, members = [], [], []
            for sequence in sequences(text_bytes(batch.column("text"))):
                sizes.append(len(sequence) + WORDS - 1 if len(sequence) else 0)
                names.append(name := name_of(sequence) if len(sequence) >= least else None)
                slot = 0 if name is None else name & (64 * BLOOM_WORDS - 1)
                wanted = name is not None and name not in seen and bool(bitmap[slot >> 6] >> (slot & 63) & 1)
                if wanted:
                    seen.add(name)
                members.append((sequence >> np.uint64(32)).astype(np.uint32).tobytes() if wanted else None)
            own = [pa.array(c, kind) for c, (_, kind) in zip((sizes, names, members), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *own], names=["id", *(c for c, _ in schema)])

    return run


_EDGE = ("a", "a_start", "a_end", "b", "b_start", "b_end")


def _overlapping(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the union of overlapping spans of a text that each span lies in."""
    order = np.lexsort((start, text))
    starts, ends = (text[order] << 32) + start[order], np.maximum.accumulate((text[order] << 32) + end[order])
    opens = np.concatenate(([True], starts[1:] >= ends[:-1]))
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(order)) - 1
    low, number = np.int64((1 << 32) - 1), np.cumsum(opens) - 1
    out_start, out_end = np.empty_like(start), np.empty_like(end)
    out_start[order], out_end[order] = (starts[first] & low)[number], (ends[last] & low)[number]
    return out_start, out_end


def _block(least_words: int):
    """Verified passages of a block's pairs, as distinct links of its texts' spans; overlapping spans of a text are one."""
    schema = pa.schema([(c, pa.int64() if c in "ab" else pa.int32()) for c in _EDGE])

    def run(anchors: pa.Table, held: pa.Table) -> pa.Table:
        names = held["fp"].to_numpy()
        order = np.argsort(names)
        names, members = names[order], held["members"].take(pa.array(order)).to_pylist()
        found = [np.frombuffer(m, np.uint32) for m in members]
        a, b, i, j = (anchors[c].to_numpy() for c in ("a", "b", "i", "j"))
        ab, pair = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)
        tx, ty = np.searchsorted(names, ab[:, 0]), np.searchsorted(names, ab[:, 1])
        rows = np.array(verified(found, tx, ty, pair.ravel(), i.astype(np.int64), j.astype(np.int64), least_words), dtype=np.int64).reshape(-1, 5)
        n, (p, xs, xe, ys, ye) = len(rows), rows.T
        if n:
            start, end = _overlapping(np.concatenate([tx[p], ty[p]]), np.concatenate([xs, ys]), np.concatenate([xe, ye]))
            rows = np.unique(np.stack([names[tx[p]], start[:n], end[:n], names[ty[p]], start[n:], end[n:]], axis=1), axis=0)
        else:
            rows = np.zeros((0, 6), np.int64)
        return pa.table([pa.array(c, f.type) for c, f in zip(rows.T, schema, strict=True)], schema=schema)

    return run


def _bitmap_of(names: DataFrame) -> np.ndarray:
    slot = F.col("fp").bitwiseAND(F.lit(64 * BLOOM_WORDS - 1))
    words = (
        names.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(fp & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    )  # at most BLOOM_WORDS rows
    bitmap = np.zeros(BLOOM_WORDS, dtype=np.int64)
    for word, bits in words:
        bitmap[word] = bits
    return bitmap


def candidates(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, i, j): pairs of different texts, by name, with shared windows' places; and (sig, fp, at, context), the windows of shared signatures. Texts have ``least`` shingles or more."""
    windows = texts.select("text").mapInArrow(tidy(_keyed(least)), "sig long, fp long, at int, context long, b long, j int")
    pairs = windows.repartition("sig").sortWithinPartitions("sig").mapInArrow(tidy(_linked(least)), "a long, b long, i int, j int, context long")
    found = materialize(_thinned(pairs, "context"), "windows-anchors")
    paired = F.col("j") != _IS_WINDOW
    return found.filter(paired).drop("context"), found.filter(~paired).select(F.col("a").alias("sig"), F.col("b").alias("fp"), F.col("i").alias("at"), "context")


def _thinned(pairs: DataFrame, *more: str) -> DataFrame:
    """Of pairs (a, b, i, j) on one diagonal and at most JOIN_GAP apart one is enough."""
    shift = (F.col("i") - F.col("j")).alias("shift")
    kept = pairs.groupBy("a", "b", shift, F.floor(F.col("i") / JOIN_GAP).alias("near"), *more).agg(F.min("i").alias("i"))
    return kept.select("a", "b", "i", (F.col("i") - F.col("shift")).cast("int").alias("j"), *more)


def _unmet(windows: DataFrame, merged: DataFrame, label: DataFrame, least: int) -> DataFrame:
    """(a, b, i, j): all pairs of windows of one signature whose places lie in different classes of spans, or in none, and leave room for a passage.

    A signature of many windows is cut into blocks, and every two blocks are a key, so that neither is held by one task.
    """
    spans = merged.withColumn("node", F.struct("fp", "part")).join(label, "node", "left").select("fp", F.col("start_word").alias("at"), F.struct(F.col("end_word").alias("until"), F.xxhash64(F.coalesce("component", "node")).alias("class")).alias("span"))
    rows = windows.withColumn("at", F.col("at").cast("long")).unionByName(spans, allowMissingColumns=True)
    before = F.last("span", ignorenulls=True).over(Window.partitionBy("fp").orderBy("at", F.col("sig").isNotNull()))
    own = F.xxhash64("fp", "at", F.lit(5))
    placed = rows.withColumn("before", before).filter("sig is not null").withColumn("label", F.when(F.col("before.until") > F.col("at"), F.col("before.class")).otherwise(own))
    several = placed.groupBy("sig").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.ceil(F.count(F.lit(1)) / BLOCK_WINDOWS).cast("int").alias("blocks"))
    dealt = placed.join(several.filter("least < most").select("sig", "blocks"), "sig").withColumn("block", F.pmod(F.xxhash64("fp", "at"), "blocks").cast("int"))
    with_all = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = with_all.select("sig", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "fp", "at", "context", "label")
    key = ("sig", "one", "two")
    return keyed.repartition(*key).sortWithinPartitions(*key).mapInArrow(tidy(_rest(least)), "a long, b long, i int, j int")


def _verified(anchors: DataFrame, held: DataFrame, least_words: int) -> DataFrame:
    """Links of spans of different texts that hold verified passages: a, b (names of word sequences) and their spans in words.

    A block has all pairs of some texts a; one with very many pairs is cut by b, so a is sent once a block.
    """
    partners = anchors.groupBy("a").agg(F.count_distinct("b").alias("n"))
    groups = int((partners.agg(F.sum("n")).first()[0] or 0) // BLOCK_PAIRS + 1)
    cuts = partners.select("a", F.ceil(F.col("n") / BLOCK_PAIRS).alias("cuts"))
    placed = anchors.join(cuts, "a").select("a", "b", "i", "j", F.pmod(F.xxhash64("a", F.lit(3)), F.lit(groups)).alias("grp"), F.pmod(F.xxhash64("b", F.lit(4)), "cuts").alias("cut"))
    needed = placed.select(F.col("grp").alias("to_grp"), F.col("cut").alias("to_cut"), F.explode(F.array("a", "b")).alias("fp")).distinct()
    sent = held.dropDuplicates(["fp"]).join(needed, "fp")
    found = placed.groupBy("grp", "cut").cogroup(sent.groupBy("to_grp", "to_cut")).applyInArrow(_block(least_words), "a long, a_start int, a_end int, b long, b_start int, b_end int")
    return materialize(found, "windows-found")


def _merged(spans: DataFrame) -> DataFrame:
    """(fp, part, start_word, end_word) of the overlapping spans (fp, s, e) of each text."""
    along = Window.partitionBy("fp").orderBy("s", F.desc("e"))
    opens = (F.col("s") >= F.coalesce(F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    return spans.withColumn("opens", opens).withColumn("part", F.sum("opens").over(along)).groupBy("fp", "part").agg(F.min("s").cast("long").alias("start_word"), F.max("e").cast("long").alias("end_word"))


def _sides(found: DataFrame) -> DataFrame:
    a, b = (found.select(F.col(c).alias("fp"), F.col(f"{c}_start").alias("s"), F.col(f"{c}_end").alias("e")) for c in "ab")
    return a.unionByName(b)


def _components(found: DataFrame, merged: DataFrame) -> DataFrame:
    """(node, component) of the spans struct(fp, part) that passages link."""

    def node(c: str) -> DataFrame:
        return merged.select(F.col("fp").alias(c), F.struct("fp", "part").alias(f"{c}_node"), F.col("start_word").alias(f"{c}_from"), F.col("end_word").alias(f"{c}_to"))

    edges = found.join(node("a"), "a").filter("a_start >= a_from and a_start < a_to").join(node("b"), "b").filter("b_start >= b_from and b_start < b_to")
    return connected_components(edges.select(F.col("a_node").alias("src"), F.col("b_node").alias("dst")))


def _classes(found: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged spans of all texts, and the component of each that a passage links."""
    merged = materialize(_merged(_sides(found).unionByName(whole).distinct()), "windows-merged")
    return merged, _components(found, merged)


def _besides(pairs: DataFrame, met: DataFrame) -> DataFrame:
    key = ("a", "b", (F.col("i") - F.col("j")).alias("shift"), F.floor(F.col("i") / JOIN_GAP).alias("near"))
    return pairs.select(*key, "i", "j").join(met.select(*key), ["a", "b", "shift", "near"], "left_anti").select("a", "b", "i", "j")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Per document and maximal span of words that repeats in another one: id, start_word, end_word (exclusive), first_id.

    first_id is the least id of the documents whose spans are linked to this one by passages.
    """
    bound_batches(docs.sparkSession)
    rows, least = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), least_words - WORDS + 1
    anchors, windows = candidates(rows, least)

    def again(pairs: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(_bitmap_of(pairs.select(F.explode(F.array("a", "b")).alias("fp"))))
        return rows.mapInArrow(tidy(lambda batches: _read_again(least, shared.value)(batches)), f"id {dict(rows.dtypes)['id']}, n_words long, fp long, members binary")

    read = materialize(again(anchors), "windows-texts")
    thin = read.select("id", "n_words", "fp").filter("fp is not null")
    found = _verified(anchors, read.select("fp", "members").filter("members is not null"), least_words)
    classes = thin.groupBy("fp").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words"))
    whole = classes.filter("copies > 1").select("fp", F.lit(0).alias("s"), F.col("n_words").cast("int").alias("e"))
    merged, label = _classes(found, whole)
    rest = materialize(_besides(_thinned(_unmet(windows, merged, label, least)), anchors), "windows-rest")
    if not rest.isEmpty():
        found = found.unionByName(_verified(rest, again(rest).select("fp", "members").filter("members is not null"), least_words))
        merged, label = _classes(found, whole)
    passage = merged.withColumn("me", F.struct("fp", "part")).join(label, F.col("me") == F.col("node"), "left").withColumn("component", F.coalesce("component", "me"))
    first = passage.join(classes.select("fp", "least_id"), "fp").groupBy("component").agg(F.min("least_id").alias("first_id"))
    passage = passage.join(first, "component").select("fp", "start_word", "end_word", "first_id")
    return thin.select("id", "fp").join(passage, "fp").select(F.col("id").alias(id_col), "start_word", "end_word", "first_id")
