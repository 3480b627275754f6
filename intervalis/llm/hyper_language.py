"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. A trigram binds its letters: the
elementwise product of their vectors, rotated by two, one and no places. A
text's vector bundles (sums) those of all its trigrams, a language's prototype
those of its training texts, and a text gets the language whose prototype has
the largest cosine to its vector.

Letters are Unicode letters in lower case; a run of anything else is one blank.
Letters beyond Latin share 191 vectors by code point. Whole texts count, in
chunks: a chunk's trigrams are counted, and the counts multiply the matrix of
the trigrams' vectors, slice by slice; each worker keeps the vectors of the
trigrams it met last. Prototypes
are sums over tasks, aggregated by Spark; what is broadcast is one vector for
each language, and the number of languages is checked.

Null text, or text without a letter, is ``und`` with score 0; so is every text
if there is nothing to learn from. Null lang is not learned from; equal
cosines go to the language that sorts first; repeated rows are answered each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalis.llm._batches import bound_batches, stream, tidy
from intervalis.plans.scratch import materialize

DIMENSIONS = 1024
MAX_LANGUAGES = 4096
_CHUNK_CHARS, _CHUNK_TEXTS, _MOST_GRAMS, _SLICE = 1 << 18, 128, 24_000, 4096
_NO_LETTER = re.compile(r"[\W\d_]")


def _letter_codes() -> np.ndarray:
    """Code of each code point: 0 for a blank, 1 to 64 for the commonest Latin letters, others above."""
    codes = np.zeros(0x110000, dtype=np.uint8)
    latin = 0
    for point in range(0x110000):
        char = chr(point)
        if not char.isalpha():
            continue
        if point < 0x180 and char == char.lower() and latin < 64:
            latin += 1
            codes[point] = latin
        else:
            codes[point] = 65 + point % 191
    return codes


class Profiles:
    """Bundles of texts, and the bound vectors of the trigrams met last."""

    def __init__(self, dimensions: int):
        self.codes = _letter_codes()
        bits = np.unpackbits(stream(17, 256 * dimensions // 64).view(np.uint8)).reshape(256, dimensions)
        self.letters = bits.astype(np.float32) * 2 - 1
        self.vectors = np.empty((max(_MOST_GRAMS, _SLICE), dimensions), dtype=np.float32)
        self.met, self.place = np.zeros(1 << 24, dtype=bool), np.zeros(1 << 24, dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        self.column, self.used = np.full(1 << 24, -1, dtype=np.int32), 0

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` of at most _SLICE distinct trigrams; the table is begun anew when it is full."""
        new = grams[self.column[grams] < 0]
        if self.used + len(new) > len(self.vectors):
            self.forget()
            new = grams
        at = slice(self.used, self.used + len(new))
        self.column[new] = np.arange(at.start, at.stop, dtype=np.int32)
        a, b, c = (self.letters[(new >> s) & 255] for s in (16, 8, 0))
        self.vectors[at] = np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c
        self.used = at.stop
        return self.column[grams]

    def numbered(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct trigrams, and the place of each trigram among them."""
        self.met[grams] = True
        distinct = np.flatnonzero(self.met)
        self.met[distinct] = False
        self.place[distinct] = np.arange(len(distinct), dtype=np.int32)
        return distinct, self.place[grams]

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams of texts, one after the other, and the text of each."""
        lowered = [t.lower() for t in texts]
        codes = self.codes[np.frombuffer("\x00\x00".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lowered])[: len(codes)]
        # blanks collapse to one; a text begins and ends with one
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
        codes, owner = codes[keep].astype(np.int64), owner[keep]
        codes = np.concatenate(([0], codes, [0]))
        grams = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
        whole = codes[1:-1] > 0  # a trigram has a letter in its middle
        return grams[whole], owner[whole]

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x dimensions) sums of the trigrams' vectors, and whether each text has a letter.

        Sums are additive, so long texts are cut between words and distinct
        trigrams are taken in slices; no table grows with a text.
        """
        out, letters = np.zeros((len(texts), self.letters.shape[1])), np.zeros(len(texts), dtype=bool)
        pieces = [(k, piece) for k, text in enumerate(texts) for piece in _pieces(text)]
        start = 0
        while start < len(pieces):
            end, size = start, 0
            while end < len(pieces) and (end == start or size + len(pieces[end][1]) <= _CHUNK_CHARS):
                size += len(pieces[end][1])
                end += 1
            grams, piece = self.grams([p for _, p in pieces[start:end]])
            text = np.array([k for k, _ in pieces[start:end]])[piece] if len(piece) else piece
            letters[text] = True
            distinct, index = self.numbered(grams)
            for s in range(0, len(distinct), _SLICE):
                part = distinct[s : s + _SLICE]
                inside = (index >= s) & (index < s + len(part))
                counts = np.bincount(text[inside] * len(part) + index[inside] - s, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
                at = self.rows(part)
                out += counts.astype(np.float32) @ self.vectors[at]
            start = end
        return out, letters


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about _CHUNK_CHARS, cut at characters that aren't letters."""
    start = 0
    while len(text) - start > _CHUNK_CHARS and (m := _NO_LETTER.search(text, start + _CHUNK_CHARS)):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


def _chunked(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list, ...]]:
    """Rows in chunks of bounded text; null texts are empty."""
    for batch in batches:
        rows = [batch.column(c).to_pylist() for c in columns]
        texts, start, size = [t or "" for t in batch.column("text").to_pylist()], 0, 0
        for k, text in enumerate(texts):
            if k > start and (size + len(text) > _CHUNK_CHARS or k - start >= _CHUNK_TEXTS):
                yield texts[start:k], *(r[start:k] for r in rows)
                start, size = k, 0
            size += len(text)
        if texts:
            yield texts[start:], *(r[start:] for r in rows)


def _learned(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions), {}
        for texts, langs in _chunked(batches, ["lang"]):
            found, _ = profiles.bundles(texts)
            names = sorted(set(langs))
            member = np.array([[x == name for x in langs] for name in names], dtype=np.float64)
            for name, bundle in zip(names, member @ found, strict=True):
                sums[name] = sums.get(name, 0) + bundle
        for name, bundle in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([bundle.tolist()], pa.list_(pa.float64()))], names=["lang", "bundle"])

    return run


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The prototype of each language of ``docs``, of unit length; languages without a letter have none."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")
    sums = rows.mapInArrow(tidy(_learned(dimensions)), "lang string, bundle array<double>").select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    sums = materialize(sums, "language-bundles")
    if (n := sums.filter("pos = 0").limit(MAX_LANGUAGES + 1).count()) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages ({n} or more)")
    out: dict[str, np.ndarray] = {}
    for lang, pos, x in sums.collect():  # languages x dimensions numbers
        out.setdefault(lang, np.zeros(dimensions))[pos] = x
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if np.linalg.norm(v) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two more columns, lang_pred and score (the cosine, at least 0) unless named otherwise; the text alone decides."""
    bound_batches(docs.sparkSession)
    langs = list(prototypes)
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.stack([prototypes[k] for k in langs]).astype(np.float32) if langs else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix = shared.value
        profiles = None
        for batch in batches:
            preds, scores = [], []
            for (texts,) in _chunked(iter([batch.select([text_col]).rename_columns(["text"])]), []):
                if not known:
                    preds, scores = preds + ["und"] * len(texts), scores + [0.0] * len(texts)
                    continue
                profiles = profiles or Profiles(matrix.shape[1])
                bundles, letters = profiles.bundles(texts)
                norms = np.linalg.norm(bundles, axis=1)
                cosines = (bundles @ matrix.T) / np.where(norms > 0, norms, 1)[:, None]
                best = cosines.argmax(axis=1)
                preds += [known[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                scores += np.where(letters, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *names])

    extra = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{extra}, `{names[0]}` string, `{names[1]}` double")


def identify(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that aren't held out; answer all: id, held_out, lang_pred, score."""
    held = F.coalesce(held_out, F.lit(False))
    prototypes = learn(docs.filter(~held), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, prototypes).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
