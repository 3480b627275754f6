"""How filters interact: what each removes at every place of every order, and its Shapley share.

Each document fails a set of filters, a mask. Per part, the counts of masks give
the removal polynomial f(x1 ... xn): the expected number of documents removed
when filter i is switched on with probability xi, that is the sum over masks of
count * (1 - product over the mask of (1 - xi)). f is the multilinear extension
of the set function "removed by these filters", so

* the corner f(1 for the filters of a set, else 0) is what the set removes;
* the Shapley share of filter i is the integral over 0..1 of df/dxi along the
  diagonal: the sum over monomials S with i of coefficient(S) / |S|, an exact
  rational, which n! turns into a whole number (the sum over all orders).

Texts are measured with SQL functions, once, into a table of thin rows; copies
are found on (text digest, id) pairs, so that a text with very many copies is
not one key of a join; what reaches Python is at most 2^n counts a part.

Null text counts as empty, null part as the empty string. A null id matches no
label, is never a copy and makes none; repeated rows are documents each, and
those with the least id of their text are no copies. Of several labels of an id,
any that says good (or toxic) counts. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervalis.plans.scratch import materialize

#: The shortest text in words, least share of distinct words and greatest of capitals in percent, and the marks of junk.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, JUNK = 50, 65, 5, r"[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
#: The content filters A to D come first, E (copies) last.
NAMES = "ABCDE"
#: Parts handled at once in Python; each gives n * n! rows.
PARTS = 100


def digest(text: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, key, mask) of every row: mask has bit 0 for A to bit 3 for D."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", BLANKS), ""))
    rows = rows.select("id", "part", "t", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct"))
    capitals = F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long")
    fails = [F.col("words") < LEAST_WORDS, 100 * F.col("distinct") < DISTINCT_PERCENT * F.col("words"), 100 * capitals > CAPITAL_PERCENT * F.length("t").cast("long"), F.col("t").rlike(JUNK)]
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("id", "part", digest(F.col("t")).alias("key"), mask.cast("int").alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail; labels are (id_col, quality, toxic)."""
    rows = materialize(measured(docs, id_col, text_col, part_col), "audit-masks")
    first = rows.filter("id is not null").groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    said = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    all_of = rows.join(first, ["key", "id"], "left").withColumn("mask", F.col("mask") + F.when(copy, 1 << NAMES.index("E")).otherwise(0))
    # repeated rows of one id meet its label as one row a mask
    alike = all_of.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(said, "id", "left")
    return alike.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def monomials(counts: np.ndarray) -> np.ndarray:
    """Coefficients of the removal polynomials, by the monomial's set of filters; the last axis of ``counts`` is the mask."""
    n = counts.shape[-1].bit_length() - 1
    above = counts.copy()  # sums over supersets
    for k in range(n):
        without = np.flatnonzero(~np.arange(1 << n) >> k & 1)
        above[..., without] += above[..., without | 1 << k]
    sign = np.array([-1 if s.bit_count() % 2 == 0 else 1 for s in range(1 << n)])
    out = above * sign
    out[..., 0] = 0
    return out


def corners(coefficients: np.ndarray) -> np.ndarray:
    """The polynomials' values where the filters of a set are 1 and all others 0, by set."""
    n = coefficients.shape[-1].bit_length() - 1
    out = coefficients.copy()
    for k in range(n):
        having = np.flatnonzero(np.arange(1 << n) >> k & 1)
        out[..., having] += out[..., having ^ 1 << k]
    return out


def shapley(coefficients: np.ndarray) -> np.ndarray:
    """n! times the integral of each partial derivative along the diagonal; the last axis is the filter."""
    n = coefficients.shape[-1].bit_length() - 1
    out = []
    for k in range(n):
        sets = [s for s in range(1 << n) if s >> k & 1]
        weights = [factorial(n) * Fraction(1, s.bit_count()) for s in sets]  # t^(|S| - 1) over 0..1
        assert all(w.denominator == 1 for w in weights)
        out.append(coefficients[..., sets] @ np.array([int(w) for w in weights]))
    return np.stack(out, axis=-1)


_COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _audited(names: str):
    n = len(names)
    orders = list(permutations(range(n)))
    now = np.array([[sum(1 << f for f in o[: k + 1]) for k in range(n)] for o in orders]).ravel()
    letter = np.array(orders).ravel()
    before, per = now ^ (1 << letter), len(now)
    order_names, steps = [names_of for o in orders for names_of in ["".join(names[f] for f in o)] * n], np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in _COLUMNS)])

    def of(parts: list[str], entries: list[list[dict]]) -> pa.RecordBatch:
        counts = np.zeros((len(parts), 3, 1 << n), dtype=np.int64)
        for k, masks in enumerate(entries):
            for e in masks:
                counts[k, :, e["mask"]] = e["n"], e["good"], e["toxic"]
        coefficients = monomials(counts)
        gone, full = corners(coefficients), (1 << n) - 1
        total = counts[:, 0].sum(axis=-1)
        single = gone[:, 0][:, 1 << letter]
        lost = gone[:, :, now] - gone[:, :, before]
        found = {"kept": total[:, None] - gone[:, 0][:, now], "removed": lost[:, 0], "redundant": single - lost[:, 0], "unique_fails": (gone[:, 0, full, None] - gone[:, 0][:, full ^ (1 << np.arange(n))])[:, letter]}
        found |= {"good_lost": lost[:, 1], "toxic_lost": lost[:, 2], "shapley": shapley(coefficients[:, 0])[:, letter]}
        head = [pa.array(np.repeat(np.array(parts, dtype=object), per), pa.string()), pa.array(order_names * len(parts), pa.string()), pa.array(np.tile(steps, len(parts)))]
        return pa.RecordBatch.from_arrays([*head, *(pa.array(found[c].ravel()) for c in _COLUMNS)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                part = batch.slice(at, PARTS)
                yield of(part.column("part").to_pylist(), part.column("entries").to_pylist())

    return run


def interactions(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """A row for each part, order of the filters and step, from (part, mask, n, good, toxic)."""
    entries = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries"))
    return entries.mapInArrow(_audited(names), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COLUMNS))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of the five filters over ``docs``, per part."""
    return interactions(mask_counts(docs, labels, id_col, text_col, part_col))
