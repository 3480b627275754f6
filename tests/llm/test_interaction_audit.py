import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from intervalis.llm.interaction_audit import audit, corners, monomials, shapley

SCHEMA = "doc_id long, text string, source string, n_chars int, w string, mask string"


def fails_of(rows):
    """Brute force: the failing letters of each row."""
    out = []
    for i, text, *_ in rows:
        t = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        bad = {"A"} if len(words) < 50 else set()
        bad |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        bad |= {"D"} if set(t) & set("#$%&*|") else set()
        bad |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows) else set()
        out.append(bad)
    return out


def expected(rows, labels):
    fails, good, toxic = fails_of(rows), {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    want = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
                total[x] += len(gone)
                failing = sum(x in f for _, f in own)
                want[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in want.items():
            if p == part:
                row.append(total[order[step - 1]])
    return want


def found(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(160):
        n = rnd.choice([0, 3, 49, 50, 51, 80])
        words = [rnd.choice(["Loud", "quiet", f"w{rnd.randrange(40)}", "$5" if rnd.random() < 0.05 else "é𝄞"]) if rnd.random() < 0.6 else f"u{k}" for k in range(n)]
        rows.append((i, rnd.choice([" ", "\n\t", "\x0b"]).join(words) + rnd.choice(["", " "]), rnd.choice(["a", "b", "", None])))
    rows += [(500 + k, rows[k][1], "c") for k in range(0, 60, 2)]  # copies in another part
    rows += [(7, rows[7][1], "a"), (500, rows[0][1], "b"), (None, rows[3][1], "a"), (None, None, None), (800, None, "a"), (801, "", "a"), (900, "x y " * 50_000, "a")]
    rows += [(-5, "one of many", "hot")] + [(1000 + k, "one of many", "hot") for k in range(120)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in [*range(0, 160, 3), *range(1000, 1040), 500, 500, 7]] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "w", "m") for r in rows], SCHEMA).repartition(5)
    got = found(audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == expected(rows, labels)
    assert any(v[0] == 0 for v in got.values()) and any(0 in v for v in got.values())


def test_polynomial_is_the_multilinear_extension():
    rnd = np.random.default_rng(3)
    counts = rnd.integers(0, 50, 32)
    a = monomials(counts)
    x = [Fraction(int(k), 10) for k in rnd.integers(0, 11, 5)]
    by_masks = sum(int(c) * (1 - np.prod([1 - x[k] for k in range(5) if m >> k & 1] or [Fraction(1)])) for m, c in enumerate(counts))
    by_monomials = sum(int(c) * np.prod([x[k] for k in range(5) if s >> k & 1] or [Fraction(1)]) for s, c in enumerate(a))
    assert by_masks == by_monomials
    assert all(corners(a)[s] == sum(c for m, c in enumerate(counts) if m & s) for s in range(32))
    # efficiency: the shares add up to all that is removed
    assert shapley(a).sum() == 120 * corners(a)[31]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "short", None, 1, "", "")], SCHEMA)
    assert audit(one, labels).agg(F.sum("removed")).first()[0] == 120
