import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from intervalis.llm import source_mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


def corpus(seed, n=400):
    rnd = random.Random(seed)
    names = ["a", "B", "é", None, "zz", "tiny", "empty", "𝔸"]
    rows = [(i, " ".join("w" for _ in range(rnd.choice([1, 5, 50, 300]))), rnd.choice(["a", "a", "a", *names[:5], "𝔸"]), rnd.choice([None, 0.5, 2.0, -1.0])) for i in range(n)]
    return rows + [(900, "one two\tthree", "tiny", None), (901, None, "empty", 1.0), (902, " ", "empty", 1.0), (None, "x y", "a", None), (903, "w " * 20_000, "zz", None), (5, *rows[5][1:]), (5, *rows[5][1:])]


@pytest.mark.parametrize("rows_a_range", [7, 5000])
def test_mix_equals_brute_force(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(M, "RANGE_ROWS", rows_a_range)
    rows = corpus(3)
    docs = spark.createDataFrame([(*r[:3], 1, 1.0, 9.0) for r in rows], "doc_id long, text string, source string, size int, key double, weight double").repartition(3)
    quality = spark.createDataFrame(list({(r[0], r[3]) for r in rows if r[0] is not None}), "id long, weight double")
    found = M.mix_sources(docs, quality).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes, keyed = {}, {}
    for i, t, s, q in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
        u = (int(hashlib.md5(f"mix|{'' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:12], 16) + 1) / (2**48 + 1)
        keyed.setdefault(s, []).append((-math.log(u) / (q if q and q > 0 else 1.0), -1 if i is None else i, size(t)))
    target, want = brute_targets(sizes), []
    for s, docs_ in keyed.items():
        whole, before = (int(target[s] // sizes[s]) if sizes[s] else 0), 0
        for _, i, n in sorted(docs_):
            more = n > 0 and before + n / 2 <= target[s] - whole * sizes[s]
            want.append((i, n, sizes[s], round(target[s], 6), (whole + more) * n))
            before += n
    got = [(-1 if r.doc_id is None else r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in found]
    assert sorted(got) == sorted(want)
    for s in sizes:
        taken = sum(r.taken for r in found if r.source == s)
        assert abs(taken - target[s]) <= max(size(t) for _, t, x, _ in rows if x == s)
    assert all(r.taken <= 3 * r["size"] for r in found)


def test_better_documents_come_earlier(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a", 4.0 if i % 2 else 0.25) for i in range(600)] + [(1000 + i, "w " * 10, "b", None) for i in range(900)], "doc_id long, text string, source string, q double")
    found = [r for r in M.mix_sources(docs, docs.select(F.col("doc_id").alias("id"), F.col("q").alias("weight")), weights=(1, 4)).collect() if r.source == "a" and r.taken]
    assert 150 < len(found) < 450 and sum(r.doc_id % 2 for r in found) > 0.75 * len(found)


def test_empty_table(spark):
    assert M.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_rows_of_one_id_spread_over_the_keys(spark):
    """Null or repeated ids of different texts have keys of their own, so no range holds them all."""
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i}", "a") for i in range(200)], "doc_id long, text string, source string")
    found = M.mix_sources(docs).collect()
    assert len(found) == 200 and len({r.key for r in found}) == 200
    assert sorted((r.doc_id or 0, r.taken) for r in found) == sorted((r.doc_id or 0, r.taken) for r in M.mix_sources(docs.repartition(3)).collect())
