import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervalis.llm import backoff_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [
    (1, "the cat sat on the mat"), (2, "The cat sat."), (3, None), (4, ""), (5, "a\tb\nc  d"), (6, "the cat sat on the mat"),
    (6, "the cat sat on the mat"), (7, "x"), (8, "é É the THE"), (None, "no id here"), (9, "the " * 3000), (10, "unseen words only"),
]


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(rows, held, order, fall):
    train = [tokens(t) for i, t in rows if not held(i)]
    grams, uni = Counter(), Counter()
    for seq in train:
        uni.update(seq)
        full = ["<s>", *seq]
        for k in range(2, order + 1):
            grams.update(tuple(full[j - k + 1 : j + 1]) for j in range(k - 1, len(full)))
    n, v = sum(uni.values()), len(uni)

    def count(g):
        return (len(train) if g == ("<s>",) else uni[g[0]]) if len(g) == 1 else grams[g]

    out = []
    for i, t in rows:
        full, base, score = ["<s>", *tokens(t)], 0.0, 0.0
        for j in range(1, len(full)):
            p = (uni[full[j]] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                if j >= k - 1 and (c := count(tuple(full[j - k + 1 : j]))):
                    p = (1 - fall) * count(tuple(full[j - k + 1 : j + 1])) / c + fall * p
            score += math.log10(p)
        out.append((i, held(i), len(full) - 1, sum(uni[w] > 0 for w in full[1:]), n, base, score))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("block", [1 << 20, 20])
def test_scores_equal_brute_force(spark, order, block):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in ROWS], "doc_id long, text string, score string").repartition(2, "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = sorted([tuple(r) for r in backoff_lm.score_texts(docs, held, order=order, block_bytes=block).collect()], key=str)
    wanted = brute(ROWS, lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 0, order, 0.4)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    for f, w in zip(found, wanted, strict=True):
        assert f[5:] == pytest.approx(w[5:], rel=1e-9)


def test_segments_change_nothing(monkeypatch):
    rnd = np.random.default_rng(2)
    seq, sizes = backoff_lm._sequence([" ".join(f"w{x}" for x in rnd.integers(0, 9, n)).encode() for n in (0, 1, 40, 300)])
    levels = [(gram, there, rnd.integers(0, 3, 1 << 16).astype(np.uint64)[(gram & np.uint64(0xFFFF)).astype(int)] * there) for gram, there in backoff_lm._grams(seq, sizes, 3)]
    # counts as of a corpus: an n-gram is seen only if those within it are
    levels[1][2][1:] *= (levels[0][2][:-1] > 0) | ~levels[0][1][:-1]
    levels[2][2][1:] *= (levels[1][2][:-1] > 0) & (levels[1][2][1:] > 0)
    machine = backoff_lm.Automaton(seq, sizes, levels, 0.4, 5000, 9, 50)
    whole = machine.scores()
    for n in (1, 7, 100):
        monkeypatch.setattr(backoff_lm, "SEGMENT", n)
        assert machine.scores() == pytest.approx(whole, rel=1e-12)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert backoff_lm.score_texts(docs, F.lit(False)).count() == 0


def test_probabilities_of_a_state_add_up(spark):
    rows = [(1, "a b a b c"), (2, "b a")]
    words = ["a", "b", "c", "zzz"]
    probes = [(10 + k, f"a {w}") for k, w in enumerate(words)] + [(99, "a")]
    docs = spark.createDataFrame(rows + probes, "doc_id long, text string")
    got = {r.doc_id: r for r in backoff_lm.score_texts(docs, F.col("doc_id") >= 10).collect()}
    wanted = {r[0]: r for r in brute(rows + probes, lambda i: i >= 10, 2, 0.4)}
    assert all(got[i].score == pytest.approx(wanted[i][6]) for i in wanted)
