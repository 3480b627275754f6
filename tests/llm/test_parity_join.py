import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervalis.llm import parity_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows, n = [], 0
    for size in (1, 3, 5, 6, 7, 8, 9, 10, 12, 15, 20, 33, 64, 65, 70, 130, 400):
        for _ in range(3):
            base = [rnd.choice(words) for _ in range(size)]
            for _ in range(6):
                edit = list(base)
                for _ in range(rnd.randrange(0, 2 + size // 18)):
                    p = rnd.randrange(len(edit))
                    edit[p : p + rnd.randrange(0, 2)] = [rnd.choice(words)]
                base = edit if rnd.random() < 0.5 else base
                n += 1
                rows.append((n, " ".join(edit)))
    return rows + [(5000, None), (5001, ""), (5002, " \n\t"), (None, rows[7][1].upper()), (3, rows[2][1]), (3, rows[2][1]), (5003, "word " * 4000), (5004, "word " * 3990)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("part", F.lit(1)).repartition(3)
    found = parity_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted([tuple(r) for r in found], key=str) == brute(rows)


def test_linked_sets_share_a_key():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.choice([4, 5, 6, 7, 8, 9, 15, 16, 17, 31, 32, 40, 100, 127, 128, 160, 1000])
        universe = parity_join.stream(rnd.randrange(1 << 30), 3 * n)
        a = set(range(n))
        b = set(a)
        while True:
            c = set(b)
            c.symmetric_difference_update([rnd.randrange(int(1.3 * n) + 1)])
            if len(a & c) * 100 < 80 * len(a | c):
                break
            b = c
        common = np.sort(rnd.sample(universe.tolist(), rnd.choice([0, n // 3, 2 * n, 3 * n])))
        keys = [set(parity_join.part_keys(np.sort(universe[sorted(s)]), np.array(common, dtype=np.uint64)).tolist()) for s in (a, b)]
        (whole_a, less_a), (whole_b, less_b) = ([set(k.tolist()) for k in parity_join.small_keys(np.sort(universe[sorted(s)]))] for s in (a, b))
        assert a == b or keys[0] & keys[1] or whole_a & less_b or whole_b & less_a


def test_short_texts_that_differ_in_one_word_are_no_candidates(spark):
    """Sets that all lack another member of one common set meet only through that set."""
    base = "one two three four five six seven eight nine ten"
    rows = [(k, f"{base} x{k}") for k in range(200)] + [(900, base)] + [(1000 + k, f"other words here than those before y{k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in parity_join.jaccard_components(docs).collect()}
    assert {found[k] for k in range(200)} == {0} and found[900] == 0 and all(found[1000 + k] == 1000 + k for k in range(50))


def test_empty_table(spark):
    assert parity_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sets_just_above_the_small_ones_emit_no_dead_keys():
    """Eight members: keys of their own band only, an empty part's in one of a thousand, and enough for a partner with one member more."""
    rng = np.random.default_rng(4)
    none, beyond = np.zeros(0, dtype=np.uint64), 0
    for _ in range(4000):
        mine = np.unique(rng.integers(0, 2**64, 8, dtype=np.uint64))
        keys = parity_join.part_keys(mine, none)
        beyond += len(keys) > len(mine) // 4 + 1
        more = np.sort(np.append(mine, rng.integers(0, 2**64, 1, dtype=np.uint64)))
        assert set(keys.tolist()) & set(parity_join.part_keys(more, none).tolist())
    assert beyond < 12
