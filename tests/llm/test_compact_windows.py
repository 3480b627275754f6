import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from intervalis.llm import compact_windows as C


def test_windows_of_several_sequences_are_those_of_each():
    rnd = np.random.default_rng(0)
    parts = [rnd.permutation(n).astype(np.uint64) << np.uint64(30) for n in (0, 5, 10, 11, 60, 300)]
    ends = np.cumsum([len(p) for p in parts])
    got = C.compact_windows(np.concatenate(parts), 10, ends - [len(p) for p in parts], ends)
    want = [(b + x, b + y, b + z) for p, b in zip(parts, ends - [len(p) for p in parts], strict=True) for x, y, z in C.compact_windows(p, 10)]
    assert sorted(map(tuple, got.tolist())) == sorted(want) and len(C.compact_windows(np.zeros(9, np.uint64), 10)) == 0
    for left, centre, right in want:
        assert left <= centre <= right and right - left >= 9


def test_equal_hashes_make_no_deep_tree():
    assert len(C.compact_windows(np.zeros(300_000, np.uint64), 12)) < 300_000


def test_similar_passages_share_a_run_of_core_shingles():
    assert C.core_shingles(46) == 21
    rnd = np.random.default_rng(5)
    for _ in range(3000):  # random edits of random passages
        x = rnd.integers(0, 2**40, rnd.integers(50, 200)).tolist()
        y = list(x)
        for _ in range(rnd.integers(1, 6)):
            at, kind = rnd.integers(0, len(y)), rnd.integers(0, 3)
            y[at : at + int(kind != 1)] = [int(rnd.integers(0, 2**40))] * int(kind != 2)
        p, q = ([tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in (x, y))
        both = len(set(p) & set(q))
        if min(len(p), len(q)) >= 46 and both >= 0.8 * (len(set(p)) + len(set(q)) - both):
            where = {s: k for k, s in enumerate(q)}
            best = run = 0
            for k, s in enumerate(p):
                run = run + 1 if s in where and k and where.get(p[k - 1], -9) + 1 == where[s] else int(s in where)
                best = max(best, run)
            assert best >= 21


def test_windows_cover_every_long_subsequence_once():
    h = np.random.default_rng(1).permutation(80).astype(np.uint64) << np.uint64(30)
    windows = C.compact_windows(h, 12)
    for i in range(80):
        for j in range(i + 11, 80):
            hits = [c for left, c, right in windows if left <= i <= c <= j <= right]
            assert hits == [i + int(h[i : j + 1].argmin())]


def brute_exact(rows, least):
    """Words of each document that lie in a run of ``least`` words which another document has too."""
    where = {}
    for k, (_, t) in enumerate(rows):
        w = (t or "").lower().split()
        for i in range(len(w) - least + 1):
            where.setdefault(tuple(w[i : i + least]), set()).add(k)
    out = []
    for k, (_, t) in enumerate(rows):
        w, hit = (t or "").lower().split(), set()
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                hit |= set(range(i, i + least))
        out.append(hit)
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    shared, long, line = fresh(55), fresh(120), ["licensed", "under", "the", "apache", "license", "version", "two"]
    out = [(i, " ".join(fresh(rnd.choice([10, 80, 200])) + line + fresh(40))) for i in range(60)]
    out += [(100 + i, " ".join(fresh(rnd.randrange(70)) + shared + fresh(rnd.randrange(70)))) for i in range(12)]
    out += [(200 + i, " ".join(fresh(30) + long[:60] + fresh(1) + long[61:] + fresh(30))) for i in range(3)]
    same = " ".join(fresh(90))
    out += [(300, same), (301, same.upper()), (301, same), (302, " ".join(fresh(20) + same.split()[:52])), (303, " ".join(shared[:40])), (304, " ".join(shared + fresh(20) + shared))]
    inner = fresh(60)
    return [*out, (400, None), (401, ""), (402, " ".join(inner + inner)), (None, " ".join(shared)), (403, "echo " * 5000), (404, "echo " * 300)]


def test_exact_repeats_are_found_and_clean_texts_left_alone(spark, rows):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    found = C.repeated_passages(docs).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.end_word - r.start_word >= 50
    for (i, _), words in zip(rows, brute_exact(rows, 50), strict=True):
        assert words <= by_id.get(i, set()), i
    assert not set(by_id) & ({*range(60), 303, 400, 401, 402})
    assert {r.first_id for r in found if r.doc_id in range(100, 112)} == {100}
    assert all(len(by_id[200 + k]) >= 119 for k in range(3))  # one changed word doesn't break a passage
    assert {(r.start_word, r.end_word) for r in found if r.doc_id == 300} == {(0, 90)}


@pytest.mark.parametrize("edit", ["change", "insert", "drop"])
@pytest.mark.parametrize("n", [55, 60, 70])
def test_a_passage_with_an_edit_in_the_middle_is_found_from_any_anchor(n, edit):
    rnd = np.random.default_rng(n)
    fresh = lambda k: rnd.integers(0, 2**60, k).astype(np.uint64)
    size, half = n - 4, n // 2
    x = fresh(size)
    y = np.concatenate([x[: half - 4], fresh({"change": 5, "insert": 6, "drop": 4}[edit]), x[half + 1 :]])
    left, right = np.concatenate([fresh(30), x, fresh(20)]), np.concatenate([fresh(12), y, fresh(40)])
    for k in (0, half - 5, half + 1, size - 1):
        j = int(np.flatnonzero(right == left[30 + k])[0])
        assert C.passages(left, right, [(30 + k, j)], 50) == [(30, 30 + n, 12, 12 + len(y) + 4)]


def test_a_short_match_or_a_lower_similarity_is_no_passage():
    rnd = np.random.default_rng(2)
    fresh = lambda k: rnd.integers(0, 2**60, k).astype(np.uint64)
    x, run = fresh(36), fresh(47)
    assert C.passages(np.concatenate([fresh(30), x, fresh(30)]), np.concatenate([fresh(9), x, fresh(40)]), [(31, 10)], 50) == []
    left, right = np.concatenate([run, fresh(20), x[:6]]), np.concatenate([run, fresh(20), x[:6]])
    assert C.passages(left, right, [(70, 70)], 50) == [(0, 51, 0, 51)]  # reached across the gap; only the exact part is similar enough


def test_texts_of_one_signature_meet_whatever_else_they_matched(spark, monkeypatch):
    """Every pair of different texts that agrees in a band and holds a passage there is linked, also where many texts share a notice."""
    rnd = random.Random(11)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    notice, texts = fresh(40), []
    for _ in range(60):
        texts.append(fresh(30) + notice + fresh(30))
    for _ in range(15):  # pairs that share the notice and words on one of its sides; a third text shares the other side with one of them
        left, right = fresh(14), fresh(14)
        texts += [fresh(20) + left + notice + fresh(25), fresh(25) + left + notice + right + fresh(9), fresh(22) + notice + right + fresh(16)]
    near = fresh(56)  # near passages that agree in one band at best
    for k in range(8):
        texts.append(fresh(20) + [f"x{k}" if i == 4 + 6 * k else w for i, w in enumerate(near)] + fresh(20))
    texts = [" ".join(t) for t in texts]
    seq = list(C.sequences([t.encode() for t in texts]))
    keys, anchors, owner, _ = C.signatures(seq, 46)
    want, groups = {}, {}
    for key, at, k in zip(keys.tolist(), anchors.tolist(), owner.tolist(), strict=True):
        groups.setdefault(key, []).append((k, at))
    for members in groups.values():
        for k, i in members:
            for m, j in members:
                if k < m and C.passages(seq[k], seq[m], [(i, j)], 50):
                    want.setdefault(k, k), want.setdefault(m, m)
                    lo, hi = sorted((want[k], want[m]))
                    want = {t: lo if c == hi else c for t, c in want.items()}
    monkeypatch.setattr(C, "BLOCK_TEXTS", 20, raising=False)
    monkeypatch.setattr(C, "BLOCK_PAIRS", 50, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in C.repeated_passages(docs).collect():
        got[r.doc_id] = min(r.first_id, got.get(r.doc_id, r.first_id))
    assert len(want) > 40 and got == want


def test_a_pair_that_no_middle_window_and_no_neighbour_meets_is_linked(spark, monkeypatch):
    """Forty texts share a notice, and every two of them a passage that goes on behind a changed word."""
    rnd = random.Random(3)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    notice, texts = fresh(40), []
    for _ in range(20):
        right = fresh(16)
        texts += [fresh(20) + notice + fresh(1) + right + fresh(20) for _ in range(2)]
    monkeypatch.setattr(C, "BLOCK_WINDOWS", 16, raising=False)
    monkeypatch.setattr(C, "COMPARED", 1000, raising=False)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, C.repeated_passages(docs).collect()))
    assert [r[::3] for r in found] == [(k, k - k % 2) for k in range(40)]
    assert {(s, e) for _, s, e, _ in found} == {(20, 77)}


@pytest.mark.parametrize("lengths", [(60, 80), (49, 30)])
def test_stretches_of_one_word_meet_at_their_ends(lengths):
    texts = [f"a{n} b{n} c{n} ".encode() + b"x " * n + f"d{n} e{n}".encode() for n in lengths]
    keys, at, owner, _ = C.signatures(list(C.sequences(texts * 5)), 46) if min(lengths) > 45 else C.signatures(list(C.sequences([t + b" f" * 30 for t in texts])), 46)
    own = [(int(k), int(p)) for k, p, o in zip(keys, at, owner, strict=True) if o == 0 and k % 2 == 0]
    assert {p for _, p in own} >= {3, 3 + lengths[0] - 14} and any(k % 2 for k in keys.tolist())


def test_empty_table(spark):
    assert C.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def second_round(texts, least=46):
    """Pairs of windows that the second round verifies where no two texts are linked."""
    keys, at, owner, context = C.signatures(list(C.sequences([" ".join(t).encode() for t in texts])), least)
    rows = pd.DataFrame({"sig": keys.view(np.int64), "one": 0, "two": 0, "block": 0, "fp": owner, "at": at.astype(np.int32), "context": context.view(np.int64), "label": owner})
    rows = rows[rows.sig % 2 == 0].sort_values("sig", kind="stable")
    return sum(b.num_rows for b in C._rest(least)(iter([pa.RecordBatch.from_pandas(rows, preserve_index=False)])))


def test_stretches_of_one_word_that_are_too_short_are_not_paired_in_full():
    rnd = random.Random(4)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    assert second_round([fresh(30) + ["the"] * rnd.randrange(26, 44) + fresh(30) for _ in range(80)]) < 40  # of 3160 pairs of texts
