import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from intervalis.llm import prefix_trie as T
from intervalis.llm.queries import rebuilt_paths

SCHEMA = "conv_id long, turn long, role string, text string, id int, path string, d string"


def brute(rows):
    """Nodes by plain dictionaries of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        built[c] = own.get(base, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += children[p] == 0
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = {p: ",".join(str(c) for c in cs if len(built[c]) == len(p)) for p, cs in members.items()}
    return sorted((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, cs in members.items())


def digest(role, text):
    r, t = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(r)).encode() + b":" + r + t).digest()[:16]


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "p", "d") for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in T.prefix_trie(rebuilt_paths(df)).collect())


def conversations(rnd, n):
    words = ["a", "b", "é", "x" * 40, "", None]
    return [(c, t if rnd.random() < 0.95 else None, rnd.choice(["user", "bot", None]), rnd.choice(words) if t < 3 else f"w{rnd.randrange(3)}") for c in range(n) for t in range(rnd.choice([0, 1, 2, 3, 5, 9, 12]))]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = conversations(rnd, 400)
    rows += [(None, 0, "user", "lost"), (-7, 0, "user", "neg"), (-5, 0, "user", "base"), (-5, 1, None, None), rows[3], rows[3]]
    rows += [(5000 + 5 * k, t, "user", f"same {t}") for k in range(150) for t in range(4)]  # one conversation, many times
    rows += [(9000, t, "user", f"long {t}") for t in range(3000)] + [(9001, t, "user", f"long {t}") for t in range(9, 2500)]
    rnd.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_many_runs_chunks_and_ranges(spark, monkeypatch):
    """Small bounds: every range has several runs, and lists of ids are cut into chunks."""
    rnd = random.Random(9)
    rows = conversations(rnd, 200) + [(5 * k, 0, "user", "one turn") for k in range(2000, 2300)]
    want = brute(rows)
    df = spark.createDataFrame([(*r, 1, "p", "d") for r in rows], SCHEMA)
    for runs, ids in ((3, 2), (40, 7)):
        monkeypatch.setattr(T, "RUN_TURNS", runs)
        monkeypatch.setattr(T, "CHUNK_IDS", ids)
        monkeypatch.setattr(T, "RANGE_TURNS", 60)
        assert sorted(tuple(r) for r in T.prefix_trie(rebuilt_paths(df)).collect()) == want


def test_fold_and_chunks_in_one_process():
    names = [b"a"] * 3 + [b"b"] * 2 + [b"c"] * 11 + [b"d"] + [b"e"] * 2
    ids = list(range(len(names)))
    batches = [pa.RecordBatch.from_pydict({"name": names[k : k + 5], "id": ids[k : k + 5], "ds": [[n] for n in names[k : k + 5]], "bs": [[1]] * len(names[k : k + 5])}) for k in range(0, len(names), 5)]
    once = [r for b in T._folded(4)(iter(batches)) for r in b.to_pylist()]
    done, late = [r for r in once if r["ends"]], [r for r in once if not r["ends"]]
    assert {r["name"] for r in done} == {b"b", b"d"} and max(r["n"] for r in late) == 4
    late.sort(key=lambda r: (r["name"], r["least"]))
    done += [r for b in T._hashed(iter([pa.RecordBatch.from_pylist(late[k : k + 2], T._DISTINCT) for k in range(0, len(late), 2)])) for r in b.to_pylist()]
    for r in done:
        own = [i for i, n in zip(ids, names, strict=True) if n == r["name"]]
        assert (r["n"], r["least"], r["ds"]) == (len(own), own[0], [r["name"]]) and r["ends"] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
    assert len(done) == 5


def test_loser_tree_sorts_and_spares_comparisons():
    rnd = random.Random(2)
    keys = sorted({b"".join(bytes([rnd.randrange(3)]) * T.WIDE for _ in range(rnd.randrange(12))) for _ in range(600)})
    for k in (1, 2, 5, 16, 33):
        runs = [sorted(rnd.sample(keys, 40) if k > 20 else keys[r::k]) for r in range(k)]
        tree = T.LoserTree([(r, [0, *(T.shared(a, b) for a, b in zip(r, r[1:]))]) for r in runs])
        out = [(runs[r][pos], lcp) for r, pos, lcp in tree]
        assert [x for x, _ in out] == sorted(x for r in runs for x in r)
        assert all(lcp == T.shared(a, b) for (a, _), (b, lcp) in zip(out, out[1:]))
        assert tree.compared <= len(out) * max(1, tree.leaves.bit_length() - 1)


@pytest.mark.parametrize("cuts", [[1], [2, 3], [1, 2, 3, 4, 5, 6], [4]])
def test_ranges_add_up(cuts):
    """A trie cut into ranges at any keys: sums of the parts' counts equal the whole's."""
    a, b, c = (bytes([k]) * T.WIDE for k in (1, 2, 3))
    keys = sorted([b"", a, a + b, a + b + c, a + c, b + b, b + b + a])
    rows = [(k, 0, 1, i, None, [10] * (len(k) // T.WIDE)) for i, k in enumerate(keys)]

    def of(part, before, after):
        out, last = [], None
        for r in part:
            out.append((r[0], 0 if last is None else T.shared(last, r[0]), *r[2:]))
            last = r[0]
        return list(T.finished(iter(out), before, after, 0))

    whole = of(rows, None, None)
    parts = [rows[x:y] for x, y in zip([0, *cuts], [*cuts, len(rows)])]
    got = [r for k, p in enumerate(parts) for r in of(p, parts[k - 1][-1][0] if k else None, parts[k + 1][0][0] if k + 1 < len(parts) else None)]
    summed = defaultdict(lambda: [10**9, 0, 0, 0, 0, 0])
    for r in (r for r in got if r[1] is not None):
        s = summed[r[1], r[4]]
        s[0] = min(s[0], r[3])
        for k in range(5):
            s[k + 1] += r[6 + k]
    final = [(r[3], r[4], *r[6:11]) for r in got if r[1] is None] + [(s[0], depth, *s[1:]) for (_, depth), s in summed.items()]
    assert sorted(final) == sorted((r[3], r[4], *r[6:11]) for r in whole)


def test_empty_table(spark):
    assert T.prefix_trie(rebuilt_paths(spark.createDataFrame([], SCHEMA))).count() == 0
    assert found(spark, [(None, 1, "user", "x")]) == []
    # a conversation of one turn that gives it away has none
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    assert found(spark, [(c, 0, "user", "x")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
