import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervalis.llm import cover_top_k, prefix_forest
from intervalis.llm import _vectors as V


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, grp int").repartition(3)


def rows_of(seed, n, width, clusters):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((clusters, width))
    out = [(int(i), (centres[i % clusters] + 0.3 * rnd.standard_normal(width)).astype(np.float32).tolist()) for i in range(n)]
    same = out[1][1]
    out += [(1000 + i, same) for i in range(40)]  # copies, and so ties
    out += [(2000, None), (2001, [float("nan")] * width), (2002, [None] * width), (2003, [float("inf")] + [0.0] * (width - 1)), (None, same), (1010, same), (1010, same), (2004, [0.0] * width)]
    return out


def used(rows, nonzero=False):
    return [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (any(v) or not nonzero)]


@pytest.mark.parametrize(("width", "clusters", "scale"), [(4, 5, 256), (16, 1, 256), (3, 30, 1), (8, 4, 1 << 40)])
def test_top_k_equals_brute_force(spark, monkeypatch, width, clusters, scale):
    rows = rows_of(width, 500, width, clusters)
    monkeypatch.setattr(V, "DATA_ROWS", 90)
    monkeypatch.setattr(V, "QUERY_ROWS", 7)
    found = cover_top_k.top_k_products(table(spark, rows), F.col("id") % 20 == 0, k=5, scale=scale).collect()
    want = brute([(i, np.float32(v).tolist()) for i, v in used(rows)], lambda i: i % 20 == 0, 5, scale)
    if scale < 1 << 40:
        assert sorted(tuple(r) for r in found) == want
    else:  # products beyond 2^63 wrap
        assert len(found) == len(want)


def test_rows_that_share_an_id_are_all_candidates(spark):
    rows = [(0, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [5.0, 0.0]), (8, [2.0, 0.0]), (0, [3.0, 0.0]), (7, [5.0, 0.0])]
    found = cover_top_k.top_k_products(table(spark, rows), F.col("id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, lambda i: i % 50 == 0)
    assert max(r.score for r in found if r.rank == 1) == 3 * 5 * 65536 and len(found) == 10
    near = [tuple(r) for r in prefix_forest.nearest(table(spark, rows), F.col("id") % 50 == 0, k=3).collect()]
    assert sorted(near) == [(0, 1, 7, 0.0), (0, 1, 8, 1.0), (0, 2, 0, 2.0), (0, 2, 8, 1.0), (0, 3, 0, 2.0), (0, 3, 7, 2.0)]


def brute(rows, is_query, k=5, scale=256):
    """Every row with an id of the query set is a query; all other rows are candidates, those of its id too."""
    ints = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v in rows]
    out = []
    for n, (q, own) in enumerate(ints):
        if not is_query(q):
            continue
        scores = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for m, (i, v) in enumerate(ints) if m != n)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_a_lone_outlier_is_found_by_queries_far_from_their_centre(spark):
    rnd = np.random.default_rng(5)
    order = [r.id for r in spark.range(1, 40).orderBy(F.xxhash64("id"), "id").collect()]  # the first one is centre 0
    near, asked, out = order[:10], order[10:16], order[16]
    rows = [(i, [10.0, 5.0]) for i in near]
    rows += [(i, (np.array([6.0, 12.0]) + rnd.uniform(-0.3, 0.3, 2)).tolist()) for i in asked] + [(out, [-20.0, 50.0])]
    found = sorted(tuple(r) for r in cover_top_k.top_k_products(table(spark, rows), F.col("id").isin(asked)).collect())
    assert found == brute(rows, lambda i: i in asked) and all(r[2] == out for r in found if r[1] == 1)


@pytest.mark.parametrize("query_rows", [7, 1024])
def test_more_spread_groups_than_centres_equal_brute_force(spark, monkeypatch, query_rows):
    rnd = np.random.default_rng(8)
    spots = rnd.standard_normal((60, 3)) * rnd.uniform(1, 60, (60, 1))
    rows = [(int(i), (spots[i % 60] + 0.2 * rnd.standard_normal(3)).tolist()) for i in range(600)]
    monkeypatch.setattr(V, "DATA_ROWS", 90)
    monkeypatch.setattr(V, "QUERY_ROWS", query_rows)
    found = cover_top_k.top_k_products(table(spark, rows), F.col("id") % 11 == 0).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, lambda i: i % 11 == 0)


def test_cover_tree_invariants():
    rnd = np.random.default_rng(1)
    points = np.concatenate([rnd.standard_normal((400, 2)) * 0.01 + rnd.standard_normal(2) for _ in range(8)])
    root, open_, nodes = cover_top_k.cover_tree(points), [], 0
    open_.append(root)
    while open_:
        node = open_.pop()
        nodes += 1
        assert np.linalg.norm(points[node.members] - node.centre, axis=1).max() <= node.radius + 1e-12
        if node.children:
            assert np.array_equal(np.sort(np.concatenate([c.members for c in node.children])), np.sort(node.members))
            assert np.array_equal(node.children[0].centre, node.centre)
            for j, c in enumerate(node.children):
                assert c.radius <= node.radius / 2 + 1e-12
                assert all(np.linalg.norm(c.centre - o.centre) > node.radius / 2 for o in node.children[:j])
        open_ += node.children
    assert nodes > 20


def test_node_bound_holds():
    rnd = np.random.default_rng(3)
    x, y = rnd.standard_normal((300, 6)), rnd.standard_normal((300, 6)) * 3
    a, b = cover_top_k.Node(x, np.arange(300)), cover_top_k.Node(y, np.arange(300))
    assert (x @ y.T).max() <= cover_top_k.upper_bound(a, b)


@pytest.mark.parametrize(("width", "clusters"), [(16, 8), (48, 1)])
def test_neighbours_recall_and_scores(spark, monkeypatch, width, clusters):
    rows = rows_of(width + 100, 1500, width, clusters)
    monkeypatch.setattr(V, "DATA_ROWS", 400)
    found = prefix_forest.nearest(table(spark, rows), F.col("id") % 20 == 0, k=10).collect()
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in used(rows, nonzero=True)]
    hits = total = repeated = 0
    for n, (q, own) in enumerate(good):
        if q % 20:
            continue
        if sum(i == q for i, _ in good) > 1:  # queries that share an id can't be told apart in the result
            repeated += 1
            continue
        exact = sorted((float(np.sqrt(((v - own) ** 2).sum())), i) for m, (i, v) in enumerate(good) if m != n)
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(any(m[2] == pytest.approx(float(np.sqrt(((v - own) ** 2).sum())), rel=1e-12) for i, v in good if i == m[1]) for m in mine)
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hits += sum(m[2] <= exact[9][0] + 1e-12 for m in mine)
        total += 10
    assert len(found) == total + 10 * repeated and hits / total >= 0.9


def test_few_rows_and_empty(spark):
    one = table(spark, [(0, [1.0, 2.0])])
    assert cover_top_k.top_k_products(one, F.col("id") % 50 == 0).count() == 0 == prefix_forest.nearest(one, F.col("id") % 50 == 0).count()
    few = table(spark, [(0, [1.0, 2.0]), (1, [1.0]), (3, [])])
    assert [tuple(r)[:3] for r in cover_top_k.top_k_products(few, F.col("id") % 50 == 0).collect()] == [(0, 1, 1), (0, 2, 3)]
    assert [r.vec_id for r in prefix_forest.nearest(few, F.col("id") % 50 == 0).collect()] == [1]
    empty = one.filter("vec_id < 0")
    assert cover_top_k.top_k_products(empty, F.lit(True)).count() == 0 == prefix_forest.nearest(empty, F.lit(True)).count()
