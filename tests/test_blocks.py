"""Triangles by blocks, kept edges and counts by summing out, against brute force."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from edgelift import fixtures, registry
from edgelift.model import Graph, Query
from edgelift.operators import blocks, dense, matching, scans, shared


def near_graph(groups, size, p, seed, more=0):
    """Groups of ids without edges between them, and some edges anywhere."""
    rng = random.Random(seed)
    pairs = {(g * size + a, g * size + b) for g in range(groups) for a, b in combinations(range(size), 2) if rng.random() < p}
    return sorted(pairs | {tuple(sorted(rng.sample(range(groups * size), 2))) for _ in range(more)})


def triangles_of(pairs):
    known, after = set(pairs), {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    return [(a, b, c) for a, b in known for c in after.get(b, ()) if (a, c) in known]


def made(spark, pairs):
    return Graph.in_memory(spark, dict.fromkeys({x for p in pairs for x in p}, 0), pairs).persist()


@pytest.mark.parametrize(("groups", "more", "closed"), [(10, 0, True), (10, 60, False), (1, 0, False)])
def test_dense_parts(spark, monkeypatch, groups, more, closed):
    monkeypatch.setattr(blocks, "FEW", 60)
    pairs = near_graph(groups, 120 // groups, 0.5 if groups > 1 else 0.15, 3, more)
    wide = 1 if closed else 2**33  # ids beyond 32 bits, from negative ones on
    pairs = [(a * wide - 5, b * wide - 5) for a, b in pairs]
    g, wanted = made(spark, pairs), triangles_of(pairs)
    assert blocks.spread(g)[1] == closed
    assert sorted(map(tuple, dense.triangles(g).collect())) == sorted(wanted)
    on = Counter(e for a, b, c in wanted for e in ((a, b), (a, c), (b, c)))
    assert {(r[0], r[1]): r[2] for r in dense.triangle_support(g).collect()} == on
    inside = set(wanted)
    cliques = [(a, b, c, d) for a, b, c in wanted for d in {t[2] for t in inside if t[:2] == (b, c)} if {(a, b, d), (a, c, d)} <= inside]
    held = Counter(t for q in cliques for t in combinations(q, 3))
    assert {tuple(r[:3]): r[3] for r in dense.four_clique_counts(g).collect()} == held
    left = set(pairs)
    while gone := left - {e for e, n in Counter(e for a, b, c in triangles_of(left) for e in ((a, b), (a, c), (b, c))).items() if n >= 3}:
        left -= gone
    assert {tuple(r) for r in dense.k_truss(g, 3).collect()} == left


def test_no_wedge_is_shuffled(spark):
    g = made(spark, near_graph(10, 12, 0.5, 3))
    plan = dense.triangle_support(g)._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert "Join" not in plan


def test_small_memory_steps(spark, monkeypatch):
    import numpy as np

    pairs = near_graph(1, 60, 0.4, 5)
    u, v = (np.array(x) for x in zip(*pairs, strict=True))
    monkeypatch.setattr(blocks, "WEDGES", 7)
    monkeypatch.setattr(blocks, "MARKS", 100)
    ids, x, y, (xy, yw, xw) = blocks.found(u, v)
    assert sorted(tuple(sorted(t)) for t in zip(ids[x[xy]], ids[y[xy]], ids[y[yw]], strict=True)) == sorted(triangles_of(pairs))
    assert (x[xw] == x[xy]).all() and (y[xw] == y[yw]).all()


def test_no_edges(spark):
    g = Graph.in_memory(spark, {0: 0, 1: 0}, [(0, 0)])
    assert [f(g).count() for f in (dense.triangles, dense.triangle_support, dense.four_clique_counts, dense.k_truss)] == [0, 0, 0, 0]


def test_edges_are_kept_once(spark):
    for kind in ("het", "cop"):
        g = fixtures.graph(spark, "/root/testdata/sf0.001", kind)
        assert g.edges.filter("src < dst").count() * 2 == g.edges.count() == g.edges.distinct().count()
        assert g.edges.exceptAll(g.edges.select(F.col("dst"), F.col("src"), F.col("dst_label"), F.col("src_label"))).count() == 0
        tree = g.edges._jdf.queryExecution().withCachedData().toString()
        assert tree.count("InMemoryRelation") == 2 and "Generate" not in tree.split("InMemoryRelation")[0]


def test_counts_sum_vertices_out(spark):
    """In a cycle of four labels, no rows over both neighbours of a vertex with many of each are made."""
    rng = random.Random(2)
    pairs = [(0, i) for i in range(1, 41)] + [(0, i) for i in range(41, 81)] + [(rng.randrange(1, 41), 81 + i % 9) for i in range(90)] + [(rng.randrange(41, 81), 81 + i % 9) for i in range(90)]
    labels = {i: 0 if i == 0 else 1 if i < 41 else 2 if i < 81 else 3 for i in range(90)}
    g, q = Graph.in_memory(spark, labels, pairs).persist(), Query("c4", (0, 1, 3, 2), ((0, 1), (1, 2), (2, 3), (0, 3)))
    wanted = [tuple(r) for r in g.edges.sparkSession.createDataFrame([(i, matching.count_matches(g, q.induced(list(range(i + 1)))[0]).first()[0]) for i in range(4)], "i int, n long").collect()]
    got = matching.depth_counts(g, q, [0, 1, 2, 3])
    assert sorted((r["depth"], r["partial"]) for r in got.collect()) == wanted
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("side", "wedges"), [(7, 50), (1000, 50), (1000, 2_000_000)])
def test_common_neighbours(spark, monkeypatch, side, wedges):
    monkeypatch.setattr(blocks, "SIDE", side)
    monkeypatch.setattr(blocks, "WEDGES", wedges)
    monkeypatch.setattr(blocks, "BATCH", 10)
    pairs = [(a * 2**33 - 5, b * 2**33 - 5) for a, b in near_graph(6, 10, 0.4, 5, 20)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    wanted = {(a, b): n for a, b in combinations(sorted(near), 2) if (n := len(near[a] & near[b]))}
    got = scans.common_neighbours(made(spark, pairs), 0).collect()
    assert len(got) == len(wanted) and {(r["head"], r["tail"]): r["n"] for r in got} == wanted
    assert not scans.common_neighbours(made(spark, pairs), 3).collect()


def test_set_intersect_forms_no_pairs(spark):
    plan = registry.queries()["set_intersect"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_file(spark, monkeypatch, seed):
    """A graph in one piece, dense ids: without a shuffle of triangles."""
    monkeypatch.setattr(blocks, "FEW", 60)
    monkeypatch.setattr(blocks, "WEDGES", 40)
    monkeypatch.setattr(blocks, "MARKS", 400)
    monkeypatch.setattr(shared, "RANGE", 50)
    pairs = [(a - 7, b - 7) for a, b in near_graph(8, 12, 0.6, seed, 70)]
    g, three = made(spark, pairs), triangles_of(pairs)
    known = set(pairs)
    assert shared.near(g) is not None and not blocks.spread(g)[1]
    support = Counter(p for t in three for p in combinations(sorted(t), 2))
    got = dense.triangle_support(g)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((*p, n) for p, n in support.items())
    cliques = Counter(t for a, b, c in (sorted(t) for t in three) for d in {y for x, y in known if x == c} if (a, d) in known and (b, d) in known for t in combinations((a, b, c, d), 3))
    assert sorted(map(tuple, dense.four_clique_counts(g).collect())) == sorted((*t, n) for t, n in cliques.items())
    for k in (1, 2, 3):
        left, now = set(pairs), None
        while left != now:
            now = left
            n = Counter(p for t in triangles_of(sorted(now)) for p in combinations(sorted(t), 2))
            left = {p for p in now if n[p] >= k}
        assert sorted(map(tuple, dense.k_truss(g, k).collect())) == sorted(left)
