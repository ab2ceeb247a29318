"""Growth counts against brute force on small random graphs."""

import random
from itertools import combinations, permutations

import pytest

from edgelift import api, registry
from edgelift.model import Graph, Query
from edgelift.operators import blocks, dense, growth, lists, matching, shared, walks
from edgelift.plans.order import all_orders
from edgelift.plans.query_graph import components

SHAPES = [
    Query("triangle", (0, 0, 1), ((0, 1), (1, 2), (0, 2))),
    Query("path", (0, 1, 0, 0), ((0, 1), (1, 2), (2, 3))),
    Query("double", (0, 0, 0, 0), ((0, 1), (1, 2), (2, 3))),
    Query("paw", (0, 1, 0, 0), ((0, 1), (1, 2), (0, 2), (2, 3))),
]


def data(seed: int, n: int = 9):
    rng = random.Random(seed)
    return {i: rng.randrange(2) for i in range(n)}, [e for e in combinations(range(n), 2) if rng.random() < 0.45]


def brute(labels, pairs, q: Query, edge_no: int, injective: bool = True):
    near = {frozenset(p) for p in pairs}
    out = {}
    b, t = q.edges[edge_no]
    spaces = permutations(labels, len(q.labels)) if injective else __import__("itertools").product(labels, repeat=len(q.labels))
    for f in spaces:
        if all(labels[x] == q.labels[u] for u, x in enumerate(f)) and all(frozenset((f[u], f[v])) in near for i, (u, v) in enumerate(q.edges) if i != edge_no) and frozenset((f[b], f[t])) not in near:
            out[f[b], f[t]] = out.get((f[b], f[t]), 0) + 1
    return out


def found(df):
    return {(r["head"], r["tail"]): r["inc_cnt"] for r in df.collect()}


@pytest.mark.parametrize("q", SHAPES, ids=lambda q: q.name)
def test_methods_agree_with_brute_force(spark, q):
    labels, pairs = data(len(q.name))
    g = Graph.in_memory(spark, labels, pairs).persist()
    for i in range(len(q.edges)):
        wanted = brute(labels, pairs, q, i)
        methods = [growth.joint, growth.look_ahead, growth.shrunk] if len(components(q.without(i))) == 1 else [growth.probe, growth.inclusion_exclusion]
        for method in methods:
            assert found(method(g, q, i)) == wanted, (method.__name__, i)
        k = min(3, len(wanted))
        if k:
            best = sorted(wanted.items(), key=lambda x: (-x[1], x[0]))[:k]
            assert found(methods[-1](g, q, i, k)) == dict(best)


def test_order_does_not_matter(spark):
    labels, pairs = data(3)
    g = Graph.in_memory(spark, labels, pairs).persist()
    q = SHAPES[3]
    counts = {matching.match(g, q, {0}, list(o)).agg({"m": "sum"}).first()[0] for o in all_orders(q)[:6]}
    assert len(counts) == 1


def test_total_growth_is_what_adding_the_edge_does(spark):
    labels, pairs = data(5, 7)
    q = SHAPES[0]
    g = Graph.in_memory(spark, labels, pairs).persist()

    def matches(edges):
        near = {frozenset(p) for p in edges}
        return sum(all(labels[x] == q.labels[u] for u, x in enumerate(f)) and all(frozenset((f[u], f[v])) in near for u, v in q.edges) for f in permutations(labels, 3))

    before = matches(pairs)
    wanted = {(u, v): matches([*pairs, (u, v)]) - before for u, v in combinations(labels, 2) if (u, v) not in pairs}
    assert {(r["u"], r["v"]): r["growth"] for r in growth.total_growth(g, q).collect()} == {k: n for k, n in wanted.items() if n}


def test_bounds_hold(spark):
    labels, pairs = data(11)
    q = SHAPES[2]
    g = Graph.in_memory(spark, labels, pairs).persist()
    wanted = brute(labels, pairs, q, 1)
    for r in growth.bounds(g, q, 1).collect():
        assert r["lower"] <= wanted.get((r["head"], r["tail"]), 0) <= r["upper"]


def test_bounds_form_pairs_in_tasks(spark, monkeypatch):
    """All pairs that are not adjacent, by ranges of ends, and no join of pairs."""
    labels, pairs = data(11, 16)
    q = SHAPES[2]
    g = Graph.in_memory(spark, labels, pairs).persist()
    monkeypatch.setattr(blocks, "ENDS", 3)
    got = growth.bounds(g, q, 1)
    assert "NestedLoop" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "LeftAnti" not in plan
    near = {x: {b if a == x else a for a, b in pairs if x in (a, b)} for x in labels}
    zero = [x for x in labels if labels[x] == 0]
    ends = {x: [y for y in zero if y in near[x]] for x in zero}
    uses = {x: {x: len(ends[x])} | dict.fromkeys(ends[x], 1) for x in zero}
    wanted = sorted((x, y, max(0, (u := len(ends[x]) * len(ends[y])) - sum(n * uses[y].get(v, 0) for v, n in uses[x].items())), u) for x in zero for y in zero if x != y and y not in near[x] and ends[x] and ends[y])
    assert wanted and sorted(map(tuple, got.collect())) == wanted


def test_front_door(spark):
    labels, pairs = data(2)
    g = Graph.in_memory(spark, labels, pairs).persist()
    out = api.perturb(g, SHAPES[3], k=2)
    assert out.columns == ["query", "edge_no", "q_begin", "q_end", "head", "tail", "inc_cnt"]
    assert out.filter("edge_no = 3").count() <= 2
    with pytest.raises(ValueError):
        api.method_for(SHAPES[3], 3, "joint")
    with pytest.raises(TimeoutError):
        api.with_time_limit(lambda f: f.foreach(lambda _: __import__("time").sleep(60)), g.vertices, 1)


def test_empty_label_pair_gives_an_empty_answer(spark):
    g = Graph.in_memory(spark, {0: 0, 1: 1}, [(0, 1)])
    assert growth.joint(g, Query("none", (5, 6, 5), ((0, 1), (1, 2), (0, 2))), 0).count() == 0


def brute_core(pairs, k):
    while True:
        near = {}
        for u, v in pairs:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
        left = [(u, v) for u, v in pairs if min(len(near[u]), len(near[v])) >= k]
        if len(left) == len(pairs):
            return set(near)
        pairs = left


def brute_truss(pairs, k):
    while True:
        near = {}
        for u, v in pairs:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
        left = [(u, v) for u, v in pairs if len(near[u] & near[v]) >= k]
        if len(left) == len(pairs):
            return set(pairs)
        pairs = left


def test_cores_and_trusses(spark):
    labels, pairs = data(11, 12)
    # a square and a pendant chain, in no triangle, and two triangles on one edge, whose other edges are on one
    pairs = [*pairs, (12, 13), (13, 14), (14, 15), (12, 15), (15, 16), (16, 17), (18, 19), (18, 20), (19, 20), (18, 21), (19, 21)]
    g = Graph.in_memory(spark, labels | {i: 0 for i in range(12, 22)}, pairs).persist()
    assert brute_truss(pairs, 1) < set(pairs) and brute_truss(pairs, 2) and brute_truss(pairs, 2) < brute_truss(pairs, 1)
    for k in (1, 2, 3):
        assert sorted(map(tuple, dense.k_truss(g, k).select("u", "v").collect())) == sorted(brute_truss(pairs, k))
        assert sorted(r["id"] for r in dense.k_core(g, k).collect()) == sorted(brute_core(pairs, k))


def test_truss_query_has_work(spark):
    assert registry.queries()["truss_data"](spark, "/root/testdata/sf0.001").count() > 0


def test_rwdw_estimates(spark):
    labels, pairs = data(4)
    g = Graph.in_memory(spark, labels, pairs).persist()
    wanted = brute(labels, pairs, SHAPES[1], 1)
    got = found(walks.rwdw(g, SHAPES[1], 1, samples=20_000))
    assert wanted and set(got) == set(wanted)
    assert all(abs(got[p] - n) <= 1 + 0.15 * n for p, n in wanted.items())


def test_hash_plans(spark):
    g = Graph.in_memory(spark, {0: 0, 1: 1, 2: 1, 3: 1}, [(0, 1), (0, 2), (1, 2), (2, 3)])
    q = Query("tri", (0, 1, 1), ((0, 1), (1, 2), (0, 2)))
    found = sorted(map(tuple, matching.hash_plan(g, q, "[[0, 1], 2]").collect()))
    assert found == sorted(map(tuple, matching.match_rows(g, q).collect())) == [(0, 1, 2), (0, 2, 1)]
    assert matching.match_rows(g, q, limit=1).count() == 1
    assert [tuple(r) for r in matching.depth_counts(g, q, [0, 1, 2]).orderBy("depth").collect()] == [(0, 0, 1), (1, 1, 2), (2, 2, 2)]
    with pytest.raises(ValueError, match="every query edge"):
        matching.hash_plan(g, q, [0, 1])
    with pytest.raises(ValueError, match="common"):
        matching.hash_plan(g, Query("far", (0, 1, 1, 1), ((0, 1), (1, 2), (2, 3))), [[0, 2], 1])


def test_limit_covers_planning(spark):
    def planning():
        spark.range(10**6).foreach(lambda _: __import__("time").sleep(60))

    with pytest.raises(TimeoutError):
        api.within(spark, 1, planning)


def test_ties_at_the_threshold_form_few_pairs(spark):
    # 200 x 200 pairs of one count: only those before the k-th best are formed
    pairs = [(i, 200 + i) for i in range(200)] + [(200 + i, 400) for i in range(200)]
    g = Graph.in_memory(spark, {i: min(i // 200, 2) for i in range(401)}, pairs).persist()
    q = Query("ties", (0, 1, 2), ((0, 1), (1, 2)))
    near, wanted = set(pairs), sorted((x, y, 1) for x in range(200) for y in range(200, 400))
    wanted = [w for w in wanted if w[:2] not in near][:5]
    assert growth._reaching(growth.Split(g, q, 0), 5)[0].count() <= 64
    for method in (growth.inclusion_exclusion, growth.probe):
        assert [tuple(r) for r in method(g, q, 0, 5).select("head", "tail", "inc_cnt").collect()] == wanted


def test_perturb_prunes_ties(spark, monkeypatch):
    pairs = [(i, 100 + i) for i in range(100)] + [(100 + i, 200) for i in range(100)]
    g = Graph.in_memory(spark, {i: min(i // 100, 2) for i in range(201)}, pairs).persist()
    formed = []
    monkeypatch.setattr(growth.Split, "exact", lambda s, p, ends=None, f=growth.Split.exact: formed.append(p.count()) or f(s, p, ends))
    found = api.perturb(g, Query("ties", (0, 1, 2), ((0, 1), (1, 2))), 0, k=5).select("head", "tail", "inc_cnt").collect()
    assert [tuple(r) for r in found] == [(0, y, 1) for y in range(101, 106)]
    assert max(formed) <= growth.PROBED**2 and formed[-1] <= growth.PROBED


@pytest.mark.parametrize("q", [*SHAPES, Query("k4e", (0, 1, 0, 1), ((0, 1), (1, 2), (0, 2), (0, 3), (2, 3)))], ids=lambda q: q.name)
def test_threshold_before_the_last_end(spark, q):
    labels, pairs = data(7, 10)
    g = Graph.in_memory(spark, labels, pairs).persist()
    for i in range(len(q.edges)):
        if len(components(q.without(i))) > 1:
            continue
        wanted = brute(labels, pairs, q, i)
        best = [(*p, n) for p, n in sorted(wanted.items(), key=lambda x: (-x[1], x[0]))]
        for k in (1, 3):
            for method in (growth.joint, growth.look_ahead):
                assert [(r["head"], r["tail"], r["inc_cnt"]) for r in method(g, q, i, k, wide=0).collect()] == best[:k]
        ends = spark.createDataFrame([*wanted, *pairs], "head long, tail long")
        assert found(growth.growth_of(g, q, i, ends)) == wanted


_SIX = [
    Query("k4e", (0, 1, 0, 1), ((0, 1), (1, 2), (0, 2), (0, 3), (2, 3))),
    Query("same", (0, 0, 0), ((0, 1), (1, 2), (0, 2))),
    Query("square", (0, 0, 1, 1), ((0, 1), (1, 2), (2, 3), (0, 3))),
    Query("five", (0, 1, 0, 1, 0), ((0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (1, 4), (1, 3))),
]


@pytest.mark.parametrize("q", _SIX, ids=lambda q: q.name)
def test_look_ahead_by_lists(spark, monkeypatch, q):
    """A task has all pairs of a first end."""
    labels, pairs = data(20, 10)
    labels, pairs = {i - 4: x for i, x in labels.items()} | {40: 0, 41: 1}, [(a - 4, b - 4) for a, b in pairs] + [(40, 41)]
    g = Graph.in_memory(spark, labels, pairs).persist()
    monkeypatch.setattr(shared, "RANGE", 40)
    monkeypatch.setattr(shared, "SPARSE", 1000)
    monkeypatch.setattr(blocks, "MARKS", 200)
    i, order = next((i, list(o)) for i in range(len(q.edges)) for o in all_orders(q.without(i)) if {o[0], o[-1]} == set(q.edges[i]) and brute(labels, pairs, q, i))
    fan = {(u, v): 1.0 for u in range(len(q.labels)) for v in range(len(q.labels))}
    monkeypatch.setattr(blocks, "WEDGES", 7)
    wanted = brute(labels, pairs, q, i)
    assert found(lists.growth(g, q.without(i), order, *q.edges[i], None, True, fan)) == wanted
    best = [(*p, n) for p, n in sorted(wanted.items(), key=lambda x: (-x[1], x[0]))][:3]
    assert [tuple(r) for r in growth.top_k(lists.growth(g, q.without(i), order, *q.edges[i], 3, True, fan), 3).collect()] == best


def test_look_ahead_query_shuffles_no_matches(spark):
    plan = registry.queries()["crq_lookahead_k4e"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan
