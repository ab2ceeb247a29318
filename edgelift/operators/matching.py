"""Subgraph matching as a chain of joins.

A match binds one query vertex after the other.  A new vertex is reached along
one earlier neighbour and checked against the others by semi joins; vertices
of one label must differ.  Matches carry a multiplicity: as soon as a bound
vertex is no longer asked for (no open edge, no later vertex of its label, not
an output), it is dropped and equal rows are added up, so that intermediate
results stay near the size of what is still open.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelift.model import Graph, Query
from edgelift.plans.order import Plan, best_order

from .statistics import fans

#: Rows, about, up to which a relation is sent to all executors when matches are counted.
LOOKUP = 1_000_000


def name(u: int) -> str:
    return f"v{u}"


def relation(g: Graph, q: Query, a: int, b: int, sets: dict[int, DataFrame] | None = None) -> DataFrame:
    """Edges between the labels of query vertices a and b, as columns of theirs, within candidate sets if given."""
    out = g.pair(q.labels[a], q.labels[b]).select(F.col("src").alias(name(a)), F.col("dst").alias(name(b)))
    for u in (a, b):
        if sets and u in sets:
            out = out.join(sets[u].select(F.col("id").alias(name(u))), name(u), "left_semi")
    return out


def match(
    g: Graph,
    q: Query,
    keep: set[int] | None = None,
    order: list[int] | None = None,
    injective: bool = True,
    sets: dict[int, DataFrame] | None = None,
    absent: tuple[int, int] | None = None,
    start: DataFrame | None = None,
    fan: dict[tuple[int, int], float] | None = None,
) -> DataFrame:
    """Matches as columns v0, v1, ... of the query vertices in ``keep`` (all by default) and multiplicity m.

    absent: a pair of query vertices whose images must not be adjacent; the
    anti join stands right after both are bound.  sets: candidates by query
    vertex (column id).  start: bindings of the order's first vertices, with m.
    fan: average choices (``statistics.fans``); a vertex is then reached from where it has fewest.
    """
    plan = Plan(q, tuple(order or best_order(q)))
    keep = set(range(len(q.labels))) if keep is None else set(keep)
    bound: list[int] = []
    rows = start
    if start is not None:
        bound = [u for u in plan.order if name(u) in start.columns]
    for depth, u in enumerate(plan.order):
        if u in bound:
            continue
        back = plan.backward(depth)
        back = sorted(back, key=lambda w: fan[w, u]) if fan else back
        if rows is None and len(plan.order) == 1:
            rows = g.of_label(q.labels[u]).select(F.col("id").alias(name(u)))
            if sets and u in sets:
                rows = rows.join(sets[u].select(F.col("id").alias(name(u))), name(u), "left_semi")
            rows = rows.withColumn("m", F.lit(1).cast("long"))
        elif rows is None and depth == 0:
            bound.append(u)  # the first two vertices are read as one relation
            continue
        elif not back:
            raise ValueError("the order has a prefix that is not connected")
        elif rows is None:
            rows = relation(g, q, plan.order[0], u, sets).withColumn("m", F.lit(1).cast("long"))
        else:
            rows = rows.join(relation(g, q, back[0], u, sets), name(back[0]))
            same = [w for w in bound if q.labels[w] == q.labels[u] and name(w) in rows.columns] if injective else []
            for w in same:
                rows = rows.filter(F.col(name(w)) != F.col(name(u)))
        back = back[1:]
        for b in back:
            rows = rows.join(relation(g, q, b, u), [name(b), name(u)], "left_semi")
        bound.append(u)
        if absent and u in absent and set(absent) <= set(bound):
            known = g.pair(q.labels[absent[0]], q.labels[absent[1]]).select(F.col("src").alias(name(absent[0])), F.col("dst").alias(name(absent[1])))
            rows = rows.join(known, [name(absent[0]), name(absent[1])], "left_anti")
        rows = _narrow(rows, plan, depth, keep, injective, absent)
    return rows.select(*(name(u) for u in sorted(keep)), "m")


def needed(plan: Plan, depth: int, keep: set[int], injective: bool, absent: tuple[int, int] | None) -> set[int]:
    """Bound vertices that are still asked for after ``depth``."""
    q, later = plan.query, plan.order[depth + 1 :]
    out = set()
    for w in plan.order[: depth + 1]:
        open_edge = any(v in later for v in q.neighbours(w))
        same_label = injective and any(q.labels[v] == q.labels[w] for v in later)
        open_pair = absent and w in absent and any(v in later for v in absent)
        if w in keep or open_edge or same_label or open_pair:
            out.add(w)
    return out


def _narrow(rows: DataFrame, plan: Plan, depth: int, keep: set[int], injective: bool, absent) -> DataFrame:
    wanted = [name(u) for u in plan.order[: depth + 1] if u in needed(plan, depth, keep, injective, absent)]
    if len(wanted) == len(rows.columns) - 1:
        return rows
    return rows.groupBy(*wanted).agg(F.sum("m").alias("m"))


def count_matches(g: Graph, q: Query, injective: bool = True, **options) -> DataFrame:
    """One row: how many matches the query has."""
    found = match(g, q, {best_order(q)[0]}, injective=injective, **options)
    return found.agg(F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("matches"))


def match_rows(g: Graph, q: Query, injective: bool = True, limit: int | None = None) -> DataFrame:
    """Every match, one row each; no more than ``limit``, if given."""
    rows = match(g, q, injective=injective).drop("m")
    return rows if limit is None else rows.limit(limit)


def sums_out(q: Query) -> bool:
    """Whether vertices of one label are told apart by the query's edges alone, so that any vertex can be summed out at any time."""
    n = len(q.labels)
    return all(q.labels[u] != q.labels[v] or v in q.neighbours(u) for u in range(n) for v in range(u + 1, n))


def summed(g: Graph, q: Query, fan: dict[tuple[int, int], float], sizes: dict[tuple[int, int], int]) -> DataFrame:
    """One row, ``m``: how many matches there are, by summing out one vertex after the other.

    The relations at a vertex are joined and added up over it; the vertex whose join is smallest goes first.
    For queries of which ``sums_out`` holds.  fan, sizes: ``statistics.fans``.
    """
    heads: dict[int, float] = {}
    for (u, v), n in fan.items():
        heads[u] = min(heads.get(u, float("inf")), max(1.0, sizes[u, v] / max(n, 1e-9)))
    tables = [({u, v}, float(sizes[u, v]), relation(g, q, u, v).withColumn("m", F.lit(1).cast("long"))) for u, v in q.edges]
    if not tables:
        return g.of_label(q.labels[0]).agg(F.count("*").alias("m"))

    def joined(at: list[tuple]) -> tuple[float, list[tuple]]:
        """About how many rows the tables give together, and the tables in their order."""
        at = sorted(at, key=lambda t: (-t[1], sorted(t[0])))
        rows, have = at[0][1], set(at[0][0])
        for held, n, _ in at[1:]:
            for v in held & have:
                n /= heads[v]
            rows, have = rows * n, have | held
        return rows, at

    left = set(range(len(q.labels)))
    while len(tables) > 1:
        u = min(left, key=lambda u: (joined([t for t in tables if u in t[0]])[0], u))
        size, at = joined([t for t in tables if u in t[0]])
        held, _, rows = at[0]
        for other, n, more in at[1:]:
            more = more.withColumnRenamed("m", "_m")
            rows = rows.join(F.broadcast(more) if n <= LOOKUP else more, [name(v) for v in sorted(held & other)]).withColumn("m", F.col("m") * F.col("_m")).drop("_m")
            held = held | other
        held = held - {u}
        rows = rows.groupBy(*(name(v) for v in sorted(held))).agg(F.sum("m").alias("m"))
        tables = [t for t in tables if u not in t[0]] + [(held, size, rows)]
        left.discard(u)
    return tables[0][2].agg(F.sum("m").alias("m"))


def depth_counts(g: Graph, q: Query, order: list[int] | None = None, injective: bool = True) -> DataFrame:
    """depth, vertex, partial: the partial matches there are when an order has bound that vertex.

    A count does not depend on the order in which its own vertices are joined:
    where it can be, each is made by ``summed``, else along the order.
    """
    order, out = list(order or best_order(q)), None
    fan, sizes = fans(g, q)
    for depth, u in enumerate(order):
        part, new = q.induced(order[: depth + 1])
        steps = [new[w] for w in order[: depth + 1]]
        if sums_out(part) or not injective:
            found = summed(g, part, *({(new[a], new[b]): n for (a, b), n in by.items() if a in new and b in new} for by in (fan, sizes)))
        else:
            found = match(g, part, {steps[0]}, steps, injective)
        row = found.agg(F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("partial")).select(F.lit(depth).alias("depth"), F.lit(u).alias("vertex"), "partial")
        out = row if out is None else out.unionByName(row)
    return out


#: Most columns on which a plan's hash join may match.
MOST_KEYS = 2


def plan_edges(tree: int | list) -> list[int]:
    """The query edges at the leaves of a hash-join plan."""
    return [tree] if isinstance(tree, int) else [e for part in tree for e in plan_edges(part)]


def hash_plan(g: Graph, q: Query, tree: int | list | str, injective: bool = True) -> DataFrame:
    """Matches, one row each, by a given tree of hash joins.

    tree: the number of a query edge, or [left, right] for the join of two
    trees on the one or two query vertices that they share; also as JSON.
    A side whose relations are all small is not formed where the other side is
    not: its relations are sent to all executors and the other side's rows
    looked up in one after the other, which gives the same rows and shuffles none.
    """
    tree = json.loads(tree) if isinstance(tree, str) else tree
    if sorted(plan_edges(tree)) != list(range(len(q.edges))):
        raise ValueError("a plan has every query edge at one leaf")

    _, sizes = fans(g, q)
    small = lambda node: all(sizes[q.edges[e]] <= LOOKUP for e in plan_edges(node))
    vertices = lambda node: {u for e in plan_edges(node) for u in q.edges[e]}

    def check(node: int | list) -> None:
        if isinstance(node, int):
            return
        for part in node:
            check(part)
        if not 0 < len(vertices(node[0]) & vertices(node[1])) <= MOST_KEYS:
            raise ValueError(f"a hash join takes 1 to {MOST_KEYS} common vertices")

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        keys = [c for c in left.columns if c in right.columns]
        rows, label = left.join(right, keys), lambda c: q.labels[int(c[1:])]
        for a in left.columns:
            for b in right.columns:
                if injective and a not in keys and b not in keys and label(a) == label(b):
                    rows = rows.filter(F.col(a) != F.col(b))
        return rows

    def look_up(rows: DataFrame, node: int | list) -> DataFrame:
        if isinstance(node, int):
            return join(rows, F.broadcast(relation(g, q, *q.edges[node])))
        held = {int(c[1:]) for c in rows.columns}
        first, then = sorted(node, key=lambda part: not held & vertices(part))  # one that shares a vertex with the rows
        return look_up(look_up(rows, first), then)

    def run(node: int | list) -> DataFrame:
        if isinstance(node, int):
            return relation(g, q, *q.edges[node])
        left, right = sorted(node, key=small)
        return look_up(run(left), right) if small(right) and not isinstance(right, int) else join(run(left), run(right))

    check(tree)
    return run(tree).select(*(name(u) for u in range(len(q.labels))))
