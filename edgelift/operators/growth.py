"""How many new matches a missing edge would make: exact answers.

For a query edge (b, t) the residual is the query without it.  A pair (x, y)
of data vertices that are not adjacent gains one match for every match of the
residual that sends b to x and t to y.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelift.model import Graph, Query
from edgelift.plans.order import adjust, all_orders, best_order
from edgelift.plans.query_graph import components

from . import blocks, lists
from .matching import match, name, relation
from .scans import candidates, refine
from .statistics import fans

#: Endpoints of each side whose pairs set the first threshold.
PROBED = 64
#: Choices of the last end, on average, from which a first threshold is sought before it is bound.
WIDE = 64
#: Rows up to which a side of a join is sent to all executors.
SMALL = 100_000


def top_k(pairs: DataFrame, k: int | None) -> DataFrame:
    """The k pairs with the largest count, ties to the smaller ids."""
    return pairs if k is None else pairs.orderBy(F.desc("inc_cnt"), "head", "tail").limit(k)


def joint(g: Graph, q: Query, edge_no: int, k: int | None = None, injective: bool = True, reduce: bool = True, order: list[int] | None = None, wide: float = WIDE) -> DataFrame:
    """Connected residual: one pattern join; the non-edge is checked as soon as both ends are bound.

    With k, where the end that is bound last has ``wide`` choices or more on
    average, only images of the other end that can reach the k-th best are taken on to it.
    """
    b, t = q.edges[edge_no]
    rest = q.without(edge_no)
    if len(components(rest)) > 1:
        raise ValueError("the residual is not connected")
    # a vertex that needs one neighbour of each label has them in every match
    sets = {u: c for u, c in candidates(g, rest).items() if len({rest.labels[v] for v in rest.neighbours(u)}) < len(rest.neighbours(u))} if reduce and injective else None
    late = _late(g, rest, b, t, injective, sets, wide) if k is not None and order is None else None
    found = match(g, rest, {b, t}, order, injective, sets, (b, t)) if late is None else late.finish(late.reaching(k))
    return top_k(_named(found, b, t), k)


class Late:
    """A connected residual whose end ``last`` is bound after all other vertices."""

    def __init__(self, g: Graph, rest: Query, ends: tuple[int, int], last: int, order: list[int], fan: dict, injective: bool, sets: dict[int, DataFrame] | None):
        self.g, self.rest, self.ends, self.last, self.order, self.fan, self.sets = g, rest, ends, last, order, fan, sets
        self.first = ends[0] if last == ends[1] else ends[1]
        self.back = sorted(rest.neighbours(last), key=lambda u: fan[u, last])
        # neighbours of the first end are told apart from the last one by the non-edge
        self.same = [u for u in order if injective and rest.labels[u] == rest.labels[last] and u not in rest.neighbours(self.first)]
        part, new = rest.induced(order)
        inner = {new[u]: c for u, c in (sets or {}).items() if u in new}
        keep = {self.first, *self.back, *self.same}
        found = match(g, part, {new[u] for u in keep}, [new[u] for u in order], injective, inner, fan={(new[u], new[v]): n for (u, v), n in fan.items() if u in new and v in new})
        names = [name(u) for u in sorted(keep)]
        self.rows = found.select(*(F.col(name(new[u])).alias(name(u)) for u in sorted(keep)), "m").groupBy(*names).agg(F.sum("m").alias("m"))

    def finish(self, rows: DataFrame) -> DataFrame:
        """Rows with the last end bound to every vertex it can be; columns of both ends and m."""
        u = name(self.last)
        rows = rows.join(relation(self.g, self.rest, self.back[0], self.last, {self.last: self.sets[self.last]} if self.sets and self.last in self.sets else None), name(self.back[0]))
        for w in self.same:
            rows = rows.filter(F.col(name(w)) != F.col(u))
        for w in self.back[1:]:
            rows = rows.join(relation(self.g, self.rest, w, self.last), [name(w), u], "left_semi")
        b, t = map(name, self.ends)
        rows = rows.groupBy(b, t).agg(F.sum("m").alias("m"))
        known = self.g.pair(*(self.rest.labels[x] for x in self.ends)).select(F.col("src").alias(b), F.col("dst").alias(t))
        return rows.join(known, [b, t], "left_anti")

    def reaching(self, k: int, probed: int = PROBED) -> DataFrame:
        """The rows whose first end can be in one of the k best pairs.

        A pair has at most all rows of its first end, and at most the rows
        over one neighbour times the neighbours that a last end has.
        """
        x, one = name(self.back[0]), name(self.first)
        self.rows = self.rows.persist()
        most = relation(self.g, self.rest, self.back[0], self.last).groupBy(name(self.last)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        by = self.rows.groupBy(one, *([x] if x != one else [])).agg(F.sum("m").alias("m")).groupBy(one).agg(F.sum("m").alias("all"), F.max("m").alias("m"))
        upper = by.select(one, F.least("all", F.col("m") * most).alias("upper")).persist()
        for n in (probed, probed * 16):
            tried = upper.orderBy(F.desc("upper"), one).limit(n).select(one)
            best = top_k(_named(self.finish(self.rows.join(F.broadcast(tried), one, "left_semi")), *self.ends), k).collect()
            if len(best) == k:
                break
        else:
            return self.rows
        floor, head = best[-1]["inc_cnt"], best[-1]["head"]
        kept = upper.filter((F.col("upper") > floor) | ((F.col("upper") == floor) & (F.col(one) <= head if self.first == self.ends[0] else F.lit(True)))).select(one)
        return self.rows.join(F.broadcast(kept) if kept.count() <= SMALL else kept, one, "left_semi")


def _late(g: Graph, rest: Query, b: int, t: int, injective: bool, sets: dict[int, DataFrame] | None, wide: float) -> Late | None:
    """The cheapest way to bind an end last, if it has so many choices there that few rows should be taken on to it."""
    plans = []
    fan, sizes = fans(g, rest)
    for last in (b, t):
        part, new = rest.induced([u for u in range(len(rest.labels)) if u != last])
        if len(components(part)) > 1:
            continue
        old = {i: u for u, i in new.items()}
        for order in all_orders(part):
            order, cost, rows = [old[i] for i in order], 0.0, 0.0
            for i, u in enumerate(order):
                back = [w for w in order[:i] if w in rest.neighbours(u)]
                rows = rows * min((fan[w, u] for w in back), default=1.0) if i != 1 else sizes[order[0], u]
                cost += rows
            plans.append((cost, last, order))
    if not plans:
        return None
    _, last, order = min(plans, key=lambda p: (p[0], p[1], p[2]))
    return Late(g, rest, (b, t), last, order, fan, injective, sets) if min(fan[u, last] for u in rest.neighbours(last)) >= wide else None


def _named(found: DataFrame, b: int, t: int) -> DataFrame:
    return found.groupBy(F.col(name(b)).alias("head"), F.col(name(t)).alias("tail")).agg(F.sum("m").cast("long").alias("inc_cnt"))


def look_ahead(g: Graph, q: Query, edge_no: int, k: int | None = None, injective: bool = True, wide: float = WIDE) -> DataFrame:
    """The same answer, with the second end's candidates carried as an array.

    They shrink at every bound neighbour (intersection) and at the other end
    (difference); rows without any left end at once, and the array is unfolded last.
    Where it would be long (``wide``), only images of the first end that can reach the k-th best are looked at;
    else the candidates are looked up in a file of neighbours (``lists``), where one can be made, and not carried.
    """
    b, t = q.edges[edge_no]
    rest = q.without(edge_no)
    order = adjust(rest, best_order(rest), b, t)
    late = _late(g, rest, b, t, injective, None, wide) if k is not None else None
    if late is not None:  # from the kept images of the first end on, by fewest choices
        order = [late.first]
        while len(order) < len(rest.labels) - 1:
            order.append(min((late.fan[w, u], u) for w in order for u in rest.neighbours(w) if u not in order and u != late.last)[1])
        order.append(late.last)
    elif order[0] in (b, t) and order[-1] in (b, t):
        made = lists.growth(g, rest, order, b, t, k, injective, fans(g, rest)[0])
        if made is not None:
            return top_k(made, k)
    first, last = (b, t) if order.index(b) < order.index(t) else (t, b)
    kept = None if late is None else late.reaching(k).select(F.col(name(first)).alias("id")).distinct().persist()
    kept_small = kept is not None and kept.count() <= SMALL
    kept = F.broadcast(kept) if kept_small else kept

    def side(u: int) -> DataFrame:
        """The last end's candidates next to an image of u."""
        near = g.pair(rest.labels[u], rest.labels[last]).withColumnRenamed("src", name(u))
        if u == first and kept is not None:
            near = near.join(kept.select(F.col("id").alias(name(u))), name(u), "left_semi")
        return near.groupBy(name(u)).agg(F.collect_list("dst").alias("near"))

    before = [u for u in order if u != last]
    part, new = rest.induced(before)
    old = {i: u for u, i in new.items()}
    if len(components(part)) > 1:  # the last end holds the rest together
        return joint(g, q, edge_no, k, injective)
    rows = None
    for depth, u in enumerate(o for o in order if o != last):
        back = [w for w in before[:depth] if w in rest.neighbours(u)]
        if rows is None:
            rows = g.of_label(rest.labels[u]).select(F.col("id").alias(name(u))).withColumn("cand", F.lit(None).cast("array<long>"))
        else:
            if not back:
                return joint(g, q, edge_no, k, injective)
            few = kept_small and depth == 1 and before[0] == first
            rows = (F.broadcast(rows) if few else rows).join(relation(g, rest, back[0], u), name(back[0]))
            for w in back[1:]:
                rows = rows.join(relation(g, rest, w, u), [name(w), name(u)], "left_semi")
            if injective:
                for w in before[:depth]:
                    if rest.labels[w] == rest.labels[u]:
                        rows = rows.filter(F.col(name(w)) != F.col(name(u)))
        if u == first and kept is not None:
            rows = rows.join(kept.select(F.col("id").alias(name(u))), name(u), "left_semi")
        if last in rest.neighbours(u):
            rows = rows.join(side(u), name(u)).withColumn("cand", F.when(F.col("cand").isNull(), F.col("near")).otherwise(F.array_intersect("cand", "near"))).drop("near").filter(F.size("cand") > 0)
    rows = rows.join(side(first), name(first), "left").withColumn("cand", F.array_except("cand", F.coalesce("near", F.array().cast("array<long>")))).drop("near")
    if injective:
        same = [name(w) for w in old.values() if rest.labels[w] == rest.labels[last]]
        if same:
            rows = rows.withColumn("cand", F.array_except("cand", F.array(*same)))
    ends = rows.filter(F.size("cand") > 0).select(F.col(name(first)), F.explode("cand").alias(name(last))).withColumn("m", F.lit(1).cast("long"))
    return top_k(_named(ends, b, t), k)


class Split:
    """A residual in two parts, with each part's matches by endpoint and by vertices that the other part could use."""

    def __init__(self, g: Graph, q: Query, edge_no: int, injective: bool = True):
        self.g, self.q, (self.b, self.t) = g, q, q.edges[edge_no]
        rest = q.without(edge_no)
        parts = components(rest)
        if len(parts) != 2:
            raise ValueError("the residual does not have two parts")
        self.left, self.right = sorted(parts, key=lambda p: self.b not in p)
        self.pairs = [(u, v) for u in self.left for v in self.right if q.labels[u] == q.labels[v]] if injective else []
        self.rest, self.injective = rest, injective
        self.tables = [self._table(self.left, self.b, {u for u, _ in self.pairs}), self._table(self.right, self.t, {v for _, v in self.pairs})]

    def _table(self, part: list[int], end: int, shared: set[int]) -> DataFrame:
        """end, the shared vertices and m, in the query's own numbers."""
        small, new = self.rest.induced(part)
        found = match(self.g, small, {new[end]} | {new[u] for u in shared}, injective=self.injective)
        return found.select(*(F.col(name(new[u])).alias(name(u)) for u in sorted({end} | shared)), "m")

    def totals(self, side: int) -> DataFrame:
        """Matches by endpoint: head (or tail) and n."""
        end, new = ((self.b, "head"), (self.t, "tail"))[side]
        return self.tables[side].groupBy(F.col(name(end)).alias(new)).agg(F.sum("m").cast("long").alias("n"))

    def usage(self, side: int) -> DataFrame:
        """How many matches of an endpoint use a vertex of a shared label: head (or tail), label, vertex, n."""
        end, new = ((self.b, "head"), (self.t, "tail"))[side]
        used = sorted({p[side] for p in self.pairs})
        cells = F.explode(F.array(*(F.struct(F.lit(self.q.labels[u]).alias("label"), F.col(name(u)).alias("vertex")) for u in used)))
        rows = self.tables[side].select(F.col(name(end)).alias(new), "m", cells.alias("c"))
        return rows.groupBy(new, F.col("c.label").alias("label"), F.col("c.vertex").alias("vertex")).agg(F.sum("m").cast("long").alias("n"))

    def matchings(self) -> list[tuple[tuple[int, int], ...]]:
        """Non-empty sets of vertex pairs of the two parts that could be the same data vertices."""
        us, vs = sorted({u for u, _ in self.pairs}), sorted({v for _, v in self.pairs})
        out = []
        for n in range(1, min(len(us), len(vs)) + 1):
            for left in combinations(us, n):
                out += [tuple(zip(left, right, strict=True)) for right in permutations(vs, n) if set(zip(left, right, strict=True)) <= set(self.pairs)]
        return out

    def overlaps(self, ends: tuple[DataFrame, DataFrame] | None = None) -> DataFrame | None:
        """head, tail, and the signed number of match pairs that meet, by inclusion-exclusion over shared vertices.

        Every term is an equi join on the shared vertices of sums, never a
        product of matches.
        """
        out = None
        for pairs in self.matchings():
            keys = [f"k{i}" for i in range(len(pairs))]
            side = []
            for s, (end, new) in enumerate(((self.b, "head"), (self.t, "tail"))):
                columns = [F.col(name(p[s])).alias(key) for p, key in zip(pairs, keys, strict=True)]
                rows = self.tables[s] if ends is None else self.tables[s].join(ends[s].select(F.col(new).alias(name(end))), name(end), "left_semi")
                side.append(rows.groupBy(F.col(name(end)).alias(new), *columns).agg(F.sum("m").alias(f"m{s}")))
            term = side[0].join(side[1], keys).select("head", "tail", (F.col("m0") * F.col("m1") * (-1) ** len(pairs)).alias("part"))
            out = term if out is None else out.unionByName(term)
        return None if out is None else out.groupBy("head", "tail").agg(F.sum("part").cast("long").alias("part"))

    def exact(self, pairs: DataFrame, ends: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """head, tail, inc_cnt of the given pairs (head, tail, n = product of totals) that are not adjacent.

        ends: tables that hold every head and every tail of the pairs; other matches of the parts are not looked at.
        """
        known = self.g.pair(self.q.labels[self.b], self.q.labels[self.t]).select(F.col("src").alias("head"), F.col("dst").alias("tail"))
        pairs = pairs.join(known, ["head", "tail"], "left_anti")
        if self.q.labels[self.b] == self.q.labels[self.t]:
            pairs = pairs.filter("head <> tail") if self.injective else pairs
        met = self.overlaps(ends)
        counted = pairs.select("head", "tail", F.col("n").alias("inc_cnt")) if met is None else pairs.join(met, ["head", "tail"], "left").select("head", "tail", (F.col("n") + F.coalesce("part", F.lit(0))).alias("inc_cnt"))
        return counted.filter("inc_cnt > 0")

    def product(self, left: DataFrame, right: DataFrame, floor: int = 1) -> DataFrame:
        """head, tail and n, the product of totals, where it is at least ``floor``."""
        a, b = left.select("head", F.col("n").alias("a")), right.select("tail", F.col("n").alias("b"))
        return a.join(b, F.col("a") * F.col("b") >= floor).select("head", "tail", (F.col("a") * F.col("b")).alias("n"))


def probe(g: Graph, q: Query, edge_no: int, k: int | None = None, injective: bool = True) -> DataFrame:
    """Two parts: every pair of part matches that are disjoint and whose ends are not adjacent, counted.

    With k, only matches whose ends' product of totals can reach the k-th best are paired, by equi joins on the ends.
    """
    s = Split(g, q, edge_no, injective)
    left, right = s.tables[0].withColumnRenamed("m", "m0"), s.tables[1].withColumnRenamed("m", "m1")
    apart = F.lit(True)
    for u, v in s.pairs:
        apart &= F.col(name(u)) != F.col(name(v))
    if k is None:
        met = left.join(right, apart)
    else:
        ends = _reaching(s, k)[0].select(F.col("head").alias(name(s.b)), F.col("tail").alias(name(s.t)))
        met = left.join(ends, name(s.b)).join(right, name(s.t)).filter(apart)
    met = met.withColumn("m", F.col("m0") * F.col("m1"))
    known = g.pair(q.labels[s.b], q.labels[s.t]).select(F.col("src").alias(name(s.b)), F.col("dst").alias(name(s.t)))
    summed = met.groupBy(name(s.b), name(s.t)).agg(F.sum("m").alias("m"))
    return top_k(_named(summed.join(known, [name(s.b), name(s.t)], "left_anti"), s.b, s.t), k)


def bounds(g: Graph, q: Query, edge_no: int) -> DataFrame:
    """head, tail, lower, upper of all pairs that are not adjacent: product of totals, less the sum of usage products."""
    s = Split(g, q, edge_no)
    known = g.pair(q.labels[s.b], q.labels[s.t]).select(F.col("src").alias("head"), F.col("dst").alias("tail"))
    used = [s.usage(i).select(F.col("vertex").alias("k"), F.col(c).alias("x"), "n") for i, c in enumerate(("head", "tail"))] if s.pairs else (None, None)
    return blocks.products(s.totals(0), s.totals(1), *used, known)


def _reaching(s: Split, k: int, probed: int = PROBED) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """The pairs (head, tail, n) whose product of totals can be among the k best, and tables that hold their ends.

    The exact counts among the endpoints with most matches give a threshold: a
    count and, as ties go to the smaller ids, a pair.  Endpoints that cannot
    reach it with the best partner go before pairs are formed.
    """
    left, right = s.totals(0).persist(), s.totals(1).persist()
    for n in (probed, probed * 16):  # more, if most of the first ones are adjacent
        first = left.orderBy(F.desc("n"), "head").limit(n), right.orderBy(F.desc("n"), "tail").limit(n)
        best = top_k(s.exact(s.product(*first), first), k).collect()
        if len(best) == k:
            break
    else:
        return s.product(left, right), (left, right)
    floor, head, tail = best[-1]["inc_cnt"], best[-1]["head"], best[-1]["tail"]
    most = [side.agg(F.max("n")).first()[0] for side in (left, right)]
    left = left.filter((F.col("n") * most[1] > floor) | ((F.col("n") * most[1] == floor) & (F.col("head") <= head)))
    right = right.filter(F.col("n") * most[0] >= floor)
    sizes = left.count(), right.count()
    sent = min(sizes) <= SMALL
    ends = (F.broadcast(left) if sent and sizes[0] <= sizes[1] else left, F.broadcast(right) if sent and sizes[0] > sizes[1] else right)
    before = (F.col("head") < head) | ((F.col("head") == head) & (F.col("tail") <= tail))
    return s.product(*ends, floor).filter((F.col("n") > floor) | before), (left, right)


def inclusion_exclusion(g: Graph, q: Query, edge_no: int, k: int | None = None, injective: bool = True, probed: int = PROBED) -> DataFrame:
    """Two parts: totals of each part first, then only pairs whose product can reach the k-th best."""
    s = Split(g, q, edge_no, injective)
    if k is None:
        return s.exact(s.product(s.totals(0).persist(), s.totals(1).persist()))
    pairs, ends = _reaching(s, k, probed)
    return top_k(s.exact(pairs, ends), k)


def product_only(g: Graph, q: Query, edge_no: int, k: int | None = None) -> DataFrame:
    """Two parts without a shared label: the product of totals is exact."""
    s = Split(g, q, edge_no)
    if s.pairs:
        raise ValueError("the parts share a label")
    return inclusion_exclusion(g, q, edge_no, k)


def exact(g: Graph, q: Query, edge_no: int, k: int | None = None, injective: bool = True) -> DataFrame:
    """By the residual's number of parts."""
    n = len(components(q.without(edge_no)))
    if n > 2:
        raise ValueError("the query is not connected")
    return joint(g, q, edge_no, k, injective) if n == 1 else inclusion_exclusion(g, q, edge_no, k, injective)


def growth_of(g: Graph, q: Query, edge_no: int, pairs: DataFrame) -> DataFrame:
    """Exact counts of given pairs (head, tail); only matches that end in one of them (split residuals: in one of their heads and tails) are formed."""
    b, t = q.edges[edge_no]
    rest = q.without(edge_no)
    pairs = pairs.select("head", "tail").distinct().persist()
    ends = pairs.select("head").distinct(), pairs.select("tail").distinct()
    if len(components(rest)) == 1:
        known = g.pair(q.labels[b], q.labels[t]).select(F.col("src").alias("head"), F.col("dst").alias("tail"))
        apart = pairs.join(known, ["head", "tail"], "left_anti").filter("head <> tail")
        for c, u in (("head", b), ("tail", t)):
            apart = apart.join(g.of_label(q.labels[u]).select(F.col("id").alias(c)), c, "left_semi")
        start = apart.select(F.col("head").alias(name(b)), F.col("tail").alias(name(t)), F.lit(1).cast("long").alias("m"))
        fan, _ = fans(g, rest)
        order = [b, t]
        while len(order) < len(rest.labels):  # from the pairs on, by fewest choices
            order.append(min(((fan[w, u], u) for w in order for u in rest.neighbours(w) if u not in order))[1])
        return _named(match(g, rest, {b, t}, order, start=start, fan=fan), b, t)
    s = Split(g, q, edge_no)
    totals = pairs.join(s.totals(0).withColumnRenamed("n", "a"), "head").join(s.totals(1).withColumnRenamed("n", "b"), "tail")
    return s.exact(totals.select("head", "tail", (F.col("a") * F.col("b")).alias("n")), ends)


def total_growth(g: Graph, q: Query, k: int | None = None) -> DataFrame:
    """u < v and ``growth``: the matches that the edge {u, v} would add over all query edges and both directions."""
    out = None
    for i in range(len(q.edges)):
        part = exact(g, q, i)
        out = part if out is None else out.unionByName(part)
    summed = out.groupBy(F.least("head", "tail").alias("u"), F.greatest("head", "tail").alias("v")).agg(F.sum("inc_cnt").cast("long").alias("growth"))
    return summed if k is None else summed.orderBy(F.desc("growth"), "u", "v").limit(k)


def relative_error(estimated: DataFrame, answer: DataFrame) -> DataFrame:
    """head, tail, exact, estimate and the error in per mille of the exact count."""
    both = answer.withColumnRenamed("inc_cnt", "exact").join(estimated.select("head", "tail", F.col("inc_cnt").alias("estimate")), ["head", "tail"])
    return both.select("head", "tail", "exact", "estimate", F.expr("(abs(estimate - exact) * 1000) div exact").alias("per_mille"))


def shrunk(g: Graph, q: Query, edge_no: int, k: int | None = None, rounds: int = 3) -> DataFrame:
    """``joint`` over candidates refined for some rounds."""
    b, t = q.edges[edge_no]
    rest = q.without(edge_no)
    return top_k(_named(match(g, rest, {b, t}, sets=refine(g, rest, rounds), absent=(b, t)), b, t), k)
