"""Triangles of the data graph by blocks of vertices.

The ids are cut into ranges of one length.  Three ranges (some may be the same)
make a task, which gets the edges between them and gives the triangles with
one vertex in each, so that every triangle is found in one task, in memory,
and no wedge is written.  Tasks of which a pair of ranges has no edges are left
out; where no edge is needed by two tasks, the tasks are closed: everything
that triangles decide can then be decided within each.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelift.model import Graph

#: Ranges that edges are counted by; a plan merges neighbouring ones.
FINE = 120
#: Edges that a task should hold at most.
MOST = 8_000_000
#: Tasks that a plan aims at, where that costs few copies of edges; a closed task may have so many edges, or this part of all.
TASKS, FEW, PART = 24, 100_000, 12
#: Vertices of a range whose pairs are counted in one task, and rows of a batch that it gives.
SIDE, BATCH = 5_000, 100_000
#: Edges that are packed together, and wedges and marks that are in memory at once.
PACKED, WEDGES, MARKS = 500_000, 2_000_000, 16_000_000


def plan(counts: dict[tuple[int, int], int]) -> tuple[int, list[tuple[int, int, int]], bool]:
    """Number of ranges, tasks and whether they are closed, from the edges by pair (a <= b) of fine ranges."""
    best = None
    for n in (d for d in range(1, FINE + 1) if FINE % d == 0):
        edges: dict[tuple[int, int], int] = defaultdict(int)
        for (a, b), m in counts.items():
            edges[a * n // FINE, b * n // FINE] += m
        after = defaultdict(set)
        for a, b in edges:
            after[a].add(b)
        tasks, uses, largest = [], defaultdict(int), 0
        for a, b in edges:
            for c in after[a] & after[b]:
                if c >= b:
                    tasks.append((a, b, c))
                    for p in needed(tasks[-1]):
                        uses[p] += 1
                    largest = max(largest, sum(edges[p] for p in needed(tasks[-1])))
        tasks.sort()
        closed = max(uses.values(), default=1) <= 1
        good = closed and largest <= max(FEW, sum(edges.values()) // PART)
        cost = (largest > MOST, not good, sum(edges[p] * k for p, k in uses.items()) + TASKS * largest, -n)
        if best is None or cost < best[0]:
            best = cost, n, tasks, closed
    return best[1:]


def needed(task: tuple[int, int, int]) -> set[tuple[int, int]]:
    """The pairs of ranges whose edges a task needs."""
    a, b, c = task
    return {p for p in ((a, b), (b, c), (a, c)) if p[0] != p[1] or task.count(p[0]) > 1}


def _planes(numbers) -> bytes:
    """Numbers byte by byte, the lowest ones of all first, which a shuffle's compression makes much smaller."""
    import numpy as np

    return np.ascontiguousarray(numbers).view("u1").reshape(len(numbers), -1).T.tobytes()


def _numbers(planes: bytes, kind: str):
    import numpy as np

    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, "u1").reshape(width, -1).T).view(kind).ravel().astype("int64")


def spread(g: Graph) -> tuple | None:
    """task and the packed ends (u < v) of its edges (u as differences); whether tasks are closed; first id, ids a fine range, ranges and kind of numbers; the tasks."""
    once = g.edges.filter("src < dst").select("src", "dst")
    lo, hi = once.agg(F.min("src"), F.max("dst")).first()
    if lo is None:
        return None
    width = -(-(hi - lo + 1) // FINE)
    at = lambda c: F.expr(f"({c} - {lo}) div {width}").cast("int")
    counts = {(r["a"], r["b"]): r["n"] for r in once.groupBy(at("src").alias("a"), at("dst").alias("b")).agg(F.count("*").alias("n")).collect()}
    n, tasks, closed = plan(counts)
    users = defaultdict(list)
    for i, task in enumerate(tasks):
        for a, b in needed(task):
            users[a * n + b].append(i)
    kind = "<i4" if hi - lo < 2**31 else "<i8"

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        def packed(us, vs):
            u, v = np.concatenate(us) - lo, np.concatenate(vs) - lo
            code = (u // width * n // FINE) * n + v // width * n // FINE
            order = np.lexsort((v, u, code))
            u, v, code = u[order].astype(kind), v[order].astype(kind), code[order]  # u rises within a code
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            rows = {"task": [], "u": [], "v": []}
            for s, e in zip(starts, [*starts[1:], len(code)], strict=True):
                for i in users.get(int(code[s]), ()):
                    rows["task"].append(i)
                    rows["u"].append(_planes(np.diff(u[s:e], prepend=0).astype(kind)))
                    rows["v"].append(_planes(v[s:e]))
            return pa.RecordBatch.from_pydict({"task": pa.array(rows["task"], pa.int32()), "u": pa.array(rows["u"], pa.binary()), "v": pa.array(rows["v"], pa.binary())})

        us, vs, held = [], [], 0
        for batch in batches:
            us.append(batch.column(0).to_numpy())
            vs.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= PACKED:
                yield packed(us, vs)
                us, vs, held = [], [], 0
        if held:
            yield packed(us, vs)

    return once.mapInArrow(pack, "task int, u binary, v binary"), closed, (lo, width, n, kind), tasks


def found(u, v, mine=None):
    """ids, the forward edges (x, y) as places among ids in ascending key x * len(ids) + y, and the triangles as the edges xy, yw, xw.

    u, v: arrays of ids.  Edges lead from fewer neighbours to more.  mine: which triangles, by their ids, are given.
    """
    import numpy as np

    ids, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    n, m = len(ids), len(u)
    degree = np.bincount(inv, minlength=n)
    order = np.lexsort((ids, degree))
    rank = np.empty(n, "int64")
    rank[order] = np.arange(n)
    ids, p, q = ids[order], rank[inv[:m]], rank[inv[m:]]
    key = np.sort(np.minimum(p, q) * n + np.maximum(p, q))
    x, y = key // n, key % n
    first = np.searchsorted(x, np.arange(n + 1))
    follow = first[y + 1] - first[y]  # wedges of each edge
    rows = max(1, MARKS // max(n, 1))
    marked = np.zeros(rows * n, bool)
    out = [[], [], []]
    for r in range(0, n, rows):
        lo, hi = first[r], first[min(n, r + rows)]
        if lo == hi:
            continue
        mark = (x[lo:hi] - r) * n + y[lo:hi]
        marked[mark] = True
        upto = np.cumsum(follow[lo:hi])
        cuts = lo + np.unique(np.searchsorted(upto, np.arange(WEDGES, upto[-1] + WEDGES, WEDGES), "right").clip(0, hi - lo))
        start = lo
        for stop in [*cuts, hi]:
            if stop == start:
                continue
            e, k = np.arange(start, stop), follow[start:stop]
            xy = np.repeat(e, k)
            yw = np.arange(len(xy)) + np.repeat(first[y[start:stop]] - (np.cumsum(k) - k), k)
            hit = marked[(x[xy] - r) * n + y[yw]]
            xy, yw = xy[hit], yw[hit]
            if mine is not None and len(xy):
                kept = mine(ids[x[xy]], ids[y[xy]], ids[y[yw]])
                xy, yw = xy[kept], yw[kept]
            for part, more in zip(out, (xy, yw, np.searchsorted(key, x[xy] * n + y[yw])), strict=True):
                part.append(more.astype("int32" if m < 2**31 else "int64"))
            start = stop
        marked[mark] = False
    return ids, x, y, [np.concatenate(part) if part else np.zeros(0, "int64") for part in out]


def by_task(g: Graph, make, schema: str, dealt: tuple | None = None) -> tuple[DataFrame, bool] | None:
    """What ``make(u, v, mine)`` gives for each task, columns of long; whether tasks are closed.  None: there are no edges.

    dealt: what ``spread`` gave, if it was asked before.
    """
    dealt = dealt or spread(g)
    if dealt is None:
        return None
    rows, closed, (lo, width, n, kind), tasks = dealt

    def run(frame):
        import numpy as np
        import pandas as pd

        u = np.concatenate([np.cumsum(_numbers(x, kind)) for x in frame["u"]])
        v = np.concatenate([_numbers(x, kind) for x in frame["v"]])
        task = tasks[int(frame["task"].iloc[0])]

        def mine(*three):
            return (np.sort(np.stack([t // width * n // FINE for t in three]), axis=0) == np.array(task)[:, None]).all(axis=0)

        made = make(u, v, None if len(set(task)) == 1 else mine)
        return pd.DataFrame({c: np.asarray(x, "int64") + (lo if shifted else 0) for (c, shifted), x in zip(columns, made, strict=True)})

    columns = [(c.split()[0], c.split()[0] in "abcuv") for c in schema.split(", ")]  # vertices count from the first id
    return rows.groupBy("task").applyInPandas(run, schema), closed


def common(edges: DataFrame, shares: int) -> DataFrame:
    """head < tail and n, how many of the rows (k, x) they have a k in common, for all x that share one; rows are distinct.

    The ids x are cut into ranges, and each pair of ranges is a task that gets
    the k seen in both, with their x, packed.  It counts in memory, so that
    neither pairs nor wedges are shuffled.
    """
    from . import packed

    lo, hi, many = edges.agg(F.min("x"), F.max("x"), F.approx_count_distinct("x")).first()
    lo, hi = lo or 0, hi or 0
    sides = max(1, -(-many // SIDE))
    width = -(-(hi - lo + 1) // sides)
    kind = "<i4" if hi - lo < 2**31 else "<i8"

    def spread(frame):
        import numpy as np
        import pandas as pd

        k, x = packed.ordered(*packed.opened(frame))
        known = (k != packed.NULL) & (x != packed.NULL)
        k, x = k[known], x[known] - lo
        side, (_, at) = x // width, np.unique(k, return_inverse=True)
        own = [np.flatnonzero(side == s) for s in range(sides)]
        seen = [np.bincount(at[o], minlength=at.max() + 1) if len(o) else None for o in own]
        rows = {"task": [], "a": [], "b": []}
        for i in range(sides):
            for j in range(i, sides):
                if seen[i] is None or seen[j] is None:
                    continue
                both = seen[i] > 1 if i == j else (seen[i] > 0) & (seen[j] > 0)
                e = np.concatenate([own[s][both[at[own[s]]]] for s in sorted({i, j})])
                if len(e):  # k rises in each of the two ranges; its number serves, as all its rows are here
                    rows["task"].append(i * sides + j)
                    rows["a"].append(_planes(np.diff(at[e], prepend=0).astype("<i4")))
                    rows["b"].append(_planes(x[e].astype(kind)))
        return pd.DataFrame(rows)

    def count(task, held):
        import numpy as np
        import pyarrow as pa

        i, j = divmod(task, sides)
        ids = [np.unique(_numbers(b, kind)) for _, b in held]
        ids = np.unique(np.concatenate(ids))
        heads, tails = ids[ids // width == i], ids[ids // width == j]
        total = np.zeros(len(heads) * len(tails), "u4")
        for a, b in held:
            k, x = np.cumsum(_numbers(a, "<i4")), _numbers(b, kind)
            left, right = x // width == i, x // width == j
            code, q = np.searchsorted(heads, x[left]) * len(tails), np.searchsorted(tails, x[right])
            first = np.searchsorted(k[right], k[left])
            met = np.searchsorted(k[right], k[left], "right") - first
            upto = np.append(0, np.cumsum(met))
            cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + WEDGES, WEDGES)).clip(0, len(met)))
            for s, e in zip([0, *cuts], [*cuts, len(met)], strict=True):
                at = np.arange(upto[e] - upto[s]) + np.repeat(first[s:e] - (upto[s:e] - upto[s]), met[s:e])
                np.add.at(total, np.repeat(code[s:e], met[s:e]) + q[at], np.uint32(1))
        rows = max(1, WEDGES // len(tails))
        for r in range(0, len(heads), rows):
            part = total[r * len(tails) : (r + rows) * len(tails)]
            cell = np.flatnonzero(part)
            head, tail, n = heads[cell // len(tails) + r] + lo, tails[cell % len(tails)] + lo, part[cell]
            if i == j:
                later = tail > head
                head, tail, n = head[later], tail[later], n[later]
            for s in range(0, len(head), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + BATCH], pa.int64()) for c in (head, tail, n.astype("int64"))], ["head", "tail", "n"])

    def run(batches):
        task, held = None, []
        for batch in batches:
            for t, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if t != task and held:
                    yield from count(task, held)
                    held = []
                task = t
                held.append((a, b))
        if held:
            yield from count(task, held)

    dealt = packed.deal(edges.select("k", "x"), shares).groupBy("task").applyInPandas(spread, packed.RUNS)
    tasks = sides * (sides + 1) // 2
    return dealt.repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(run, "head long, tail long, n long")


#: Ends of either side whose pairs are made in one task.
ENDS = 4_000


def products(left: DataFrame, right: DataFrame, a: DataFrame | None, b: DataFrame | None, known: DataFrame) -> DataFrame:
    """head, tail, lower, upper of all pairs but those in ``known`` and an id with itself.

    left, right: (head, n) and (tail, n); upper is the product.  a, b: distinct (k, x, n) by heads and
    by tails; lower is less by the sum of products over a common k, and not below 0.  Ranges
    of heads and of tails make a task, which gets the rows of k seen in both; pairs are never shuffled.
    """
    import numpy as np

    from . import packed

    spark, wide = left.sparkSession, ENDS
    (heads, tails), (many, more) = zip(*(tuple(t.column(i).to_numpy().astype("int64") for i in (0, 1)) for t in (left.orderBy("head").toArrow(), right.orderBy("tail").toArrow())), strict=True)
    across = max(1, -(-len(tails) // wide))
    tasks = max(1, -(-len(heads) // wide)) * across
    schema = "task int, kind int, a binary, b binary, c binary, d binary"

    def coded(rows, ids):
        """k, and n with the place of x in one number."""

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                k, x, n = (batch.column(i).to_numpy() for i in range(3))
                if len(n) and n.max() >= (1 << 62) // len(ids):
                    raise OverflowError("too many matches of one end and vertex")
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n * len(ids) + np.searchsorted(ids, x))], ["k", "x"])

        return rows.select("k", "x", "n").mapInArrow(run, "k long, x long")

    def spread(frame):
        import pandas as pd

        (k, x), (m, y) = (packed.ordered(*packed.opened(frame[frame["side"] == s])) for s in (0, 1))
        both = np.intersect1d(k, m)
        k, x, m, y = k[(p := np.isin(k, both))], x[p], m[(p := np.isin(m, both))], y[p]
        k, m = np.searchsorted(both, k), np.searchsorted(both, m)
        i, j = x % len(heads) // wide, y % len(tails) // wide
        rows = []
        own = [{s: np.flatnonzero(side == s) for s in np.unique(side)} for side in (i, j)]
        seen = [{s: np.bincount(at[o], minlength=len(both)) > 0 for s, o in mine.items()} for at, mine in zip((k, m), own, strict=True)]
        for s, one in own[0].items():
            for t, two in own[1].items():
                met = seen[0][s] & seen[1][t]
                if met.any():
                    e, f = one[met[k[one]]], two[met[m[two]]]
                    rows.append((int(s * across + t), 0, _planes(np.diff(k[e], prepend=0).astype("<i4")), _planes(x[e].astype("<i8")), _planes(np.diff(m[f], prepend=0).astype("<i4")), _planes(y[f].astype("<i8"))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    def adjacent(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in (0, 1))
            if not len(x) or not len(heads) or not len(tails):
                continue
            h, t = np.searchsorted(heads, x).clip(0, len(heads) - 1), np.searchsorted(tails, y).clip(0, len(tails) - 1)
            here = (heads[h] == x) & (tails[t] == y)
            h, t = h[here], t[here]
            task = h // wide * across + t // wide
            lots = [np.flatnonzero(task == s) for s in np.unique(task)]
            made = [[int(task[o[0]]) for o in lots], [1] * len(lots), [_planes(h[o].astype("<i4")) for o in lots], [_planes(t[o].astype("<i4")) for o in lots], [b""] * len(lots), [b""] * len(lots)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c < 2 else pa.binary()) for c, v in enumerate(made)], [c.split()[0] for c in schema.split(", ")])

    def count(task, held):
        import pyarrow as pa

        p, q = task // across * wide, task % across * wide
        head, tail, n, m = heads[p : p + wide], tails[q : q + wide], many[p : p + wide], more[q : q + wide]
        met, gone = np.zeros(len(head) * len(tail), "int64"), np.zeros(len(head) * len(tail), bool)
        for kind, a, b, c, d in held:
            if kind == 1:
                gone[(_numbers(a, "<i4") - p) * len(tail) + _numbers(b, "<i4") - q] = True
            elif kind == 0:
                k, x, l, y = np.cumsum(_numbers(a, "<i4")), _numbers(b, "<i8"), np.cumsum(_numbers(c, "<i4")), _numbers(d, "<i8")
                first = np.searchsorted(l, k)
                times = np.searchsorted(l, k, "right") - first
                code, by = (x % len(heads) - p) * len(tail), x // len(heads)
                place, also = y % len(tails) - q, y // len(tails)
                upto = np.append(0, np.cumsum(times))
                cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + WEDGES, WEDGES)).clip(0, len(times)))
                for s, e in zip([0, *cuts], [*cuts, len(times)], strict=True):
                    at = np.arange(upto[e] - upto[s]) + np.repeat(first[s:e] - (upto[s:e] - upto[s]), times[s:e])
                    np.add.at(met, np.repeat(code[s:e], times[s:e]) + place[at], np.repeat(by[s:e], times[s:e]) * also[at])
        rows = max(1, BATCH // max(1, len(tail)))
        for r in range(0, len(head), rows):
            cells = slice(r * len(tail), (r + rows) * len(tail))
            one = head[r : r + rows]
            h, t, upper = np.repeat(one, len(tail)), np.tile(tail, len(one)), np.multiply.outer(n[r : r + rows], m).ravel()
            lower = np.maximum(upper - met[cells], 0)
            kept = ~gone[cells] & (h != t)
            yield pa.RecordBatch.from_arrays([pa.array(x if kept.all() else x[kept]) for x in (h, t, lower, upper)], ["head", "tail", "lower", "upper"])

    def run(batches):
        task, held = None, []
        for batch in batches:
            for t, *rest in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if t != task and held:
                    yield from count(task, held)
                    held = []
                task = t
                held.append(rest)
        if held:
            yield from count(task, held)

    none = "cast('' AS binary)"
    lots = spark.range(tasks).selectExpr("cast(id AS int) AS task", "2 AS kind", *(f"{none} AS {c}" for c in "abcd"))
    lots = lots.union(known.select("head", "tail").mapInArrow(adjacent, schema))
    if a is not None and len(heads) and len(tails):
        shares = min(2_000, packed.shares(int(many.sum() + more.sum())))
        sides = packed.deal(coded(a, heads), shares).withColumn("side", F.lit(0)).union(packed.deal(coded(b, tails), shares).withColumn("side", F.lit(1)))
        lots = lots.union(sides.groupBy("task").applyInPandas(spread, schema))
    return lots.repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(run, "head long, tail long, lower long, upper long")
