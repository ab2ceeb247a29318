"""Growth counts of a connected residual from neighbour lists in one file that all executors read.

A task takes a range of images of the first end and binds one vertex after the
other by looking lists up; a vertex that is not asked for later only counts.
All pairs of a head (or tail) are made in one task, which gives the best of
them, so neither partial matches nor pairs are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelift.model import Graph, Query

from . import blocks, shared


class Lists:
    """For each vertex and kind (label from, label to) the neighbours in order (``adj``), and where they begin (``first``)."""

    def __init__(self, g: Graph, kinds: list[tuple[int, int]], at: str, lo: int, hi: int, edges: int):
        self.spark, self.at, self.lo, self.span, self.kinds = g.edges.sparkSession, at, lo, hi - lo + 1, kinds
        self.ranges = max(8, -(-edges // shared.RANGE))
        self.width = -(-self.span // self.ranges)
        self._write(g)

    def _write(self, g: Graph) -> None:
        lo, span, width, n, at = self.lo, self.span, self.width, len(self.kinds), self.at
        kind = F.lit(None).cast("long")
        for i, (a, b) in enumerate(self.kinds):
            kind = F.when((F.col("src_label") == a) & (F.col("dst_label") == b), F.lit(i).cast("long")).otherwise(kind)
        rows = g.edges.select((F.col("src") - lo).alias("u"), (kind * span + F.col("dst") - lo).alias("v")).filter("v IS NOT NULL")
        counts = {r["r"]: r["n"] for r in rows.groupBy(F.expr(f"u div {width}").cast("int").alias("r")).agg(F.count("*").alias("n")).collect()}
        base, upto = [], 0
        for r in range(-(-span // width)):
            base.append(upto)
            upto += counts.get(r, 0)
        for name, size in (("adj", 4 * upto), ("first", 8 * (span * n + 1))):
            with open(f"{at}/{name}", "wb") as f:
                f.truncate(size)
        empty = [r for r in range(len(base)) if r not in counts]

        def put(name, x, place):
            with open(f"{at}/{name}", "r+b") as f:
                f.seek(place)
                f.write(x.tobytes())

        def write(frame):
            import numpy as np
            import pandas as pd

            r = int(frame["r"].iloc[0])
            u, v = shared.opened(frame, n * span)
            starts = np.arange(r * width * n, min(span, (r + 1) * width) * n)
            put("adj", (v % span).astype("<i4"), 4 * base[r])
            put("first", (base[r] + np.searchsorted(u * n + v // span, starts)).astype("<i8"), 8 * r * width * n)
            return pd.DataFrame({"n": [len(v)]})

        shared.ranged(rows, 0, width, n * span).groupBy("r").applyInPandas(write, "n long").agg(F.sum("n")).collect()
        import numpy as np

        for r in empty:
            put("first", np.full((min(span, (r + 1) * width) - r * width) * n, base[r], "<i8"), 8 * r * width * n)
        put("first", np.array([upto], "<i8"), 8 * span * n)

    def best(self, rest: Query, order: list[int], b: int, t: int, k: int | None, injective: bool) -> DataFrame:
        """head, tail, inc_cnt: all pairs, or of each task the k best (ties to the smaller ids)."""
        lo, width, span, kinds, at = self.lo, self.width, self.span, self.kinds, self.at
        step, marks = blocks.WEDGES, blocks.MARKS
        first, last, label, near = order[0], order[-1], rest.labels, rest.neighbours
        told = {u for u in order if u in near(first)}  # from the last end, by the non-edge

        def asked(u: int, depth: int) -> bool:
            return any(u in near(x) or injective and label[x] == label[u] and not (x == last and u in told) for x in order[depth + 1 :])

        backs = [[w for w in order[:d] if w in near(u)] for d, u in enumerate(order)]
        backs = [sorted(x, key=lambda w: w == first) for x in backs]  # first is looked up fastest
        wanted = [u == first or asked(u, d) for d, u in enumerate(order)]

        def run(batches):
            import numpy as np
            import pyarrow as pa

            adj, begins = np.memmap(f"{at}/adj", "<i4", "r"), np.memmap(f"{at}/first", "<i8", "r")
            lot = max(1, marks // 2 // span)
            mark, total = np.zeros(lot * span, bool), np.zeros(lot * span, "int64")

            def spans(x, a, c):
                place = x * len(kinds) + kinds.index((label[a], label[c]))
                start = begins[place]
                return start, begins[place + 1] - start

            def adjacent(a, x, c, y):
                start, n = spans(x, a, c)
                lo, hi, end = start.copy(), start + n, start + n
                while (lo < hi).any():
                    half = (lo + hi) // 2
                    less = (lo < hi) & (adj[np.minimum(half, len(adj) - 1)] < y)
                    lo, hi = np.where(less, half + 1, lo), np.where(less, hi, np.minimum(half, hi))
                return (lo < end) & (adj[np.minimum(lo, len(adj) - 1)] == y)

            def bind(depth, rows, m, s, touched):
                """rows: images by bound vertex; s: the first image of the lot."""
                u, (by, *others) = order[depth], backs[depth]
                start, n = spans(rows[by], by, u)
                upto = np.append(0, np.cumsum(n))
                lower = 0
                while lower < len(n):
                    upper = max(lower + 1, int(np.searchsorted(upto, upto[lower] + step, "right")) - 1)
                    one = np.repeat(np.arange(lower, upper), n[lower:upper])
                    x = adj[np.arange(upto[upper] - upto[lower]) + np.repeat(start[lower:upper] - (upto[lower:upper] - upto[lower]), n[lower:upper])].astype("int64")
                    for w in others:
                        kept = mark[(rows[first][one] - s) * span + x] if w == first else adjacent(w, rows[w][one], u, x)
                        one, x = one[kept], x[kept]
                    for w in rows:
                        if injective and label[w] == label[u] and w not in near(u):
                            kept = rows[w][one] != x
                            one, x = one[kept], x[kept]
                    if u == last:
                        code = (rows[first][one] - s) * span + x
                        apart = ~mark[code]
                        code, one = code[apart], one[apart]
                        np.add.at(total, code, m[one])
                        touched.append(code if k is not None else np.unique(code))
                    elif wanted[depth]:
                        bind(depth + 1, {w: y[one] for w, y in rows.items()} | {u: x}, m[one], s, touched)
                    else:
                        many = np.bincount(one - lower, minlength=upper - lower)
                        some = np.flatnonzero(many)
                        bind(depth + 1, {w: y[lower:upper][some] for w, y in rows.items()}, m[lower:upper][some] * many[some], s, touched)
                    lower = upper

            def named(head, tail, n):
                return pa.RecordBatch.from_arrays([pa.array(head + lo), pa.array(tail + lo), pa.array(n)], ["head", "tail", "inc_cnt"])

            for batch in batches:
                for r in batch.column(0).to_pylist():
                    held = [np.zeros(0, "int64")] * 3
                    for s in range(r * width, min(span, (r + 1) * width), lot):
                        images = np.arange(s, min(s + lot, span, (r + 1) * width))
                        images = images[spans(images, first, order[1])[1] > 0]
                        if not len(images):
                            continue
                        marked = []
                        for c in {c for a, c in kinds if a == label[first]}:
                            place = images * len(kinds) + kinds.index((label[first], c))
                            start, n = begins[place], begins[place + 1] - begins[place]
                            at_ = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
                            marked.append(np.repeat((images - s) * span, n) + adj[at_])
                        marked = np.concatenate(marked)
                        mark[marked] = True
                        touched = []
                        bind(1, {first: images}, np.ones(len(images), "int64"), s, touched)
                        mark[marked] = False
                        floor = held[2][k - 1] if k is not None and len(held[2]) >= k else 0
                        code = np.unique(np.concatenate([c if k is None else c[total[c] >= floor] for c in touched])) if touched else np.zeros(0, "int64")
                        one, x, n = code // span + s, code % span, total[code]
                        for c in touched:
                            total[c] = 0
                        head, tail = (one, x) if first == b else (x, one)
                        if k is None:
                            for i in range(0, len(n), blocks.BATCH):
                                yield named(*(c[i : i + blocks.BATCH] for c in (head, tail, n)))
                        else:
                            held = [np.append(old, new) for old, new in zip(held, (head, tail, n), strict=True)]
                            top = np.lexsort((held[1], held[0], -held[2]))[:k]
                            held = [c[top] for c in held]
                    if len(held[0]):
                        yield named(*held)

        return self.spark.range(0, self.ranges, 1, self.ranges).mapInArrow(run, "head long, tail long, inc_cnt long")


def growth(g: Graph, rest: Query, order: list[int], b: int, t: int, k: int | None, injective: bool, fan: dict[tuple[int, int], float]) -> DataFrame | None:
    """What ``Lists.best`` gives along an order of which the ends are first and last; None, if the lists cannot or should not be made."""
    label, rows = rest.labels, 1.0
    first, last = order[0], order[-1]
    if {first, last} != {b, t} or k is not None and k < 1:
        return None
    kinds = {(label[first], label[last])}
    for depth, u in enumerate(order[1:], 1):
        back = [w for w in order[:depth] if w in rest.neighbours(u)]
        if not back:
            return None
        rows *= max(fan[w, u] for w in back)
        kinds |= {(label[w], label[u]) for w in back}
    kinds = sorted(kinds)
    used = F.lit(False)
    for a, c in kinds:
        used = used | ((F.col("src_label") == a) & (F.col("dst_label") == c))
    lo, hi, n, vertices = g.edges.filter(used).agg(F.least(F.min("src"), F.min("dst")), F.greatest(F.max("src"), F.max("dst")), F.count("*"), F.approx_count_distinct("src")).first()
    # one image of the first end should be no more than some steps of work
    if not n or rows > blocks.WEDGES or hi - lo + 1 > shared.SPARSE * vertices or hi - lo + 1 > blocks.MARKS or (hi - lo + 1) * len(kinds) >= 1 << 31:
        return None
    at = shared.folder(g.edges.sparkSession)
    return Lists(g, kinds, at, lo, hi, n).best(rest, order, b, t, k, injective) if at else None
