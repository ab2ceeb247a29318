"""Triangles of a data graph whose neighbour lists lie in one file that all executors read.

Where the cluster's checkpoint folder is a mounted one and the ids are dense,
the neighbours of all vertices are written there once, in order.  A task then
takes a range of vertices and finds for each of their edges what both ends
are next to, from the mapped file, so nothing but the edges is ever shuffled.
Graphs of which tasks by ``blocks`` are closed do not need it.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelift.model import Graph

from . import blocks

#: Ids a vertex, at most, for which ids serve as places; directed edges of a range, about.
SPARSE, RANGE = 8, 1_000_000


def folder(spark) -> str | None:
    """A new folder in the cluster's checkpoint folder, if that is a mounted one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or ""
    at = at.removeprefix("file:") if at.startswith(("file:", "/")) else ""
    at = "/" + at.lstrip("/")
    return tempfile.mkdtemp(prefix="near-", dir=at) if at != "/" and os.path.isdir(at) else None


def ranged(rows: DataFrame, lo: int, width: int, span: int, both: bool = False) -> DataFrame:
    """Two columns of ids from ``lo`` on, fewer than ``span``, as runs: r, which range of ``width`` the first one is in, and both, packed.

    both: each row is also dealt the other way round, and loops and rows with other ids or nulls are left out.
    """

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        def packed(held):
            u, v = (np.concatenate([b.column(c).fill_null(lo - 1).to_numpy(zero_copy_only=False) for b in held]) - lo for c in (0, 1))
            if both:
                kept = (u != v) & (u >= 0) & (u < span) & (v >= 0) & (v < span)
                u, v = np.append(u[kept], v[kept]), np.append(v[kept], u[kept])
            code = np.sort(u * span + v)
            u, v = code // span, code % span
            r = u // width
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            spans = list(zip(starts, [*starts[1:], len(r)], strict=True))
            made = [[int(r[s]) for s, _ in spans], [blocks._planes(np.diff(u[s:e], prepend=0).astype("<i4")) for s, e in spans], [blocks._planes(v[s:e].astype("<i4")) for s, e in spans]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["r", "u", "v"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= blocks.PACKED:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return rows.mapInArrow(pack, "r int, u binary, v binary")


def opened(frame, span: int):
    """The rows of a range's runs, in order, as two arrays that count from the first id."""
    import numpy as np

    u = np.concatenate([np.cumsum(blocks._numbers(x, "<i4")) for x in frame["u"]])
    v = np.concatenate([blocks._numbers(x, "<i4") for x in frame["v"]])
    code = np.sort(u * span + v)
    return code // span, code % span


class Near:
    """The file of neighbours (``adj``, from the first id on, in order), where each vertex's begin (``first``) and which of them are left (``left``)."""

    def __init__(self, g: Graph, at: str, lo: int, hi: int, edges: int):
        self.spark, self.at, self.lo, self.span = g.edges.sparkSession, at, lo, hi - lo + 1
        self.ranges = max(8, -(-2 * edges // RANGE))
        self.width = -(-self.span // self.ranges)
        self._write(g.edges.select("src", "dst"))

    def _write(self, rows: DataFrame) -> None:
        lo, width, span, at = self.lo, self.width, self.span, self.at
        counts = {r["r"]: r["n"] for r in rows.groupBy(F.expr(f"(src - {lo}) div {width}").cast("int").alias("r")).agg(F.count("*").alias("n")).collect()}
        base, upto = {}, 0
        for r in sorted(counts):
            base[r], upto = upto, upto + counts[r]
        for name, size in (("adj", 4 * upto), ("first", 8 * (span + 1)), ("left", upto)):
            with open(f"{at}/{name}", "wb") as f:
                f.truncate(size)

        last = max(base)

        def write(frame):
            import numpy as np
            import pandas as pd

            r = int(frame["r"].iloc[0])
            u, v = opened(frame, span)
            before = max([x for x in base if x < r], default=-1)  # ranges without edges begin where the next one does
            start = (before + 1) * width
            stop = span + 1 if r == last else (r + 1) * width
            first = base[r] + np.searchsorted(u, np.arange(start, stop))
            for name, x, place in (("adj", v.astype("<i4"), 4 * base[r]), ("first", first.astype("<i8"), 8 * start), ("left", np.ones(len(v), "u1"), base[r])):
                with open(f"{at}/{name}", "r+b") as f:
                    f.seek(place)
                    f.write(x.tobytes())
            return pd.DataFrame({"n": [len(v)]})

        ranged(rows, lo, width, span).groupBy("r").applyInPandas(write, "n long").agg(F.sum("n")).collect()

    def each(self, make, schema: str, deep: bool = False) -> DataFrame:
        """What ``make`` gives of each lot of vertices: arrays, as the columns of ``schema`` (all long).

        make(u, v, slot, n, e, d): the ends and places of the edges u < v, how
        many vertices are next to both, and, if ``deep``, each of them with its edge's number.
        """
        lo, width, span, at = self.lo, self.width, self.span, self.at
        columns = [c.split()[0] for c in schema.split(", ")]

        def run(batches):
            import numpy as np
            import pyarrow as pa

            adj, first, left = (np.memmap(f"{at}/{name}", kind, "r") for name, kind in (("adj", "<i4"), ("first", "<i8"), ("left", "u1")))
            rows = max(1, blocks.MARKS // span)
            marked = np.zeros(rows * span, bool)
            for batch in batches:
                for r in batch.column(0).to_pylist():
                    held, size = [], 0
                    for s in range(r * width, min(span, (r + 1) * width), rows):
                        e = min(s + rows, span, (r + 1) * width)
                        begins = np.asarray(first[s : e + 1])
                        slot = np.arange(begins[0], begins[-1])
                        u, v = np.repeat(np.arange(s, e), np.diff(begins)), np.asarray(adj[begins[0] : begins[-1]]).astype("int64")
                        kept = left[begins[0] : begins[-1]] == 1
                        slot, u, v = slot[kept], u[kept], v[kept]
                        if not len(u):
                            continue
                        mark = (u - s) * span + v
                        marked[mark] = True
                        ahead = v > u
                        slot, u, v = slot[ahead], u[ahead], v[ahead]
                        begin = first[v]
                        k = first[v + 1] - begin
                        upto = np.append(0, np.cumsum(k))
                        n, es, ds = np.zeros(len(u), "int64"), [], []
                        a = 0
                        while a < len(u):
                            b = max(a + 1, int(np.searchsorted(upto, upto[a] + blocks.WEDGES, "right")) - 1)
                            one = np.repeat(np.arange(a, b), k[a:b])
                            w = np.arange(upto[b] - upto[a]) + np.repeat(begin[a:b] - (upto[a:b] - upto[a]), k[a:b])
                            d = adj[w]
                            hit = np.flatnonzero(marked[np.repeat((u[a:b] - s) * span, k[a:b]) + d])
                            hit = hit[left[w[hit]] == 1]
                            one, d = one[hit], d[hit]
                            n += np.bincount(one, minlength=len(u))
                            if deep:
                                es.append(one)
                                ds.append(d.astype("int64"))
                            a = b
                        marked[mark] = False
                        made = make(u, v, slot, n, *((np.concatenate(x) if x else np.zeros(0, "int64")) for x in (es, ds)))
                        held.append(made)
                        size += len(made[0])
                        if size >= blocks.BATCH:
                            yield batch_of(held)
                            held, size = [], 0
                    if size:
                        yield batch_of(held)

        def batch_of(held):
            import numpy as np
            import pyarrow as pa

            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) + (lo if c in "abcuv" else 0), pa.int64()) for c, x in zip(columns, zip(*held, strict=True), strict=True)], columns)

        return self.spark.range(0, self.ranges, 1, self.ranges).mapInArrow(run, schema)

    def peel(self, k: int) -> None:
        """Takes edges on fewer than k triangles of what is left away, until there are none.

        What a task takes others may see at once or later: an edge that has too few now has too few in every part of it.
        """
        at = self.at

        def make(u, v, slot, n, e, d):
            import numpy as np

            adj, first, left = (np.memmap(f"{at}/{name}", kind, mode) for name, kind, mode in (("adj", "<i4", "r"), ("first", "<i8", "r"), ("left", "u1", "r+")))
            gone = n < k
            left[slot[gone]] = 0
            x, y = u[gone], v[gone]
            begin, end = np.asarray(first[y]), np.asarray(first[y + 1])
            while (begin < end).any():  # the place of each x among the neighbours of its y
                half = (begin + end) // 2
                less = (begin < end) & (adj[np.minimum(half, len(adj) - 1)] < x)
                begin, end = np.where(less, half + 1, begin), np.where(less, end, np.minimum(half, end))
            left[begin] = 0
            left.flush()
            return (np.array([gone.sum()]),)

        while self.each(make, "n long").agg(F.sum("n")).first()[0]:
            pass


def near(g: Graph) -> Near | None:
    """The graph's file, if it can and should be made."""
    lo, hi, n, vertices = g.edges.filter("src < dst").agg(F.min("src"), F.max("dst"), F.count("*"), F.approx_count_distinct("src")).first()
    if not n or hi - lo + 1 > SPARSE * vertices or hi - lo + 1 > blocks.MARKS:
        return None
    at = folder(g.edges.sparkSession)
    return Near(g, at, lo, hi, n) if at else None
