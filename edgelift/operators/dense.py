"""Dense parts of the data graph: triangles, four-cliques, cores and trusses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelift.model import Graph

from . import blocks, shared


def _sorted(ids, *vertices):
    import numpy as np

    return np.sort(np.stack([ids[x] for x in vertices]), axis=0)


def _none(g: Graph, schema: str) -> DataFrame:
    return g.edges.sparkSession.createDataFrame([], schema)


def _plan(g: Graph) -> tuple:
    """How edges are dealt to tasks by ``blocks``, and the shared file of neighbours, if tasks are not closed and it can be made."""
    dealt = blocks.spread(g)
    return dealt, None if dealt is None or dealt[1] else shared.near(g)


def triangles(g: Graph) -> DataFrame:
    """a < b < c of every triangle."""

    def make(u, v, mine):
        ids, x, y, (xy, yw, _) = blocks.found(u, v, mine)
        return _sorted(ids, x[xy], y[xy], y[yw])

    out = blocks.by_task(g, make, schema := "a long, b long, c long")
    return _none(g, schema) if out is None else out[0]


def triangle_support(g: Graph) -> DataFrame:
    """u < v and the triangles on each edge; edges on none are left out."""

    def make(u, v, mine):
        import numpy as np

        ids, x, y, three = blocks.found(u, v, mine)
        n = sum(np.bincount(t, minlength=len(x)) for t in three)
        return (*_sorted(ids, x[n > 0], y[n > 0]), n[n > 0])

    def counted(u, v, slot, n, e, d):
        return u[n > 0], v[n > 0], n[n > 0]

    dealt, near = _plan(g)
    if near is not None:
        return near.each(counted, "u long, v long, support long")
    out = blocks.by_task(g, make, schema := "u long, v long, support long", dealt)
    if out is None:
        return _none(g, schema)
    return out[0] if out[1] else out[0].groupBy("u", "v").agg(F.sum("support").alias("support"))


def four_clique_counts(g: Graph) -> DataFrame:
    """a < b < c and the four-cliques that hold each triangle; triangles in none are left out."""

    def make(u, v, mine):
        import numpy as np

        ids, x, y, (xy, yw, _) = blocks.found(u, v)
        n, w = len(ids), y[yw]
        edges, keys = x * n + y, np.sort(xy.astype("int64") * n + w)
        xy, w = keys // n, keys % n
        last = np.searchsorted(xy, xy, "right")
        held = np.zeros(len(keys), "int64")
        upto = np.cumsum(more := last - np.arange(len(keys)) - 1)  # later triangles on the same first edge
        cuts = np.searchsorted(upto, np.arange(blocks.WEDGES, upto[-1], blocks.WEDGES), "right") if len(keys) else []
        at = lambda of, some: np.minimum(np.searchsorted(of, some), len(of) - 1)
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            k = more[lo:hi]
            one = np.repeat(np.arange(lo, hi), k)
            two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(k) - k, k)
            c, d = w[one], w[two]
            hit = edges[at(edges, c * n + d)] == c * n + d if len(one) else np.zeros(0, bool)
            one, two, c, d = one[hit], two[hit], c[hit], d[hit]
            a, b = x[xy[one]], y[xy[one]]
            three = (np.searchsorted(keys, np.searchsorted(edges, s * n + c) * n + d) for s in (a, b))
            for t in (one, two, *three):
                held += np.bincount(t, minlength=len(held))
        xy, w, held = xy[held > 0], w[held > 0], held[held > 0]
        return (*_sorted(ids, x[xy], y[xy], w), held)

    def counted(u, v, slot, n, e, d):
        import numpy as np

        most = int(max(v.max(initial=0), d.max(initial=0))) + 1
        edges, keys = u * most + v, np.sort(e * most + d)  # the edges rise by u and v, what both ends are next to by edge
        e, d = keys // most, keys % most
        t = np.flatnonzero(d > v[e])  # triangles u < v < w; the edges uv and uw start at u
        first, last = np.searchsorted(e, e[t]), np.searchsorted(e, e[t], "right")
        other = np.searchsorted(edges, u[e[t]] * most + d[t])
        held, upto = np.zeros(len(t), "int64"), np.cumsum(more := last - first)
        cuts = np.searchsorted(upto, np.arange(blocks.WEDGES, upto[-1], blocks.WEDGES), "right") if len(t) else []
        for lo, hi in zip([0, *cuts], [*cuts, len(t)], strict=True):
            k = more[lo:hi]
            at = np.arange(k.sum()) + np.repeat(first[lo:hi] - (np.cumsum(k) - k), k)
            seek = np.repeat(other[lo:hi], k) * most + d[at]
            found = np.searchsorted(keys, seek)
            hit = keys[np.minimum(found, len(keys) - 1)] == seek if len(keys) else np.zeros(0, bool)
            held[lo:hi] += np.bincount(np.repeat(np.arange(hi - lo), k)[hit], minlength=hi - lo)
        t, held = t[held > 0], held[held > 0]
        return u[e[t]], v[e[t]], d[t], held

    dealt, near = _plan(g)
    if near is not None:
        return near.each(counted, "a long, b long, c long, n long", deep=True)
    out = blocks.by_task(g, make, schema := "a long, b long, c long, n long", dealt)
    if out is None:
        return _none(g, schema)
    return out[0] if out[1] else _joined_cliques(triangles(g))


def _joined_cliques(t: DataFrame) -> DataFrame:
    """``four_clique_counts`` from all triangles, by joins."""
    both = t.join(t.select("a", "b", F.col("c").alias("d")), ["a", "b"]).filter("c < d")
    cliques = both.join(t.select(F.col("a"), F.col("b").alias("c"), F.col("c").alias("d")), ["a", "c", "d"], "left_semi")
    of = F.explode(F.array(*(F.struct(*(F.col(x).alias(n) for x, n in zip(three, "xyz", strict=True))) for three in ("abc", "abd", "acd", "bcd"))))
    return cliques.select(of.alias("t")).groupBy(F.col("t.x").alias("a"), F.col("t.y").alias("b"), F.col("t.z").alias("c")).agg(F.count("*").alias("n"))


def _settle(frame: DataFrame, peel) -> DataFrame:
    """Applies ``peel`` until the number of rows stays; each round is checkpointed to the shared folder."""
    spark, n = frame.sparkSession, frame.count()
    while True:
        frame = peel(frame)
        frame = frame.checkpoint() if spark.sparkContext.getCheckpointDir() else frame.persist()
        m = frame.count()
        if m == n:
            return frame
        n = m


def k_core(g: Graph, k: int = 2) -> DataFrame:
    """id of the vertices left when those with fewer than k neighbours are removed again and again."""

    def peel(e: DataFrame) -> DataFrame:
        few = e.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") < k).select("src")
        return e.join(few, "src", "left_anti").join(few.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst")

    return _settle(g.edges.select("src", "dst"), peel).select(F.col("src").alias("id")).distinct()


def k_truss(g: Graph, k: int = 1) -> DataFrame:
    """u < v of the edges left when those on fewer than k triangles are removed again and again.

    Closed tasks of ``blocks`` do so each by itself; else it goes round by round, in the file of ``shared`` where there is one.
    """

    def make(u, v, mine):
        import numpy as np

        while len(u):
            ids, x, y, three = blocks.found(u, v)
            kept = sum(np.bincount(t, minlength=len(x)) for t in three) >= k
            u, v = _sorted(ids, x[kept], y[kept])
            if kept.all():
                break
        return u, v

    def peel(e: DataFrame) -> DataFrame:
        both = e.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(e.select("v", "u"))
        return triangle_support(Graph(g.vertices, both)).filter(F.col("support") >= k).select("u", "v")

    def kept(u, v, slot, n, e, d):
        return u[n >= k], v[n >= k]

    dealt, near = _plan(g) if k > 0 else (None, None)
    if near is not None:
        if k > 1:  # at 1 an edge on a triangle keeps it, as the other two stay with it
            near.peel(k)
        return near.each(kept, "u long, v long")
    out = blocks.by_task(g, make, schema := "u long, v long", dealt) if k > 0 else None
    if out is not None and out[1]:
        return out[0]
    once = g.edges.filter("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return _none(g, schema) if k > 0 and out is None else _settle(once, peel)
