"""Nearest neighbours by inner product, with balanced posting lists.

A bounded sample is split by repeated k-means until every cluster is near its
share; the centroids stay in memory with a neighbour graph, which a beam
search walks.  Each vector joins the list of its nearest centroid and those
nearly as near (boundary vectors are replicated); a query reads the lists whose
centroids lie within a ratio of its nearest one, as many as a sample of the
queries needs to find its true neighbours.  Where so many lists cost more than
the whole table, as with vectors that form no groups, the table is one list and
the answer is exact.  One more coordinate turns inner products into distances.
Long lists are dealt out in blocks.

Equal vectors are one class with its smallest ids only: as ties go to smaller
ids, no other member can be among the nearest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors that the fit takes at most (or EACH for each list), and distinct vectors a list should hold.
SAMPLE, EACH, LIST = 20_000, 5, 192
#: Lists: at most so many times the root of the number of distinct vectors, so a query's work grows with the root.
ROOT = 4
#: Replicas: at most so many, within this ratio of the nearest centroid's distance.
REPLICAS, REPLICA_RATIO = 4, 1.15
#: Probed lists: at least, and within this ratio.
LEAST_PROBES, PROBE_RATIO = 8, 1.4
#: Queries on which the number of probes is measured, and the recall they must reach (0.9 is due).
TRIED, RECALL = 256, 0.95
#: What a query's row in a list costs besides the list's vectors, in vectors compared.
ROW = 2048
#: Neighbours in the graph, beam width, entries.
DEGREE, BEAM, ENTRIES = 24, 64, 64
#: Rows of a posting block, and queries that meet it at once.
BLOCK = 4096


def usable(vector: str) -> Column:
    """Not null, with finite components that are not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda x: x != 0)


def lift(x, top: float):
    """Vectors with the coordinate that brings all to the length ``top``."""
    import numpy as np

    return np.concatenate([x, np.sqrt(np.maximum(0, top * top - (x * x).sum(1)))[:, None]], 1)


def distances(x, c):
    import numpy as np

    return np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T)


def balanced_centroids(x, lists: int, seed: int = 7):
    """Centroids of clusters split until each holds about its share of ``x``."""
    import numpy as np

    rng, share, done = np.random.default_rng(seed), max(1.0, len(x) / max(1, lists)), []
    todo = [np.arange(len(x))] if len(x) else []
    while todo:
        rows = todo.pop()
        part = x[rows]
        k = min(8, math.ceil(len(rows) / share))
        if len(rows) <= 1.5 * share or k < 2 or np.ptp(part, 0).max() == 0:
            done.append(part.mean(0))
            continue
        centre = part[rng.choice(len(rows), k, replace=False)]
        for _ in range(8):
            near = distances(part, centre).argmin(1)
            centre = np.array([part[near == i].mean(0) if (near == i).any() else part[rng.integers(len(part))] for i in range(k)])
        near = distances(part, centre).argmin(1)
        groups = [rows[near == i] for i in range(k) if (near == i).any()]
        if len(groups) == 1:
            groups = np.array_split(rows[np.argsort(part @ (part.max(0) - part.min(0)))], 2)
        todo.extend(groups)
    return np.array(done)


@dataclass
class Centroids:
    """Centroids with a neighbour graph."""

    points: object
    neighbours: object

    @classmethod
    def build(cls, points):
        import numpy as np

        near = [np.argsort(distances(points[i : i + 1024], points), 1)[:, 1 : DEGREE + 1] for i in range(0, len(points), 1024)]
        return cls(points.astype(np.float32), np.concatenate(near).astype(np.int32))

    def search(self, x, beam: int = BEAM):
        """(ids, distances) of the ``beam`` nearest centroids of each row, nearest first; by beam search, or by all distances beyond its width."""
        import numpy as np

        n, x = len(self.points), x.astype(np.float32)
        if beam > BEAM:
            dist = distances(x, self.points)
            ids = np.argsort(dist, 1)[:, :beam]
            return ids, np.sqrt(np.take_along_axis(dist, ids, 1))
        beam = min(beam, n)
        entry = np.unique(np.linspace(0, n - 1, min(n, max(ENTRIES, beam))).astype(np.int64))
        ids = np.tile(entry, (len(x), 1))
        dist = distances(x, self.points[entry])
        opened = np.zeros(ids.shape, bool)
        rows = np.arange(len(x))[:, None]
        while True:
            order = np.argsort(dist, 1)[:, :beam]
            ids, dist, opened = ids[rows, order], dist[rows, order], opened[rows, order]
            if opened.all() or not self.neighbours.shape[1]:
                return ids, np.sqrt(dist)
            pick = np.argsort(np.where(opened, np.inf, np.arange(ids.shape[1])[None]), 1)[:, :4]
            opened[rows, pick] = True
            more = self.neighbours[ids[rows, pick]].reshape(len(x), -1).astype(np.int64)
            gap = np.maximum(0, ((x[:, None, :] - self.points[more]) ** 2).sum(2))
            ids, dist = np.concatenate([ids, more], 1), np.concatenate([dist, gap], 1)
            opened = np.concatenate([opened, np.zeros(more.shape, bool)], 1)
            # of one centroid's entries the first opened one stays
            rank = np.lexsort((~opened, ids), axis=1)
            same = np.zeros(ids.shape, bool)
            sorted_ids = ids[rows, rank]
            same[rows, rank] = np.concatenate([np.zeros((len(x), 1), bool), sorted_ids[:, 1:] == sorted_ids[:, :-1]], 1)
            dist, opened = np.where(same, np.inf, dist), opened | same


def classes(vectors: DataFrame, vector: str, keep: int) -> DataFrame:
    """``vector`` and ``ids``, the ``keep`` smallest vec_ids that have it."""
    place = F.dense_rank().over(Window.partitionBy(vector).orderBy("vec_id"))
    return vectors.withColumn("_n", place).filter(F.col("_n") <= keep).groupBy(vector).agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def lift_queries(x, top: float):
    """Queries at the length ``top``, with nothing in the coordinate that ``lift`` adds."""
    import numpy as np

    return np.concatenate([x * (top / np.sqrt((x * x).sum(1)))[:, None], np.zeros((len(x), 1))], 1)


def replicas(centroids: Centroids, ids, dist):
    """Which of the centroids found for each vector hold it."""
    import numpy as np

    take = np.zeros(ids.shape, bool)
    take[:, 0] = True
    for j in range(1, ids.shape[1]):
        new = (dist[:, j] <= REPLICA_RATIO * dist[:, 0]) & (take.sum(1) < REPLICAS)
        if not new.any():
            break
        for i in range(j):  # not towards a centroid that lies behind a chosen one
            apart = ((centroids.points[ids[:, j]] - centroids.points[ids[:, i]]) ** 2).sum(1)
            new &= ~take[:, i] | (apart > dist[:, j] ** 2 * 0.5)
        take[:, j] = new
    return take


def within(dist, probes: int, ratio: float | None):
    """Which of the centroids found for each query, nearest first, are read."""
    import numpy as np

    width = np.arange(dist.shape[1])
    near = dist <= ratio * dist[:, :1] if ratio else np.ones(dist.shape, bool)
    return (width < LEAST_PROBES) | ((width < probes) & near)


def true_neighbours(vectors: DataFrame, queries, k: int) -> list:
    """For each row of ``queries`` its ``k`` nearest of the distinct ``vector`` (at most), other than itself, by comparing all."""
    import numpy as np

    def scan(batches):
        import pyarrow as pa

        held = scores = None
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if not len(x):
                continue
            rough = queries @ x.T
            near = np.argpartition(-rough, min(k, len(x) - 1), 1)[:, : k + 1]
            more, score = x[near], np.take_along_axis(rough, near, 1)
            held, scores = (more, score) if held is None else (np.concatenate([held, more], 1), np.concatenate([scores, score], 1))
            best = np.argsort(-scores, 1)[:, : k + 1]
            held, scores = np.take_along_axis(held, best[:, :, None], 1), np.take_along_axis(scores, best, 1)
        if held is not None:
            of = np.repeat(np.arange(len(queries)), scores.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(scores.ravel()), pa.array(list(held.reshape(len(of), -1)), pa.list_(pa.float64()))], ["q", "score", "vector"])

    found = vectors.select("vector").mapInArrow(scan, "q int, score double, vector array<double>")
    few = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("n") <= k + 1)
    out: list[list] = [[] for _ in queries]
    for q, x in few.orderBy("q", "n").select("q", "vector").toPandas().itertuples(index=False):
        if not np.array_equal(x, queries[q]) and len(out[q]) < k:
            out[q].append(x)
    return out


def plan(centroids: Centroids, queries, wanted: list, top: float, n: int) -> tuple[int, float | None] | None:
    """Probes and ratio with which ``queries`` find RECALL of the ``wanted`` neighbours; none where comparing all ``n`` vectors costs less."""
    import numpy as np

    of = np.repeat(np.arange(len(queries)), [len(w) for w in wanted])
    if not len(of):
        return None
    ids, dist = centroids.search(lift(np.array([x for w in wanted for x in w]), top))
    holds = replicas(centroids, ids, dist)
    lists, asked = len(centroids.points), lift_queries(queries, top)
    for width, ratio in ((BEAM, PROBE_RATIO), (lists, PROBE_RATIO), (lists, None)):
        found, dist = centroids.search(asked, max(BEAM, width))
        rank = np.full((len(queries), lists), lists)
        np.put_along_axis(rank, found, np.where(within(dist, lists, ratio), np.arange(found.shape[1])[None], lists), 1)
        first = np.sort(np.where(holds, rank[of[:, None], ids], lists).min(1))
        probes = max(LEAST_PROBES, int(first[math.ceil(RECALL * len(first)) - 1]) + 1)
        if probes <= lists:
            break
    read = min(probes, lists) * (n / lists * holds.sum() / len(holds) + ROW)
    return (probes, ratio) if read < n + math.ceil(n / BLOCK) * ROW else None


def _lists(frame: DataFrame, centroids: Centroids, top: float, probes: tuple[int, float | None] | None = None) -> DataFrame:
    """``frame`` (ids, vector, ...) with a row for each list it belongs to or, as a query with so many ``probes`` in a ratio, reads."""

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = np.array(part.column("vector").to_pylist(), float)
                if probes:
                    ids, dist = centroids.search(lift_queries(x, top), max(BEAM, probes[0]))
                    take = within(dist, *probes)
                else:
                    ids, dist = centroids.search(lift(x, top))
                    take = replicas(centroids, ids, dist)
                rows, at = np.nonzero(take)
                taken = part.take(pa.array(rows))
                yield taken.append_column("list", pa.array(ids[rows, at], pa.int32()))

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(deal, f"{ddl}, list int")


def nearest(vectors: DataFrame, query_filter: str, k: int = 20, vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row that ``query_filter`` selects.

    vectors: vec_id and ``vector``.  Nearness is the inner product in double
    precision, ties go to the smaller vec_id, and a query never finds itself,
    nor another row of its vec_id; rows that repeat a vec_id share one ranking.
    Null and zero vectors, those with null or non-finite components, those of
    another length than most, and null ids take no part.  Fewer candidates
    than ``k`` are all returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & usable("vector"))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not usual:
        return empty
    rows = rows.filter(F.size("vector") == usual[0]["n"])
    distinct = materialize(classes(rows, "vector", k + 1), "classes")
    asked = materialize(rows.filter(query_filter), "asked")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    n, top = distinct.agg(F.count("*"), F.sqrt(F.max(norm))).first()

    import numpy as np

    lists = max(1, math.ceil(min(n / LIST, ROOT * math.sqrt(n))))
    chosen = distinct.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(max(sample, EACH * lists)).toPandas()["vector"]
    centroids = Centroids.build(balanced_centroids(lift(np.array(chosen.tolist(), float), top), lists))

    queries = classes(asked, "vector", 1).select("vector", F.col("ids")[0].alias("query"))
    # by another hash than the vectors of the fit
    tried = np.array(queries.select("vector").orderBy(F.xxhash64(F.lit(1), "vector"), "vector").limit(TRIED).toPandas()["vector"].tolist(), float)
    if not len(tried):
        return empty
    planned = plan(centroids, tried, true_neighbours(distinct, tried, k), top, n)
    if planned:
        posts = materialize(_lists(distinct, centroids, top), "posts")
        probes = materialize(_lists(queries, centroids, top, planned), "probes")
    else:
        posts, probes = (frame.withColumn("list", F.lit(0)) for frame in (distinct, materialize(queries, "probes")))
    # one row a list: the root of the number of vectors, a few times
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = F.broadcast(blocks(posts, "post_blocks").join(blocks(probes, "probe_blocks"), "list"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = posts.join(sizes, "list").withColumn("b", F.pmod(F.xxhash64("vector"), F.col("post_blocks")).cast("int")).withColumn("q", every("probe_blocks")).select("list", "b", "q", "ids", "vector")
    right = probes.join(sizes, "list").withColumn("q", F.pmod(F.xxhash64("query"), F.col("probe_blocks")).cast("int")).withColumn("b", every("post_blocks")).select("list", "b", "q", "query", "vector")

    def best(a, b):
        import pandas as pd

        out: dict[str, list] = {"query": [], "vec_id": [], "score": []}
        if len(a) and len(b):
            x, y = np.array(a["vector"].tolist(), float), np.array(b["vector"].tolist(), float)
            ids = a["ids"].tolist()
            rough = y @ x.T
            for i, query in enumerate(b["query"].tolist()):
                most = min(k + 8, len(x))  # a few more, as rounding may swap neighbours
                near = np.argpartition(-rough[i], most - 1)[:most]
                floor = rough[i][near].min()
                near = np.flatnonzero(rough[i] >= floor - 1e-9 * max(1.0, abs(floor)))
                exact = (x[near] * y[i]).cumsum(1)[:, -1]  # component by component, so that any engine gives the same bits
                found = sorted((-s, v) for s, c in zip(exact.tolist(), near.tolist(), strict=True) for v in ids[c])[: k + 1]
                out["query"] += [query] * len(found)
                out["vec_id"] += [v for _, v in found]
                out["score"] += [-s for s, _ in found]
        return pd.DataFrame(out).astype({"query": "int64", "vec_id": "int64", "score": "float64"})

    hits = left.groupBy("list", "b", "q").cogroup(right.groupBy("list", "b", "q")).applyInPandas(best, "query long, vec_id long, score double")
    once = hits.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.col("vec_id")]
    few = once.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("n") <= k + 1).drop("n")
    # every query of a class, without itself
    same = asked.select(F.col("vec_id").alias("query_id"), "vector").join(classes(asked, "vector", 1).select("vector", F.col("ids")[0].alias("query")), "vector").select("query_id", "query")
    final = same.join(few, "query").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return final.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
