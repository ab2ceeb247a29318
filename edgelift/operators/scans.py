"""Scans, projections, candidate filters and semi-join reduction."""

from __future__ import annotations

from collections import Counter
from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelift.model import Graph, Query
from edgelift.plans.order import reducer

from . import blocks, packed
from .statistics import degrees, neighbour_labels


def scan(g: Graph, a: int, b: int) -> DataFrame:
    """Edges from label a to label b; on a stored graph only that folder is read."""
    return g.pair(a, b)


def candidate_scan(g: Graph, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose ends lie in the given sets (columns id)."""
    kept = g.edges.select("src", "dst").join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    return kept.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def scan_query(g: Graph, q: Query) -> dict[tuple[int, int], DataFrame]:
    """The relation (u, v) of every query edge, as src and dst."""
    return {(u, v): scan(g, q.labels[u], q.labels[v]) for u, v in q.edges}


def project(relation: DataFrame, column: str) -> DataFrame:
    return relation.select(F.col(column).alias("id")).distinct()


def project_all(relations: list[tuple[DataFrame, str]]) -> DataFrame:
    """Ids that occur in every one of the (relation, column) pairs."""
    first, *rest = [project(r, c) for r, c in relations]
    return fold(lambda a, b: a.join(b, "id", "left_semi"), rest, first)


def semi_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return left.join(right.select(F.col(right_key).alias(left_key)), left_key, "left_semi")


def hash_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi join on any number of columns; Spark chooses the strategy from sizes."""
    return left.join(right, keys)


def degree_filter(g: Graph, q: Query, u: int) -> DataFrame:
    """Vertices of u's label with at least u's degree."""
    return degrees(g).filter((F.col("label") == q.labels[u]) & (F.col("degree") >= len(q.neighbours(u)))).select("id")


def neighbour_label_filter(g: Graph, q: Query, u: int) -> DataFrame:
    """Vertices of u's label that have at least as many neighbours of each label as u."""
    needed = Counter(q.labels[v] for v in q.neighbours(u))
    if not needed:
        return g.of_label(q.labels[u])
    wanted = fold(lambda a, b: a | b, [(F.col("label") == label) & (F.col("n") >= n) for label, n in needed.items()])
    enough = neighbour_labels(g).filter(wanted).groupBy("id").agg(F.count("*").alias("met")).filter(F.col("met") == len(needed))
    return g.of_label(q.labels[u]).join(enough, "id", "left_semi")


def candidates(g: Graph, q: Query) -> dict[int, DataFrame]:
    """``neighbour_label_filter`` for every query vertex; equal demands share one frame."""
    made: dict[tuple, DataFrame] = {}
    out = {}
    for u in range(len(q.labels)):
        key = (q.labels[u], tuple(sorted(Counter(q.labels[v] for v in q.neighbours(u)).items())))
        out[u] = made.setdefault(key, neighbour_label_filter(g, q, u))
    return out


def full_reducer(relations: dict[tuple[int, int], DataFrame], q: Query) -> dict[tuple[int, int], DataFrame]:
    """Every relation reduced by its neighbours' ends, up the degeneracy order and down; exact for trees, a filter otherwise."""
    out = dict(relations)

    def ends(u: int, but: tuple[int, int]) -> list[tuple[DataFrame, str]]:
        return [(r, "src" if e[0] == u else "dst") for e, r in out.items() if u in e and e != but]

    for kept, by in reducer(q):
        edge = (kept, by) if (kept, by) in out else (by, kept)
        for u in (by, kept):
            for relation, column in ends(u, edge):
                out[edge] = semi_join(out[edge], "src" if edge[0] == u else "dst", relation, column)
    return out


def refine(g: Graph, q: Query, rounds: int = 3) -> dict[int, DataFrame]:
    """Candidates that keep, in every round, a candidate neighbour along each query edge."""
    now = candidates(g, q)
    for _ in range(rounds):
        nxt = {}
        for u in now:
            kept = now[u]
            for v in q.neighbours(u):
                near = candidate_scan(Graph(g.vertices, g.edges.filter((F.col("src_label") == q.labels[u]) & (F.col("dst_label") == q.labels[v]))), now[u], now[v])
                kept = kept.join(near.select(F.col("src").alias("id")), "id", "left_semi")
            nxt[u] = _cut(kept)
        now = nxt
    return now


def _cut(frame: DataFrame) -> DataFrame:
    """Ends a long plan: by a checkpoint in the cluster's folder, or in memory where there is none."""
    if frame.sparkSession.sparkContext.getCheckpointDir():
        return frame.checkpoint()
    return frame.persist()


def intersect_neighbours(g: Graph, pairs: DataFrame) -> DataFrame:
    """head, tail and their common neighbours as a sorted array and its size; pairs without any are left out."""
    near = g.edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("near"))
    both = pairs.join(near.select(F.col("src").alias("head"), F.col("near").alias("a")), "head").join(near.select(F.col("src").alias("tail"), F.col("near").alias("b")), "tail")
    return both.select("head", "tail", F.array_intersect("a", "b").alias("common")).select("head", "tail", "common", F.size("common").cast("long").alias("n")).filter("n > 0")


def common_neighbours(g: Graph, label: int) -> DataFrame:
    """head < tail of a label and n, how many neighbours they have in common; pairs without any are left out and never formed."""
    near = g.edges.filter(F.col("src_label") == label).select(F.col("dst").alias("k"), F.col("src").alias("x"))
    return blocks.common(near, packed.shares(near.count()))


def except_neighbours(g: Graph, pairs: DataFrame) -> DataFrame:
    """head, tail and how many of head's neighbours tail lacks."""
    near = g.edges.groupBy("src").agg(F.collect_list("dst").alias("near"))
    both = pairs.join(near.select(F.col("src").alias("head"), F.col("near").alias("a")), "head").join(near.select(F.col("src").alias("tail"), F.col("near").alias("b")), "tail")
    return both.select("head", "tail", F.size(F.array_except("a", "b")).cast("long").alias("n"))
