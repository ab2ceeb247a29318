"""Statistics and indexes of a data graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgelift.model import Graph, Query


def degrees(g: Graph) -> DataFrame:
    """id, label, degree; isolated vertices have 0."""
    counted = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return g.vertices.join(counted, "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def label_frequency(g: Graph) -> DataFrame:
    return g.vertices.groupBy("label").agg(F.count("*").alias("n"))


def label_pairs(g: Graph) -> DataFrame:
    """Undirected label pairs a <= b with their number of edges: what the pair index holds."""
    once = g.edges.filter("src < dst")
    return once.groupBy(F.least("src_label", "dst_label").alias("a"), F.greatest("src_label", "dst_label").alias("b")).agg(F.count("*").alias("n"))


def neighbour_labels(g: Graph) -> DataFrame:
    """id, label, n: how many neighbours of each label a vertex has."""
    return g.edges.groupBy(F.col("src").alias("id"), F.col("dst_label").alias("label")).agg(F.count("*").alias("n"))


def neighbours(g: Graph, ids: DataFrame, label: int | None = None) -> DataFrame:
    """Edges that leave the given ids (column id), to one label if given."""
    edges = g.edges if label is None else g.edges.filter(F.col("dst_label") == label)
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")


def adjacency(g: Graph) -> DataFrame:
    """src, dst_label and the sorted neighbours."""
    return g.edges.groupBy("src", "dst_label").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def positions(g: Graph) -> DataFrame:
    """src, dst_label, dst and dst's place (from 0) among src's neighbours of that label."""
    place = F.row_number().over(Window.partitionBy("src", "dst_label").orderBy("dst")) - 1
    return g.edges.select("src", "dst_label", "dst", place.cast("long").alias("place"))


def existing(g: Graph, pairs: DataFrame, u: str = "head", v: str = "tail", present: bool = True) -> DataFrame:
    """The rows of ``pairs`` whose two columns are (or are not) adjacent."""
    known = g.edges.select(F.col("src").alias(u), F.col("dst").alias(v))
    return pairs.join(known, [u, v], "left_semi" if present else "left_anti")


def cardinalities(g: Graph, q: Query) -> DataFrame:
    """edge_no, n, heads, tails: size and distinct ends of each query edge's relation; one pass over the edges."""
    asked = [(i, q.labels[u], q.labels[v]) for i, (u, v) in enumerate(q.edges)]
    wanted = g.edges.sparkSession.createDataFrame(asked, "edge_no int, src_label int, dst_label int")  # at most one row a query edge
    pairs = F.lit(False)
    for _, a, b in asked:
        pairs = pairs | ((F.col("src_label") == a) & (F.col("dst_label") == b))
    sizes = g.edges.filter(pairs).groupBy("src_label", "dst_label").agg(F.count("*").alias("n"), F.countDistinct("src").alias("heads"), F.countDistinct("dst").alias("tails"))
    found = F.broadcast(wanted).join(sizes, ["src_label", "dst_label"], "left")
    return found.select("edge_no", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "heads", "tails")))


def fans(g: Graph, q: Query) -> tuple[dict[tuple[int, int], float], dict[tuple[int, int], int]]:
    """For each query edge in both directions: about how many neighbours v an image of u has that has any, and the relation's size; one pass over the edges."""
    found = g.edges.groupBy("src_label", "dst_label").agg(F.count("*").alias("n"), F.approx_count_distinct("src").alias("heads")).collect()
    by = {(r["src_label"], r["dst_label"]): (r["n"] / max(1, r["heads"]), r["n"]) for r in found}
    both = [e for u, v in q.edges for e in ((u, v), (v, u))]
    of = lambda e: by.get((q.labels[e[0]], q.labels[e[1]]), (0.0, 0))
    return {e: of(e)[0] for e in both}, {e: of(e)[1] for e in both}


def metadata(g: Graph) -> DataFrame:
    """vertices, edges, labels, max_degree, max_label_frequency."""
    v = g.vertices.agg(F.count("*").alias("vertices"), F.countDistinct("label").alias("labels"))
    e = g.edges.agg((F.count("*") / 2).cast("long").alias("edges"))
    d = degrees(g).agg(F.max("degree").alias("max_degree"))
    f = label_frequency(g).agg(F.max("n").alias("max_label_frequency"))
    return v.crossJoin(e).crossJoin(d).crossJoin(f).select("vertices", "edges", "labels", "max_degree", "max_label_frequency")
