"""Data graphs and query graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most vertices of a query graph.
MOST_QUERY_VERTICES = 32


def both_ways(u: Column, v: Column, u_label: Column, v_label: Column) -> Column:
    """An edge's two directions, unfolded."""
    one = lambda *x: F.struct(*(c.alias(n) for c, n in zip(x, ("src", "dst", "src_label", "dst_label"), strict=True)))
    return F.explode(F.array(one(u, v, u_label, v_label), one(v, u, v_label, u_label)))


@dataclass(frozen=True)
class Graph:
    """An undirected, simple, vertex-labelled graph.

    vertices: id long, label int.  edges: src, dst long, src_label, dst_label
    int; every edge stands in both directions, once each, without loops.
    """

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def of(vertices: DataFrame, pairs: DataFrame) -> Graph:
        """From vertices (id, label) and undirected pairs (u, v) in any order, with loops and repeats dropped."""
        vertices = vertices.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"))
        once = pairs.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v")).filter("u <> v").distinct()
        a = vertices.select(F.col("id").alias("u"), F.col("label").alias("u_label"))
        b = vertices.select(F.col("id").alias("v"), F.col("label").alias("v_label"))
        named = once.join(a, "u").join(b, "v")
        both = both_ways(*(F.col(c) for c in ("u", "v", "u_label", "v_label")))
        return Graph(vertices, named.select(both.alias("e")).select("e.*"))

    @staticmethod
    def of_distinct(vertices: DataFrame, once: DataFrame) -> Graph:
        """From vertices and edges that stand once each, with the columns of ``edges``; these are kept in that one direction and read in both."""
        once = once.select("src", "dst", "src_label", "dst_label").persist()
        turned = once.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_label").alias("src_label"), F.col("src_label").alias("dst_label"))
        return Graph(vertices.persist(), once.union(turned))

    @staticmethod
    def in_memory(spark: SparkSession, labels: dict[int, int], pairs: list[tuple[int, int]]) -> Graph:
        return Graph.of(spark.createDataFrame(list(labels.items()), "id long, label int"), spark.createDataFrame(pairs, "u long, v long"))

    def store(self, path: str) -> None:
        """Write as Parquet; the edges by label pair, so that a scan of one pair reads only its folder."""
        self.vertices.write.partitionBy("label").parquet(f"{path}/vertices")
        self.edges.repartition("src_label", "dst_label", F.pmod(F.hash("src"), F.lit(64))).write.partitionBy("src_label", "dst_label").parquet(f"{path}/edges")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        return Graph(spark.read.schema("id long, label int").parquet(f"{path}/vertices"), spark.read.schema("src long, dst long, src_label int, dst_label int").parquet(f"{path}/edges"))

    def persist(self) -> Graph:
        return Graph(self.vertices.persist(), self.edges.persist())

    def pair(self, a: int, b: int) -> DataFrame:
        """Edges from label a to label b, as src and dst."""
        return self.edges.filter((F.col("src_label") == a) & (F.col("dst_label") == b)).select("src", "dst")

    def of_label(self, label: int) -> DataFrame:
        return self.vertices.filter(F.col("label") == label).select("id")


@dataclass(frozen=True)
class Query:
    """A connected query graph: vertices 0..n-1 with labels, and edges in the order in which they are perturbed."""

    name: str
    labels: tuple[int, ...]
    edges: tuple[tuple[int, int], ...]

    def __post_init__(self):
        n = len(self.labels)
        if not 0 < n <= MOST_QUERY_VERTICES:
            raise ValueError(f"a query has 1 to {MOST_QUERY_VERTICES} vertices")
        if any(not (0 <= u < n and 0 <= v < n and u != v) for u, v in self.edges) or len({frozenset(e) for e in self.edges}) < len(self.edges):
            raise ValueError("edges join two different vertices, once each")

    def neighbours(self, u: int) -> list[int]:
        return sorted({b if a == u else a for a, b in self.edges if u in (a, b)})

    def without(self, edge_no: int) -> Query:
        """The residual: all vertices, without the edge of that number."""
        return Query(self.name, self.labels, tuple(e for i, e in enumerate(self.edges) if i != edge_no))

    def induced(self, keep: list[int]) -> tuple[Query, dict[int, int]]:
        """The part on some vertices, renumbered, and the new number of each."""
        new = {u: i for i, u in enumerate(sorted(keep))}
        edges = tuple((new[a], new[b]) for a, b in self.edges if a in new and b in new)
        return Query(self.name, tuple(self.labels[u] for u in sorted(keep)), edges), new
