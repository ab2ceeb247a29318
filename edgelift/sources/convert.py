"""Raw edge lists, new labels, and samples of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelift.functions import bernoulli, seeded
from edgelift.model import Graph


def read_edge_list(spark: SparkSession, path: str, labels: int, seed: int = 0) -> Graph:
    """White-space pairs; ``#`` lines and loops are dropped, repeats merged, labels drawn by a hash of the id."""
    fields = spark.read.text(path).filter(~F.trim("value").startswith("#")).select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") >= 2)
    pairs = fields.select(F.col("f")[0].cast("long").alias("u"), F.col("f")[1].cast("long").alias("v")).filter("u <> v")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return Graph.of(with_labels(ids, labels, seed), pairs)


def with_labels(ids: DataFrame, labels: int, seed: int = 0) -> DataFrame:
    """id and a label below ``labels``, uniform and always the same for an id."""
    return ids.select("id", (seeded(F.col("id"), seed) % labels).cast("int").alias("label"))


def relabel(g: Graph, labels: int, seed: int = 0) -> Graph:
    return Graph.of(with_labels(g.vertices.select("id"), labels, seed), g.edges.filter("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v")))


def sample_edges(g: Graph, per_mille: int, seed: int = 0) -> Graph:
    """Keeps each undirected edge with a probability of so many thousandths; all vertices stay."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    number = (a % 1_000_003 * 1_000_003 + b) % 1_000_000_007
    return Graph(g.vertices, g.edges.filter(bernoulli(number, per_mille, seed)))
