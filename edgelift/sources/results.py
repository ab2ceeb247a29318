"""Result files: query, edge_no, q_begin, q_end, head, tail, inc_cnt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "query string, edge_no int, q_begin int, q_end int, head long, tail long, inc_cnt long"


def append(result: DataFrame, path: str, kind: str = "csv") -> None:
    """Adds rows to a folder, without a header line."""
    result.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("append").format(kind).save(path)


def read(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    return spark.read.schema(SCHEMA).format(kind).load(path)
