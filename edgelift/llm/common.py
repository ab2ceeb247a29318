"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many of all rows.
HOT = 1000
#: Bytes of an Arrow batch, and the setting.
BATCH, _BATCH = "4194304b", "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only where
    that is unset (a local test session) a folder of this machine is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark.sparkContext, "_own_shared_dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="shared-")
            spark.sparkContext._own_shared_dir = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage: executors that are lost later cost no recomputation, and
    every reader sees the same rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(query):
    """``query(spark, ...)`` in a session whose Arrow batches hold at most ``BATCH`` bytes.

    Spark's default of 64 MB is held several times by each task, by the JVM
    beside its heap and by Python.  A limit that the session has set stays.
    """

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        if spark.conf.get(_BATCH) == "67108864b":
            spark.conf.set(_BATCH, BATCH)
        return query(spark, *args)

    return run


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def hot_keys(counts: DataFrame, key: str) -> DataFrame:
    """The keys that hold more than one in ``HOT`` of all rows: fewer than ``HOT``, so they may be broadcast.

    counts: ``key`` and its number of rows, ``n``.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") * HOT > total).select(key)


def split_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key; the rows of ``hot`` keys stay where they are.

    Only the rows of other keys are shuffled, so no task gets a large share of
    ``left``.  Both are read twice and should be written tables.
    """
    hot = F.broadcast(hot)
    stay = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
    return stay.unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def width(spark: SparkSession) -> int:
    """Number of partitions for an explicit exchange."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
