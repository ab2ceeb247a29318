"""Quality of documents by hierarchical empirical Bayes.

A linear classifier gives each document log-odds.  Labels, and the classifier
where there is none, are summed by path (host and language) and host in
grouped aggregations; each level's mean is shrunk towards the level above with
a strength found by the method of moments.  A document's log-odds move by what
its path's posterior says beyond the global mean.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .linear import SAMPLE, Scorer, fit, labelled_sample

#: Paths up to which their table is broadcast (about 60 bytes each); beyond, it is joined.
MOST_BROADCAST = 100_000
THRESHOLD = 0.5
RESULTS = ["p_doc", "p_host", "p_path", "p_good", "keep"]


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _chance(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def with_evidence(rows: DataFrame, model) -> DataFrame:
    """``rows`` (text last) with z, the classifier's log-odds (0 without a model), in the text's place."""
    if model is None:
        return rows.drop("text").withColumn("z", F.lit(0.0))

    def score(batches):
        import pyarrow as pa

        scorer = Scorer([model])
        for batch in batches:
            found = [max(-12.0, min(12.0, scorer.logits(t.as_py())[0])) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*batch.schema.names[:-1], "z"])

    return rows.mapInArrow(score, T.StructType([*rows.schema.fields[:-1], T.StructField("z", T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE):
    found = labelled_sample(docs, labels, [label], sample)
    return fit(found, found.labels[0]) if found else None


def strength(groups: DataFrame, n: str, good: str) -> float:
    """Pseudo-documents of the level above, by the method of moments over the groups, within 1 and 10,000."""
    one = groups.agg(F.sum(n).alias("n"), F.sum(good).alias("good"), F.count("*").alias("groups"), F.sum(F.col(good) * F.col(good) / F.col(n)).alias("square")).first()
    if not one["n"] or one["groups"] < 2:
        return 100.0
    p = one["good"] / one["n"]
    within, between = p * (1 - p), (one["square"] - one["n"] * p * p) / one["n"]
    excess = between - within * one["groups"] / one["n"]
    return min(1e4, max(1.0, within / excess)) if excess > 0 and within > 0 else 1e4


def paths(scored: DataFrame, labels: DataFrame, label: str, host: str, path: str, z: str) -> tuple[DataFrame, float]:
    """One row a path: host, path and their posteriors; and the global mean.

    scored: doc_id and the named columns, z the log-odds.  A null host or path is a site of its own.
    """
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("double")).alias("_label"))
    seen = scored.join(known, "doc_id", "left").select(host, path, F.coalesce("_label", _chance(F.col(z))).alias("good"))
    by_path = materialize(seen.groupBy(host, path).agg(F.count("*").alias("n"), F.sum("good").alias("good")), "paths")
    by_host = by_path.groupBy(host).agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = by_path.agg(F.sum("n"), F.sum("good")).first()
    mean = min(1 - 1e-4, max(1e-4, total[1] / total[0])) if total[0] else 0.5
    k_host, k_path = strength(by_host, "host_n", "host_good"), strength(by_path, "n", "good")
    hosts = by_host.select(F.col(host).alias("_host"), ((F.col("host_good") + k_host * mean) / (F.col("host_n") + k_host)).alias("p_host"))
    joined = by_path.join(hosts, by_path[host].eqNullSafe(hosts["_host"]))
    return joined.select(host, path, "p_host", ((F.col("good") + k_path * F.col("p_host")) / (F.col("n") + k_path)).alias("p_path")), mean


def _judged(docs: DataFrame, labels: DataFrame, label: str, host: str, path: str, sample: int, threshold: float, columns: list[str]) -> DataFrame:
    """doc, the ``columns`` of a row of ``docs`` as a struct, and RESULTS.

    Texts are scored once and the rows written with their log-odds; but where
    the columns hold the texts, these are scored again rather than written.
    """
    model = train(docs, labels, label, sample)
    whole = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc")
    site = [F.col(host).alias("host"), F.col(path).alias("path")]
    scored = with_evidence(docs.select(*([] if "text" in columns else [whole]), F.col("doc_id").cast("long").alias("doc_id"), *site, "text"), model)
    scored = materialize(scored, "evidence")
    sites, mean = paths(scored, labels, label, "host", "path", "z")
    sites = materialize(sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "p_host", "p_path"), "sites")
    sites = F.broadcast(sites) if sites.count() <= MOST_BROADCAST else sites
    rows = with_evidence(docs.select(whole, *site, "text"), model) if "text" in columns else scored
    out = rows.join(sites, rows["host"].eqNullSafe(sites["_host"]) & rows["path"].eqNullSafe(sites["_path"]), "left")
    good = _chance(F.col("z") + _logit(F.col("p_path")) - math.log(mean / (1 - mean)))
    return out.select("doc", _chance(F.col("z")).alias("p_doc"), "p_host", "p_path", good.alias("p_good"), (good >= threshold).alias("keep"))


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", host: str = "source", path: str = "lang", sample: int = SAMPLE, threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` of ``docs`` (all) with p_doc, p_host, p_path, p_good and keep.

    docs: doc_id, text, ``host``, ``path`` and any others; those that bear the
    name of a result give way to it.  The path is any column that divides a
    host's documents; where a table knows no paths, as the default one, the
    language stands for it.  A null text counts as empty, a null host or path
    is a site of its own, a text of any length is read whole; repeated rows are
    judged each, equal ones alike; a document at the threshold stays; without
    labels all evidence is even and everything stays; an empty table gives no
    rows.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c not in RESULTS]
    return _judged(docs, labels, label, host, path, sample, threshold, columns).select("doc.*", *RESULTS)


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", host: str = "source", path: str = "lang", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns as they are."""
    return _judged(docs, labels, label, host, path, sample, threshold, docs.columns).filter("keep").select("doc.*")
