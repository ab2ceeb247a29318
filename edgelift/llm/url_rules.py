"""Allow and block rules for urls, by a sort-merge range join.

A rule (host, path) fits the urls of its host and all subdomains whose path
starts with the rule's.  Host labels in reversed order, then the path, make a
key under which everything that a rule fits, seen at the rule's number of
labels, lies in one interval that starts at the rule's own key.  These
intervals are nested or disjoint.  Rules and urls are range-partitioned and
sorted by key together; the sweep carries the stack of rules that are open at
the last rule passed, and a url's rules are those of the stack that it fits.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = "\u0001"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(labels)), F.lit(_END), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """key, labels and stack of each rule: the rules, itself included, whose interval holds its key.

    Of rules with the same host and path one stays, a block if there is one.
    """
    rules = rules.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    keyed = materialize(rules.select("host", "path", "verdict", F.size(F.split("host", r"\.")).alias("labels"), _key(F.split("host", r"\."), F.col("path")).alias("key")), "rules")
    # lengths of keys: at most as many as the longest key has characters
    lengths = keyed.agg(F.sort_array(F.collect_set(F.length("key")))).first()[0]
    outer = keyed.select("key", F.col("labels"), F.explode(F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length("key"))).alias("n") if lengths else F.lit(0).alias("n"))
    parts = outer.select("key", "labels", F.substring("key", F.lit(1), F.col("n")).alias("prefix"))
    open_rule = F.struct(F.col("host"), F.col("path"), F.col("verdict"))
    return parts.join(keyed.select(F.col("key").alias("prefix"), open_rule.alias("rule")), "prefix").groupBy("key", "labels").agg(F.collect_list("rule").alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    rules: verdict, host, path.  The longest rule (host and path together)
    that fits wins; without one, ``rule`` is null and ``verdict`` is
    ``default``.  A null url, or one without ``://``, has an empty host and
    path.  Repeated rows are kept; no rules or no pages are fine; further
    columns are not read.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url")
    stacks = materialize(rule_stacks(rules), "stacks")
    levels = [r[0] for r in stacks.select("labels").distinct().collect()]  # at most the labels of a host name
    urls = pages.filter("url is not null").select("url").distinct().select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    seen = urls.withColumn("level", F.explode(F.filter(F.array(*(F.lit(n) for n in levels)), lambda n: n <= F.size(labels)))) if levels else urls.withColumn("level", F.lit(1)).limit(0)
    suffix = F.slice(labels, F.size(labels) - F.col("level") + 1, F.col("level"))
    seen = seen.select(_key(suffix, F.col("path")).alias("key"), F.lit(1).alias("turn"), "url", F.concat_ws(".", suffix).alias("host"), "path")
    both = seen.unionByName(stacks.select("key", F.lit(0).alias("turn"), "stack"), allowMissingColumns=True)
    swept = both.repartitionByRange(width(spark), "key", "turn", "url").withColumn("part", F.spark_partition_id())
    swept = materialize(swept, "sweep")

    # the stack that a partition starts with: that of the last rule before it (one row a partition)
    heads = swept.groupBy("part").agg(F.max_by("stack", F.when(F.col("turn") == 0, F.col("key"))).alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("part", F.last("last", True).over(before).alias("carried"))
    inside = Window.partitionBy("part").orderBy("key", "turn", "url").rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.withColumn("stack", F.last("stack", True).over(inside)).filter("turn = 1").join(heads, "part")
    fits = F.filter(F.coalesce("stack", "carried"), lambda r: (r["host"] == F.col("host")) & F.col("path").startswith(r["path"]))
    ranked = F.transform(fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("size"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))
    best = swept.select("url", F.array_max(ranked).alias("best")).filter("best is not null").groupBy("url").agg(F.max("best").alias("best"))
    return pages.join(best, "url", "left").select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
