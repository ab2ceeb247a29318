"""Estimates by random walks.

A walk binds one query vertex after the other by one draw each, and its weight
is the product of the numbers of choices, that is one over its probability.
All arithmetic is on whole numbers from a seeded generator, so a run is
reproducible on any cluster.  Walks are rows; each step is a join with ranked
neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgelift.functions import seeded, step
from edgelift.model import Graph, Query
from edgelift.plans.order import best_order, sampling_prefix
from edgelift.plans.query_graph import components

from .growth import exact, top_k
from .matching import match, name

#: Walks of a prefix, endpoints of a side, and pairs that are sampled again.
PER_PREFIX, BEST_ENDS, BEST_PAIRS = 100, 200, 1000
#: Ids in one bucket of a ranking.
RANK_BUCKET = 65536


def ranked(ids: DataFrame, column: str = "id") -> DataFrame:
    """``column`` and its ``place`` from 0 in ascending order, without sorting all rows in one task."""
    rows = ids.select(column, F.floor(F.col(column) / RANK_BUCKET).cast("long").alias("_b"))
    # one row a bucket of ids
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(column)) - 1
    return rows.withColumn("_i", inside).join(before, "_b").select(column, (F.col("_i") + F.col("_before")).cast("long").alias("place"))


def draw_root(walks: DataFrame, g: Graph, q: Query, u: int, sets: dict[int, DataFrame] | None = None) -> DataFrame:
    """A vertex of u's label (or candidates), uniformly."""
    ids = sets[u] if sets and u in sets else g.of_label(q.labels[u])
    places = ranked(ids).select(F.col("id").alias(name(u)), "place")
    total = ids.agg(F.count("*").alias("_choices"))
    drawn = walks.crossJoin(total).filter("_choices > 0").withColumn("place", F.col("state") % F.col("_choices"))
    return drawn.join(places, "place").withColumn("w", F.col("w") * F.col("_choices")).withColumn("state", step(F.col("state"))).drop("place", "_choices")


def draw_neighbour(walks: DataFrame, g: Graph, q: Query, u: int, along: int) -> DataFrame:
    """A neighbour, of u's label, of the vertex bound to ``along``."""
    edges = g.pair(q.labels[along], q.labels[u])
    by = Window.partitionBy("src")
    places = edges.select(F.col("src").alias(name(along)), F.col("dst").alias(name(u)), (F.row_number().over(by.orderBy("dst")) - 1).cast("long").alias("place"), F.count("*").over(by).alias("_choices"))
    counts = edges.groupBy(F.col("src").alias(name(along))).agg(F.count("*").alias("_choices"))
    drawn = walks.join(counts, name(along)).withColumn("place", F.col("state") % F.col("_choices"))
    return drawn.join(places.drop("_choices"), [name(along), "place"]).withColumn("w", F.col("w") * F.col("_choices")).withColumn("state", step(F.col("state"))).drop("place", "_choices")


def walk(walks: DataFrame, g: Graph, q: Query, order: list[int], b: int, t: int, bound: list[int] = (), sets: dict[int, DataFrame] | None = None) -> DataFrame:
    """Walks (state, w and the bound vertices) that bind the rest of ``order`` and succeed.

    A walk fails when it has no choice, repeats a vertex, misses an edge of
    the residual, or when the images of b and t are adjacent.
    """
    done = list(bound)
    for u in order:
        if u in done:
            continue
        back = [v for v in done if v in q.neighbours(u)]
        walks = draw_neighbour(walks, g, q, u, back[0]) if back else draw_root(walks, g, q, u, sets)
        for v in done:
            if q.labels[v] == q.labels[u]:
                walks = walks.filter(F.col(name(v)) != F.col(name(u)))
        for v in back[1:]:
            known = g.pair(q.labels[v], q.labels[u]).select(F.col("src").alias(name(v)), F.col("dst").alias(name(u)))
            walks = walks.join(known, [name(v), name(u)], "left_semi")
        done.append(u)
        if u in (b, t) and b in done and t in done:
            known = g.pair(q.labels[b], q.labels[t]).select(F.col("src").alias(name(b)), F.col("dst").alias(name(t)))
            walks = walks.join(known, [name(b), name(t)], "left_anti")
    return walks


def started(spark: SparkSession, samples: int, seed: int) -> DataFrame:
    return spark.range(samples).select(seeded(F.col("id"), seed).alias("state"), F.lit(1).cast("long").alias("w"))


def estimate(walks: DataFrame, b: int, t: int, samples: int, min_success: int) -> DataFrame:
    """head, tail, inc_cnt = weight sum div samples, successes; pairs of too few successes are left out."""
    summed = walks.groupBy(F.col(name(b)).alias("head"), F.col(name(t)).alias("tail")).agg(F.sum("w").alias("w"), F.count("*").alias("successes"))
    return summed.filter(F.col("successes") >= min_success).select("head", "tail", F.expr(f"w div {int(samples)}").alias("inc_cnt"), "successes")


def rwc(g: Graph, q: Query, edge_no: int, k: int | None = None, samples: int = 20_000, seed: int = 0, min_success: int = 50, sets: dict[int, DataFrame] | None = None) -> DataFrame:
    """Connected residual: walks over a matching order."""
    b, t = q.edges[edge_no]
    rest = q.without(edge_no)
    if len(components(rest)) > 1:
        raise ValueError("the residual is not connected")
    found = walk(started(g.edges.sparkSession, samples, seed), g, rest, best_order(rest), b, t, sets=sets)
    return top_k(estimate(found, b, t, samples, min_success), k)


def rwch(g: Graph, q: Query, edge_no: int, k: int | None = None, samples: int = PER_PREFIX, seed: int = 0, min_success: int = 30, prefix: int | None = None) -> DataFrame:
    """Connected residual: the dense prefix is enumerated, the rest sampled so many times for each of its matches.

    When the prefix leaves out one vertex only, the answer is exact.
    """
    b, t = q.edges[edge_no]
    rest = q.without(edge_no)
    order = best_order(rest)
    n = sampling_prefix(rest, order) if prefix is None else prefix
    if n >= len(order) - 1:
        return exact(g, q, edge_no, k).withColumn("successes", F.col("inc_cnt"))
    part, new = rest.induced(order[:n])
    old = {i: u for u, i in new.items()}
    found = match(g, part, order=[new[u] for u in order[:n]])
    begun = found.select(*(F.col(name(i)).alias(f"_{u}") for i, u in old.items())).select(*(F.col(f"_{u}").alias(name(u)) for u in old.values()))
    if b in order[:n] and t in order[:n]:
        known = g.pair(rest.labels[b], rest.labels[t]).select(F.col("src").alias(name(b)), F.col("dst").alias(name(t)))
        begun = begun.join(known, [name(b), name(t)], "left_anti")
    number = F.lit(0).cast("long")
    for u in sorted(order[:n]):
        number = (number * 31 + F.col(name(u))) % 1_000_003
    walks = begun.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("state", seeded(number * samples + F.col("_s"), seed)).withColumn("w", F.lit(1).cast("long")).drop("_s")
    return top_k(estimate(walk(walks, g, rest, order, b, t, order[:n]), b, t, samples, min_success), k)


def rwd_order(q: Query, edge_no: int) -> list[int]:
    """From b through its part, then t and its part; a part of one vertex comes last."""
    b, t = q.edges[edge_no]
    parts = components(q.without(edge_no))
    mine, other = sorted(parts, key=lambda p: b not in p)
    first, second = ((b, mine), (t, other)) if len(mine) >= len(other) else ((t, other), (b, mine))
    out = []
    for root, part in (first, second):
        out.append(root)
        while len(out) < len(part) + (0 if root == first[0] else len(first[1])):
            out.append(next(v for v in sorted(part) if v not in out and set(q.without(edge_no).neighbours(v)) & set(out)))
    return out


def rwd(g: Graph, q: Query, edge_no: int, k: int | None = None, samples: int = 20_000, seed: int = 0, min_success: int = 1) -> DataFrame:
    """Two parts: walks through one part, a free draw of the other end, then through its part."""
    b, t = q.edges[edge_no]
    found = walk(started(g.edges.sparkSession, samples, seed), g, q.without(edge_no), rwd_order(q, edge_no), b, t)
    return top_k(estimate(found, b, t, samples, min_success), k)


def weighted_draw(pairs: DataFrame, weight: str, samples: int, seed: int = 0) -> DataFrame:
    """``pairs`` drawn ``samples`` times in proportion to a weight (long), with replacement; adds draw.

    For a bounded list of pairs: running sums make intervals, draws fall into them.
    """
    upto = F.sum(weight).over(Window.orderBy("head", "tail").rowsBetween(Window.unboundedPreceding, 0))
    spans = pairs.withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col(weight))
    total = pairs.agg(F.sum(weight).alias("_total"))
    draws = pairs.sparkSession.range(samples).select(F.col("id").alias("draw"), seeded(F.col("id"), seed).alias("_state")).crossJoin(total).withColumn("_at", F.col("_state") % F.col("_total"))
    return draws.join(spans, (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))).drop("_hi", "_lo", "_at", "_state", "_total")


def endpoint_weights(g: Graph, q: Query, edge_no: int, side: int, samples: int, seed: int) -> DataFrame:
    """head (or tail) and n, the estimated matches of its part, by walks from the end; rounded up, so that no end that a walk reached is lost."""
    b, t = q.edges[edge_no]
    end, new = ((b, "head"), (t, "tail"))[side]
    order = rwd_order(q, edge_no)
    part = next(p for p in components(q.without(edge_no)) if end in p)
    own = [u for u in order if u in part]
    found = walk(started(g.edges.sparkSession, samples, seed + side), g, q.without(edge_no), own, -1, -1)
    return found.groupBy(F.col(name(end)).alias(new)).agg(F.expr(f"(sum(w) + {int(samples) - 1}) div {int(samples)}").alias("n"))


def rwdw(g: Graph, q: Query, edge_no: int, k: int | None = None, samples: int = 20_000, seed: int = 0, min_success: int = 1, ends: int = BEST_ENDS, best: int = BEST_PAIRS) -> DataFrame:
    """Two parts: explore each part, keep the best ends, then re-sample their best pairs by weight."""
    b, t = q.edges[edge_no]
    rest = q.without(edge_no)
    sides = [endpoint_weights(g, q, edge_no, s, samples, seed) for s in (0, 1)]
    heads, tails = (s.orderBy(F.desc("n"), c).limit(ends) for s, c in zip(sides, ("head", "tail"), strict=True))
    known = g.pair(q.labels[b], q.labels[t]).select(F.col("src").alias("head"), F.col("dst").alias("tail"))
    pairs = heads.crossJoin(tails.withColumnRenamed("n", "n2")).withColumn("n", F.col("n") * F.col("n2")).drop("n2").filter("head <> tail").join(known, ["head", "tail"], "left_anti").orderBy(F.desc("n"), "head", "tail").limit(best)
    drawn = weighted_draw(pairs, "n", samples, seed).withColumnsRenamed({"head": name(b), "tail": name(t)})
    walks = drawn.withColumn("state", seeded(F.col("draw"), seed + 7)).withColumn("w", F.lit(1).cast("long")).select("state", "w", name(b), name(t), "draw")
    order = [u for u in rwd_order(q, edge_no) if u not in (b, t)]
    tries = walks.groupBy(F.col(name(b)).alias("head"), F.col(name(t)).alias("tail")).agg(F.count("*").alias("tries"))
    found = walk(walks, g, rest, order, -1, -1, [b, t])
    summed = found.groupBy(F.col(name(b)).alias("head"), F.col(name(t)).alias("tail")).agg(F.sum("w").alias("w"), F.count("*").alias("successes"))
    return top_k(summed.join(tries, ["head", "tail"]).filter(F.col("successes") >= min_success).select("head", "tail", F.expr("w div tries").alias("inc_cnt"), "successes"), k)


