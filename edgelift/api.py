"""The engine's front door."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelift.model import Graph, Query
from edgelift.operators import growth, walks
from edgelift.operators.matching import count_matches
from edgelift.plans.query_graph import components

CONNECTED = {"joint": growth.joint, "lookahead": growth.look_ahead, "rwc": walks.rwc, "rwch": walks.rwch}
SPLIT = {"probe": growth.probe, "ie": growth.inclusion_exclusion, "rwd": walks.rwd, "rwdw": walks.rwdw}


def method_for(q: Query, edge_no: int, method: str = "auto") -> str:
    """The algorithm for an edge: exact by default; a method for the other kind of residual is an error."""
    connected = len(components(q.without(edge_no))) == 1
    if method == "auto":
        return "joint" if connected else "ie"
    if method not in (CONNECTED if connected else SPLIT):
        raise ValueError(f"{method} does not answer a residual that is {'connected' if connected else 'split'}")
    return method


def perturb(graph: Graph, query: Query, edge: int | None = None, k: int = 1, method: str | tuple[str, str] = "auto", samples: int | None = None, seed: int = 0, injective: bool = True, reduce: bool = True, min_success: int | None = None) -> DataFrame:
    """For each query edge (or one), the k pairs that would gain most matches.

    method: one name, or one for connected and one for split residuals.
    Returns query, edge_no, q_begin, q_end, head, tail, inc_cnt; ``head`` is
    always the image of ``q_begin``.
    """
    if len(components(query)) != 1:
        raise ValueError("the query is not connected")
    out = None
    for i in range(len(query.edges)) if edge is None else [edge]:
        connected = len(components(query.without(i))) == 1
        wanted = method if isinstance(method, str) else method[0 if connected else 1]
        name = method_for(query, i, wanted)
        options: dict = {"k": k}
        if name in ("rwc", "rwch", "rwd", "rwdw"):
            options |= {"seed": seed} | ({"samples": samples} if samples else {}) | ({"min_success": min_success} if min_success is not None else {})
        else:
            options["injective"] = injective
            if name == "joint":
                options["reduce"] = reduce
        part = (CONNECTED | SPLIT)[name](graph, query, i, **options)
        b, t = query.edges[i]
        part = part.select(F.lit(query.name).alias("query"), F.lit(i).alias("edge_no"), F.lit(b).alias("q_begin"), F.lit(t).alias("q_end"), "head", "tail", "inc_cnt")
        out = part if out is None else out.unionByName(part)
    return out


def total_growth(graph: Graph, query: Query, k: int | None = None) -> DataFrame:
    return growth.total_growth(graph, query, k)


def with_time_limit(action, frame: DataFrame, seconds: float):
    """``action(frame)``, cancelled after so many seconds; then a TimeoutError and no part of an answer."""
    return within(frame.sparkSession, seconds, lambda: action(frame))


def within(spark: SparkSession, seconds: float, action):
    """``action()`` with all jobs that it runs, those of planning too, cancelled after so many seconds."""
    context = spark.sparkContext
    over = threading.Event()
    tag = f"limited-{id(over)}"

    def cancel():
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel)
    context.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"no answer within {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


__all__ = ["CONNECTED", "SPLIT", "count_matches", "method_for", "perturb", "total_growth", "with_time_limit", "within"]
