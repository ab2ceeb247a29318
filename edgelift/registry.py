"""All queries of the engine by name, with the SQL they are checked against."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelift import api, fixtures, oracle
from edgelift.functions import bernoulli, seeded_sql
from edgelift.model import Graph, Query
from edgelift.operators import dense, growth, matching, scans, statistics, walks
from edgelift.plans import nuclei as plan_nuclei
from edgelift.plans import order as plan_order
from edgelift.plans import query_graph
from edgelift.sources import convert, csr, results, text

Make = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Make] = {}
ORACLES: dict[str, str] = {}
K = 5


def register(name: str, fixture: str | None, sql: str | None = None, *more: str):
    """Adds a function of the graph (or, without fixture, of session and folder)."""

    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(fixtures.graph(spark, sf_dir, fixture))) if fixture else f
        if sql:
            ORACLES[name] = oracle.over(fixture, sql, *more) if fixture else sql
        return f

    return add


T = fixtures.template
LONG = "CAST(count(*) AS BIGINT)"

# graphs and statistics
register("het_vertices", "het", "SELECT id, label FROM vertices")(lambda g: g.vertices)
register("het_metadata", "het", f"SELECT (SELECT {LONG} FROM vertices) AS vertices, (SELECT {LONG} FROM pairs) AS edges, (SELECT CAST(count(DISTINCT label) AS BIGINT) FROM vertices) AS labels, (SELECT CAST(max(n) AS BIGINT) FROM (SELECT count(*) n FROM edges GROUP BY src)) AS max_degree, (SELECT CAST(max(n) AS BIGINT) FROM (SELECT count(*) n FROM vertices GROUP BY label)) AS max_label_frequency")(statistics.metadata)
for kind in ("het", "cop"):
    register(f"{kind}_edges_stats", kind, f"SELECT least(src_label, dst_label) AS a, greatest(src_label, dst_label) AS b, {LONG} AS n FROM edges WHERE src < dst GROUP BY 1, 2")(statistics.label_pairs)
register("degree", "het", f"SELECT id, label, CAST(coalesce(n, 0) AS BIGINT) AS degree FROM vertices LEFT JOIN (SELECT src, {LONG} AS n FROM edges GROUP BY src) ON id = src")(statistics.degrees)
register("label_frequency", "het", f"SELECT label, {LONG} AS n FROM vertices GROUP BY label")(statistics.label_frequency)
register("vertices_by_label", "het", "SELECT id FROM vertices WHERE label = 1")(lambda g: g.of_label(1))
register("nlf", "het", f"SELECT src AS id, dst_label AS label, {LONG} AS n FROM edges GROUP BY 1, 2")(statistics.neighbour_labels)
register("neighbours", "het", "SELECT src, dst FROM edges WHERE src_label = 0 AND dst_label = 3")(lambda g: statistics.neighbours(g, g.of_label(0), 3))
register("adjacency_by_label", "het", f"SELECT src, dst_label, {LONG} AS n, min(dst) AS least, max(dst) AS most FROM edges GROUP BY 1, 2")(lambda g: statistics.adjacency(g).select("src", "dst_label", F.size("neighbours").cast("long").alias("n"), F.col("neighbours")[0].alias("least"), F.element_at("neighbours", -1).alias("most")))
register("neighbour_position", "het", "SELECT src, dst_label, dst, row_number() OVER (PARTITION BY src, dst_label ORDER BY dst) - 1 AS place FROM edges")(statistics.positions)


def _nation_pairs(g: Graph) -> DataFrame:
    return g.of_label(1).select(F.col("id").alias("head")).crossJoin(g.of_label(0).select(F.col("id").alias("tail")))


_PAIRS = "SELECT a.id AS head, b.id AS tail FROM vertices a, vertices b WHERE a.label = 1 AND b.label = 0"
register("edge_exists", "het", f"SELECT * FROM ({_PAIRS}) p WHERE EXISTS (SELECT 1 FROM edges x WHERE x.src = p.head AND x.dst = p.tail)")(lambda g: statistics.existing(g, _nation_pairs(g)))
register("edge_missing", "het", f"SELECT * FROM ({_PAIRS}) p WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.src = p.head AND x.dst = p.tail)")(lambda g: statistics.existing(g, _nation_pairs(g), present=False))

# scans, projections, filters
register("label_pair_scan", "het", "SELECT src, dst FROM edges WHERE src_label = 2 AND dst_label = 1")(lambda g: scans.scan(g, 2, 1))
register("candidate_scan", "het", f"SELECT src, dst FROM edges WHERE src IN (SELECT src FROM edges WHERE src_label = 1 GROUP BY src HAVING count(*) >= 100) AND dst_label = 2 AND dst IN (SELECT src FROM edges WHERE src_label = 2 GROUP BY src HAVING count(*) >= 20)")(lambda g: scans.candidate_scan(Graph(g.vertices, g.edges.filter("dst_label = 2")), statistics.degrees(g).filter("label = 1 and degree >= 100").select("id"), statistics.degrees(g).filter("label = 2 and degree >= 20").select("id")))
register("query_scan", "het", " UNION ALL ".join(f"SELECT {i} AS edge_no, {LONG} AS n FROM edges WHERE src_label = {T('c4').labels[u]} AND dst_label = {T('c4').labels[v]}" for i, (u, v) in enumerate(T("c4").edges)))(lambda g: _counted(scans.scan_query(g, T("c4")), T("c4")))


def _counted(relations: dict, q: Query) -> DataFrame:
    out = None
    for i, e in enumerate(q.edges):
        part = relations[e].agg(F.count("*").alias("n")).select(F.lit(i).alias("edge_no"), "n")
        out = part if out is None else out.unionByName(part)
    return out


register("distinct_projection", "het", "SELECT DISTINCT dst AS id FROM edges WHERE src_label = 3 AND dst_label = 2")(lambda g: scans.project(scans.scan(g, 3, 2), "dst"))
register("projection_intersect", "het", "SELECT dst AS id FROM edges WHERE src_label = 3 AND dst_label = 0 INTERSECT SELECT dst FROM edges WHERE src_label = 1 AND dst_label = 0")(lambda g: scans.project_all([(scans.scan(g, 3, 0), "dst"), (scans.scan(g, 1, 0), "dst")]))
_HUB = Query("hub", (0, 1, 1, 2), ((0, 1), (0, 2), (0, 3)))
register("degree_filter", "cop", "SELECT id FROM vertices WHERE label = 0 AND (SELECT count(*) FROM edges WHERE src = id) >= 3")(lambda g: scans.degree_filter(g, _HUB, 0))
register("nlf_filter", "cop", "SELECT src AS id FROM edges WHERE src_label = 0 GROUP BY src HAVING count(*) FILTER (dst_label = 1) >= 2 AND count(*) FILTER (dst_label = 2) >= 1")(lambda g: scans.neighbour_label_filter(g, _HUB, 0))
register("semi_join", "het", "SELECT src, dst FROM edges WHERE src_label = 2 AND dst_label = 1 AND dst IN (SELECT src FROM edges WHERE src_label = 1 AND dst_label = 0)")(lambda g: scans.semi_join(scans.scan(g, 2, 1), "dst", scans.scan(g, 1, 0), "src").select("src", "dst"))
register("semi_join_count", "het", "SELECT CAST(count(DISTINCT dst) AS BIGINT) AS n FROM edges WHERE src_label = 2 AND dst_label = 1")(lambda g: scans.scan(g, 2, 1).agg(F.countDistinct("dst").alias("n")))
_CHAIN = Query("chain", (3, 2, 1), ((0, 1), (1, 2)))
register("full_reducer", "het", "SELECT src, dst FROM edges WHERE src_label = 3 AND dst_label = 2 AND dst IN (SELECT DISTINCT src FROM edges WHERE src_label = 2 AND dst_label = 1)")(lambda g: scans.full_reducer(scans.scan_query(g, _CHAIN), _CHAIN)[0, 1].select("src", "dst"))
register("refine_candidates", "het", "SELECT id FROM vertices WHERE label = 2 AND id IN (SELECT DISTINCT src FROM edges WHERE src_label = 2 AND dst_label = 1) AND id IN (SELECT DISTINCT src FROM edges WHERE src_label = 2 AND dst_label = 3)")(lambda g: scans.refine(g, _CHAIN)[1])
register("hash_join_1key", "het", f"SELECT a.src AS part, {LONG} AS n FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src_label = 2 AND a.dst_label = 1 AND b.dst_label = 0 GROUP BY 1")(lambda g: scans.hash_join(scans.scan(g, 2, 1).toDF("part", "k"), scans.scan(g, 1, 0).toDF("k", "nation"), ["k"]).groupBy("part").agg(F.count("*").alias("n")))
register("hash_join_2key", "het", f"SELECT {LONG} AS n FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src_label = 2 AND a.dst_label = 3")(lambda g: scans.hash_join(scans.scan(g, 2, 3).toDF("x", "y"), scans.scan(g, 3, 2).toDF("y", "x"), ["x", "y"]).agg(F.count("*").alias("n")))
_SAME = "SELECT a.src AS head, b.src AS tail, {} AS n FROM edges a JOIN edges b ON a.dst = b.dst WHERE a.src_label = 0 AND b.src_label = 0 AND a.src < b.src GROUP BY 1, 2"


def _label_pairs(g: Graph, label: int) -> DataFrame:
    ids = g.of_label(label)
    return ids.select(F.col("id").alias("head")).join(ids.select(F.col("id").alias("tail")), F.col("head") < F.col("tail"))


_SUPPLIERS = _SAME.replace("a.src_label = 0 AND b.src_label = 0", "a.src_label = 1 AND b.src_label = 1")
register("set_intersect", "het", _SUPPLIERS.format(LONG))(lambda g: scans.common_neighbours(g, 1))
register("set_except", "het", f"SELECT p.head, p.tail, CAST((SELECT count(*) FROM edges WHERE src = p.head) - coalesce(s.n, 0) AS BIGINT) AS n FROM (SELECT a.id AS head, b.id AS tail FROM vertices a, vertices b WHERE a.label = 0 AND b.label = 0 AND a.id < b.id AND a.id IN (SELECT src FROM edges) AND b.id IN (SELECT src FROM edges)) p LEFT JOIN ({_SAME.format(LONG)}) s USING (head, tail)")(lambda g: scans.except_neighbours(g, _label_pairs(g, 0)))

# matching
for q, kind in (("path3", "het"), ("c4", "het"), ("tri", "cop"), ("k4e", "cop"), ("paw", "cop")):
    register(f"match_{q}", kind, f"SELECT {LONG} AS matches FROM ({oracle.pattern(T(q), [0])})")(lambda g, q=T(q): matching.count_matches(g, q))
register("output_limit", "het", f"SELECT least({LONG}, 1000) AS n FROM ({oracle.pattern(T('path3'), [0])})")(lambda g: matching.match_rows(g, T("path3"), limit=1000).agg(F.count("*").alias("n")))


def _depths(q: Query) -> str:
    order = plan_order.best_order(q)
    parts = [f"SELECT {i} AS depth, {u} AS vertex, {LONG} AS partial FROM ({oracle.pattern(q.induced(order[: i + 1])[0], [0])})" for i, u in enumerate(order)]
    return " UNION ALL ".join(parts)


for q in ("c4", "k4e"):
    kind = "het" if q == "c4" else "cop"
    register(f"depth_counts_{q}", kind, _depths(T(q)))(lambda g, q=T(q): matching.depth_counts(g, q))
    ends = [f"SELECT {i} AS edge_no, {LONG} AS n, CAST(count(DISTINCT src) AS BIGINT) AS heads, CAST(count(DISTINCT dst) AS BIGINT) AS tails FROM edges WHERE src_label = {T(q).labels[u]} AND dst_label = {T(q).labels[v]}" for i, (u, v) in enumerate(T(q).edges)]
    register(f"query_cardinalities_{q}", kind, " UNION ALL ".join(ends))(lambda g, q=T(q): statistics.cardinalities(g, q))
register("hash_plan_c4", "het", f"SELECT {LONG} AS matches FROM ({oracle.pattern(T('c4'), [0])})")(lambda g: matching.hash_plan(g, T("c4"), "[[0, 1], [2, 3]]").agg(F.count("*").alias("matches")))
register("hash_plan_tri", "cop", oracle.pattern(T("tri")))(lambda g: matching.hash_plan(g, T("tri"), [[0, 1], 2]))
register("match_rows_path3", "het", oracle.pattern(T("path3")))(lambda g: matching.match_rows(g, T("path3")))
_WALK3 = Query("walk3", (0, 1, 0), ((0, 1), (1, 2)))
register("homomorphism_triangle_path", "cop", f"SELECT {LONG} AS matches FROM ({oracle.pattern(_WALK3, [0], False)})")(lambda g: matching.count_matches(g, _WALK3, injective=False))

# growth, residual connected
for q, kind in (("c4", "het"), ("tri", "cop"), ("k4e", "cop"), ("paw", "cop")):
    register(f"crq_joint_{q}", kind, oracle.top(oracle.growth(T(q), 0), K))(lambda g, q=T(q): growth.joint(g, q, 0, K))
for q, kind in (("c4", "het"), ("k4e", "cop")):
    register(f"crq_lookahead_{q}", kind, oracle.top(oracle.growth(T(q), 0), K))(lambda g, q=T(q): growth.look_ahead(g, q, 0, K))
register("crq_refined_tri", "cop", oracle.top(oracle.growth(T("tri"), 0), K))(lambda g: growth.shrunk(g, T("tri"), 0, K))
register("crq_homomorphism_tri", "cop", oracle.top(oracle.growth(T("tri"), 1, False), K))(lambda g: growth.joint(g, T("tri"), 1, K, injective=False))

# growth, residual in two parts
register("drq_probe_path4", "het", oracle.top(oracle.growth(T("path4"), 1), K))(lambda g: growth.probe(g, T("path4"), 1, K))
register("drq_ie_path4", "het", oracle.top(oracle.growth(T("path4"), 1), K))(lambda g: growth.inclusion_exclusion(g, T("path4"), 1, K))
register("drq_single_path3", "het", oracle.top(oracle.growth(T("path3"), 0), K))(lambda g: growth.inclusion_exclusion(g, T("path3"), 0, K))
register("drq_product_path4d", "het", oracle.top(oracle.growth(T("path4d"), 1), K))(lambda g: growth.product_only(g, T("path4d"), 1, K))
register("drq_ie_paw", "cop", oracle.top(oracle.growth(T("paw"), 3), K))(lambda g: growth.inclusion_exclusion(g, T("paw"), 3, K))
_SHARED = Query("shared", (2, 1, 1, 2), ((0, 1), (1, 2), (2, 3)))
_ENDS = "a AS (SELECT src AS v0, dst AS v1 FROM edges WHERE src_label = 2 AND dst_label = 1)"
register(
    "drq_bounds",
    "het",
    "SELECT l.v1 AS head, r.v1 AS tail, CAST(greatest(0, l.n * r.n - coalesce(m.n, 0)) AS BIGINT) AS lower, CAST(l.n * r.n AS BIGINT) AS upper FROM (SELECT v1, count(*) n FROM a GROUP BY 1) l CROSS JOIN (SELECT v1, count(*) n FROM a GROUP BY 1) r "
    "LEFT JOIN (SELECT x.v1 AS h, y.v1 AS t, count(*) n FROM a x JOIN a y ON x.v0 = y.v0 GROUP BY 1, 2) m ON m.h = l.v1 AND m.t = r.v1 WHERE l.v1 <> r.v1",
    _ENDS,
)(lambda g: growth.bounds(g, _SHARED, 1))
register("usage_counts", "het", f"SELECT v1 AS head, 2 AS label, v0 AS vertex, {LONG} AS n FROM a GROUP BY 1, 3 UNION ALL SELECT v1, 1, v1, {LONG} FROM a GROUP BY 1", _ENDS)(lambda g: growth.Split(g, _SHARED, 1).usage(0))
register("part_totals", "het", f"SELECT v1 AS head, {LONG} AS n FROM a GROUP BY 1", _ENDS)(lambda g: growth.Split(g, _SHARED, 1).totals(0))


def _orders_c4(edge_no: int) -> list[int]:
    return plan_order.best_order(T("c4").without(edge_no))


# estimates
_N = 20_000


def _walk_sql(name: str, q: Query, edge_no: int, order: list[int], seed: int = 0, least: int = 1) -> tuple[str, ...]:
    b, t = q.edges[edge_no]
    chain = oracle.walk(q.without(edge_no), order, b, t, _N, seed)
    return (oracle.top(oracle.estimate(f"walk{len(chain) - 1}", b, t, _N, least), K), *chain)


register("rwc_c4", "het", *_walk_sql("rwc_c4", T("c4"), 0, _orders_c4(0)))(lambda g: walks.rwc(g, T("c4"), 0, K, _N, 0, 1))
register("rwc_least_tri", "cop", *_walk_sql("rwc", T("tri"), 0, plan_order.best_order(T("tri").without(0)), 3, 2))(lambda g: walks.rwc(g, T("tri"), 0, K, _N, 3, 2))
register("rwd_path4", "het", *_walk_sql("rwd", T("path4"), 1, walks.rwd_order(T("path4"), 1)))(lambda g: walks.rwd(g, T("path4"), 1, K, _N))


def _rwch_sql(q: Query, edge_no: int, n: int, samples: int) -> tuple[str, ...]:
    b, t = q.edges[edge_no]
    rest = q.without(edge_no)
    order = plan_order.best_order(rest)
    part, new = rest.induced(order[:n])
    number = "0"
    for u in sorted(order[:n]):
        number = f"(({number} * 31 + v{u}) % 1000003)"
    named = ", ".join(f"v{new[u]} AS v{u}" for u in order[:n])
    start = f"SELECT {seeded_sql(f'({number} * {samples} + s.range)')} AS state, CAST(1 AS BIGINT) AS w, {', '.join(f'v{u}' for u in order[:n])} FROM (SELECT {named} FROM ({oracle.pattern(part)})), range({samples}) s"
    chain = oracle.walk(rest, order, b, t, samples, 0, start, order[:n])
    return (oracle.top(oracle.estimate(f"walk{len(chain) - 1}", b, t, samples, 1), K), *chain)


register("rwch_c4", "het", *_rwch_sql(T("c4"), 1, 2, 10))(lambda g: walks.rwch(g, T("c4"), 1, K, 10, 0, 1, 2))
register("rwdw_path4", "het")(lambda g: walks.rwdw(g, T("path4"), 1, K, _N))
_WEIGHTED = "e AS (SELECT src AS head, dst AS tail, src % 7 + 1 AS weight FROM edges WHERE src_label = 1 AND dst_label = 0), spans AS (SELECT *, sum(weight) OVER (ORDER BY head, tail) AS hi FROM e)"
register("weighted_draw", "het", f"SELECT i.range AS draw, head, tail, weight FROM range(1000) i JOIN spans ON {seeded_sql('i.range', 5)} % (SELECT sum(weight) FROM e) >= hi - weight AND {seeded_sql('i.range', 5)} % (SELECT sum(weight) FROM e) < hi", _WEIGHTED)(lambda g: walks.weighted_draw(scans.scan(g, 1, 0).select(F.col("src").alias("head"), F.col("dst").alias("tail"), (F.col("src") % 7 + 1).alias("weight")), "weight", 1000, 5))

# converters
register("relabel", "cop", f"SELECT id, CAST({seeded_sql('id', 1)} % 6 AS INTEGER) AS label FROM vertices")(lambda g: convert.relabel(g, 6, 1).vertices)
register("edge_sample", "cop", f"SELECT src, dst FROM edges WHERE {seeded_sql('((least(src, dst) % 1000003 * 1000003 + greatest(src, dst)) % 1000000007)', 2)} % 1000 < 300")(lambda g: convert.sample_edges(g, 300, 2).edges.select("src", "dst"))

# dense parts of the data graph
_TRI = "t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst WHERE x.src < x.dst AND y.src < y.dst)"
register("triangle_support", "cop", f"SELECT u, v, {LONG} AS support FROM (SELECT a AS u, b AS v FROM t UNION ALL SELECT a, c FROM t UNION ALL SELECT b, c FROM t) GROUP BY 1, 2", _TRI)(dense.triangle_support)
register("four_clique_count", "cop", f"SELECT a, b, c, {LONG} AS n FROM (SELECT unnest([{{'a': q.a, 'b': q.b, 'c': q.c}}, {{'a': q.a, 'b': q.b, 'c': q.d}}, {{'a': q.a, 'b': q.c, 'c': q.d}}, {{'a': q.b, 'b': q.c, 'c': q.d}}], recursive := true) FROM (SELECT x.a, x.b, x.c, y.c AS d FROM t x JOIN t y ON x.a = y.a AND x.b = y.b AND x.c < y.c JOIN edges e ON e.src = x.c AND e.dst = y.c) q) GROUP BY 1, 2, 3", _TRI)(dense.four_clique_counts)
register("two_core_data", "cop", *oracle.two_core())(lambda g: dense.k_core(g, 2))
register("truss_data", "cop", "SELECT a AS u, b AS v FROM t UNION SELECT a, c FROM t UNION SELECT b, c FROM t", _TRI)(lambda g: dense.k_truss(g, 1))  # at 1 nothing falls after the first round
register("truss_data_deep", "cop", *oracle.truss(3))(lambda g: dense.k_truss(g, 3))

# sums over all edges, checks of estimates
_ALL = " UNION ALL ".join(f"({oracle.growth(T('tri'), i)})" for i in range(3))
register("total_growth_tri", "cop", oracle.top(f"SELECT least(head, tail) AS u, greatest(head, tail) AS v, CAST(sum(inc_cnt) AS BIGINT) AS growth FROM ({_ALL}) GROUP BY 1, 2", K, "growth", "u", "v"))(lambda g: growth.total_growth(g, T("tri"), K))
def _estimate_error(g: Graph) -> DataFrame:
    """The exact counts are made for the estimated pairs, which the error is about, and for no others."""
    estimated = walks.rwc(g, T("c4"), 0, None, _N, 0, 1).persist()
    return growth.relative_error(estimated, growth.growth_of(g, T("c4"), 0, estimated))


_C4 = T("c4").edges[0]
_CHAIN_C4 = oracle.walk(T("c4").without(0), _orders_c4(0), *_C4, _N, 0)
register(
    "estimate_error_c4",
    "het",
    f"SELECT x.head, x.tail, x.inc_cnt AS exact, y.inc_cnt AS estimate, CAST(abs(y.inc_cnt - x.inc_cnt) * 1000 // x.inc_cnt AS BIGINT) AS per_mille FROM ({oracle.growth(T('c4'), 0)}) x JOIN ({oracle.estimate(f'walk{len(_CHAIN_C4) - 1}', *_C4, _N, 1)}) y USING (head, tail)",
    *_CHAIN_C4,
)(lambda g: _estimate_error(g))
register("growth_of_pairs", "het", f"SELECT * FROM ({oracle.growth(T('c4'), 0)}) WHERE (head, tail) IN (SELECT head, tail FROM ({oracle.top(oracle.growth(T('c4'), 0), K)}))")(lambda g: growth.growth_of(g, T("c4"), 0, growth.joint(g, T("c4"), 0, K)))
register("growth_of_pairs_path4", "het", f"SELECT * FROM ({oracle.growth(T('path4'), 1)}) WHERE (head, tail) IN (SELECT head, tail FROM ({oracle.top(oracle.growth(T('path4'), 1), 20)}))")(lambda g: growth.growth_of(g, T("path4"), 1, growth.inclusion_exclusion(g, T("path4"), 1, 20).select("head", "tail")))
register(
    "perturb_path3",
    "het",
    " UNION ALL ".join(f"SELECT 'path3' AS query, {i} AS edge_no, {b} AS q_begin, {t} AS q_end, head, tail, inc_cnt FROM ({oracle.top(oracle.growth(T('path3'), i), K)})" for i, (b, t) in enumerate(T("path3").edges)),
)(lambda g: api.perturb(g, T("path3"), k=K))


# plans: small frames made on the driver
def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(str(r) for r in rows)}) t({columns})"


register("core_numbers_query", None, _values("query, u, core", [("c4", 0, 2), ("c4", 1, 2), ("c4", 2, 2), ("c4", 3, 2), ("paw", 0, 2), ("paw", 1, 2), ("paw", 2, 2), ("paw", 3, 1)]))(lambda spark, _: _rows(spark, [(n, u, k) for n in ("c4", "paw") for u, k in enumerate(query_graph.core_numbers(T(n)))], "query string, u int, core int"))
register("nuclei_query", None)(lambda spark, _: _rows(spark, [(n, r, k, v, d) for n in fixtures.TEMPLATES for r in (1, 2, 3) for k, v, d in plan_nuclei.report(T(n), r)], "query string, r int, number int, vertices array<int>, density double"))
register("matching_order", None)(lambda spark, _: _rows(spark, [(n, plan_order.best_order(T(n)), plan_order.Plan(T(n), tuple(plan_order.best_order(T(n)))).to_json()) for n in fixtures.TEMPLATES], "query string, ordered array<int>, plan string"))
register("components_query", None, _values("query, edge_no, parts", [("paw", 0, 1), ("paw", 1, 1), ("paw", 2, 1), ("paw", 3, 2), ("path3", 0, 2), ("path3", 1, 2)]))(lambda spark, _: _rows(spark, [(n, i, len(query_graph.components(T(n).without(i)))) for n in ("paw", "path3") for i in range(len(T(n).edges))], "query string, edge_no int, parts int"))
register("edge_classes_query", None, _values("query, u, v, class", [("paw", 0, 1, "core"), ("paw", 1, 2, "core"), ("paw", 0, 2, "core"), ("paw", 2, 3, "leaf")]))(lambda spark, _: _rows(spark, [("paw", u, v, c) for (u, v), c in query_graph.edge_classes(T("paw")).items()], "query string, u int, v int, class string"))


# files
def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return tempfile.mkdtemp(dir=shared.removeprefix("file:") if shared and os.path.isdir(shared.removeprefix("file:")) else None)


@register("read_graph_text", "het", f"SELECT {LONG} AS n, CAST(sum(src % 1000 * (dst % 1000)) AS BIGINT) AS mark FROM edges")
def _text_round_trip(g: Graph) -> DataFrame:
    spark = g.edges.sparkSession
    path = f"{_folder(spark)}/graph"
    text.write_graph(g, f"file:{path}")
    return text.read_graph(spark, f"file:{path}").edges.agg(F.count("*").alias("n"), F.sum(F.col("src") % 1000 * (F.col("dst") % 1000)).alias("mark"))


@register("write_read_csr", "cop", f"SELECT {LONG} AS n, CAST(sum((src - lo) * (dst - lo)) AS BIGINT) AS mark FROM edges, (SELECT min(id) AS lo FROM vertices)")
def _csr_round_trip(g: Graph) -> DataFrame:
    spark = g.edges.sparkSession
    low = g.vertices.agg(F.min("id")).first()[0]  # ids run on from it
    moved = Graph(g.vertices.select((F.col("id") - low).alias("id"), "label"), g.edges.withColumns({"src": F.col("src") - low, "dst": F.col("dst") - low}))
    prefix = f"{_folder(spark)}/graph"
    csr.write_graph(moved, prefix)
    return csr.read_graph(spark, f"file:{prefix}").edges.agg(F.count("*").alias("n"), F.sum(F.col("src") * F.col("dst")).alias("mark"))


@register("text_to_csr", "cop", f"SELECT {LONG} AS n, CAST(sum((src - lo) * (dst - lo)) AS BIGINT) AS mark FROM edges, (SELECT min(id) AS lo FROM vertices)")
def _text_to_csr(g: Graph) -> DataFrame:
    spark = g.edges.sparkSession
    low = g.vertices.agg(F.min("id")).first()[0]
    moved = Graph(g.vertices.select((F.col("id") - low).alias("id"), "label"), g.edges.withColumns({"src": F.col("src") - low, "dst": F.col("dst") - low}))
    folder = _folder(spark)
    text.write_graph(moved, f"file:{folder}/text")
    csr.text_to_csr(spark, f"file:{folder}/text", f"{folder}/graph")
    return csr.read_graph(spark, f"file:{folder}/graph").edges.agg(F.count("*").alias("n"), F.sum(F.col("src") * F.col("dst")).alias("mark"))


@register("store_load_parquet", "het", "SELECT src, dst FROM edges WHERE src_label = 1 AND dst_label = 0")
def _parquet_round_trip(g: Graph) -> DataFrame:
    path = f"file:{_folder(g.edges.sparkSession)}/store"
    g.store(path)
    return Graph.load(g.edges.sparkSession, path).pair(1, 0)


@register("result_sink", "het", f"SELECT head, tail, inc_cnt FROM ({oracle.top(oracle.growth(T('path3'), 0), K)})")
def _sink(g: Graph) -> DataFrame:
    path = f"file:{_folder(g.edges.sparkSession)}/result"
    results.append(api.perturb(g, T("path3"), 0, K), path)
    return results.read(g.edges.sparkSession, path).select("head", "tail", "inc_cnt")


register("bernoulli_rate", "het", f"SELECT {LONG} AS n FROM vertices WHERE {seeded_sql('id', 9)} % 1000 < 100")(lambda g: g.vertices.filter(bernoulli(F.col("id"), 100, 9)).agg(F.count("*").alias("n")))


def queries() -> dict[str, Make]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
