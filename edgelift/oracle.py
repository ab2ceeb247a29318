"""SQL for the checks, written from the definitions and independent of the engine's plans."""

from __future__ import annotations

from edgelift.functions import seeded_sql, step_sql
from edgelift.model import Query

HET = """
vertices AS (SELECT CAST(n_nationkey AS BIGINT) * 4 AS id, 0 AS label FROM nation UNION ALL SELECT s_suppkey * 4 + 1, 1 FROM supplier
  UNION ALL SELECT p_partkey * 4 + 2, 2 FROM part UNION ALL SELECT c_custkey * 4 + 3, 3 FROM customer),
pairs AS (SELECT DISTINCT l_partkey * 4 + 2 AS u, l_suppkey * 4 + 1 AS v, 2 AS a, 1 AS b FROM lineitem
  UNION ALL SELECT DISTINCT s_suppkey * 4 + 1, CAST(s_nationkey AS BIGINT) * 4, 1, 0 FROM supplier
  UNION ALL SELECT DISTINCT c_custkey * 4 + 3, CAST(c_nationkey AS BIGINT) * 4, 3, 0 FROM customer
  UNION ALL SELECT DISTINCT o_custkey * 4 + 3, l_partkey * 4 + 2, 3, 2 FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
edges AS (SELECT u AS src, v AS dst, a AS src_label, b AS dst_label FROM pairs UNION ALL SELECT v, u, b, a FROM pairs)"""

COP = """
vertices AS (SELECT p_partkey AS id, p_size % 4 AS label FROM part),
lines AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
pairs AS (SELECT DISTINCT x.l_partkey AS u, y.l_partkey AS v FROM lines x JOIN lines y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey),
labelled AS (SELECT u, v, a.label AS a, b.label AS b FROM pairs JOIN vertices a ON a.id = u JOIN vertices b ON b.id = v),
edges AS (SELECT u AS src, v AS dst, a AS src_label, b AS dst_label FROM labelled UNION ALL SELECT v, u, b, a FROM labelled)"""

FIXTURES = {"het": HET, "cop": COP}


def over(fixture: str, body: str, *more: str) -> str:
    """A statement over a fixture's tables; more: further common tables."""
    recursive = "RECURSIVE " if any("UNION ALL SELECT i + 1" in x for x in more) else ""
    return f"WITH {recursive}{', '.join([FIXTURES[fixture], *more])}\n{body}"


def pattern(q: Query, keep: list[int] | None = None, injective: bool = True) -> str:
    """SELECT of all matches, as v0, v1, ...: one copy of edges for each query edge."""
    keep = list(range(len(q.labels))) if keep is None else keep
    at: dict[int, str] = {}
    tables, where = [], []
    for i, (u, v) in enumerate(q.edges):
        tables.append(f"edges e{i}")
        where += [f"e{i}.src_label = {q.labels[u]}", f"e{i}.dst_label = {q.labels[v]}"]
        for x, column in ((u, f"e{i}.src"), (v, f"e{i}.dst")):
            if x in at:
                where.append(f"{at[x]} = {column}")
            else:
                at[x] = column
    for u, label in enumerate(q.labels):
        if u not in at:
            tables.append(f"vertices x{u}")
            where.append(f"x{u}.label = {label}")
            at[u] = f"x{u}.id"
    n = len(q.labels)
    if injective:
        where += [f"{at[u]} <> {at[v]}" for u in range(n) for v in range(u + 1, n) if q.labels[u] == q.labels[v]]
    return f"SELECT {', '.join(f'{at[u]} AS v{u}' for u in keep)} FROM {', '.join(tables)} WHERE {' AND '.join(where)}"


def growth(q: Query, edge_no: int, injective: bool = True) -> str:
    """SELECT head, tail, inc_cnt by the definition."""
    b, t = q.edges[edge_no]
    return (
        f"SELECT v{b} AS head, v{t} AS tail, CAST(count(*) AS BIGINT) AS inc_cnt FROM ({pattern(q.without(edge_no), [b, t], injective)}) m "
        f"WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.src = m.v{b} AND x.dst = m.v{t}) GROUP BY 1, 2"
    )


def top(select: str, k: int, count: str = "inc_cnt", a: str = "head", b: str = "tail") -> str:
    return f"SELECT * FROM ({select}) ORDER BY {count} DESC, {a}, {b} LIMIT {k}"


def walk(q: Query, order: list[int], b: int, t: int, samples: int, seed: int, start: str | None = None, bound: list[int] = ()) -> list[str]:
    """Common tables walk0, walk1, ... with state, w and the bound vertices."""
    done = list(bound)
    out = [f"walk0 AS ({start or f'SELECT {seeded_sql("i.range", seed)} AS state, CAST(1 AS BIGINT) AS w FROM range({samples}) i'})"]
    for u in order:
        if u in done:
            continue
        back = [v for v in done if v in q.neighbours(u)]
        held = "".join(f", k.v{v}" for v in done)
        if back:
            lists = f"SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS place, count(*) OVER (PARTITION BY src) AS n FROM edges WHERE src_label = {q.labels[back[0]]} AND dst_label = {q.labels[u]}"
            join = f"p.src = k.v{back[0]} AND p.place = k.state % p.n"
        else:
            lists = f"SELECT id AS dst, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM vertices WHERE label = {q.labels[u]}"
            join = "p.place = k.state % p.n"
        where = [f"p.dst <> k.v{v}" for v in done if q.labels[v] == q.labels[u]]
        where += [f"EXISTS (SELECT 1 FROM edges x WHERE x.src = k.v{v} AND x.dst = p.dst)" for v in back[1:]]
        done.append(u)
        if u in (b, t) and b in done and t in done:
            other = t if u == b else b
            where.append(f"NOT EXISTS (SELECT 1 FROM edges x WHERE x.src = k.v{other} AND x.dst = p.dst)")
        out.append(f"walk{len(out)} AS (SELECT {step_sql('k.state')} AS state, CAST(k.w * p.n AS BIGINT) AS w{held}, p.dst AS v{u} FROM walk{len(out) - 1} k JOIN ({lists}) p ON {join}{' WHERE ' + ' AND '.join(where) if where else ''})")
    return out


def estimate(last: str, b: int, t: int, samples: int, min_success: int) -> str:
    return f"SELECT v{b} AS head, v{t} AS tail, CAST(sum(w) // {samples} AS BIGINT) AS inc_cnt, CAST(count(*) AS BIGINT) AS successes FROM {last} GROUP BY 1, 2 HAVING count(*) >= {min_success}"


def _rounds(name: str, columns: str, start: str, stays: str) -> tuple[str, str]:
    """(SELECT, common table) of the rows left when those without ``stays`` are removed round by round; nothing is left if every row goes."""
    table = f"{name} AS (SELECT 0 AS i, {columns} FROM {start} UNION ALL SELECT i + 1, {columns} FROM {name} WHERE ({columns}) IN ({stays}) AND EXISTS (SELECT 1 FROM {name} WHERE ({columns}) NOT IN ({stays})))"
    last = f"(SELECT {columns} FROM {name} WHERE i = (SELECT max(i) FROM {name}))"
    return f"SELECT {columns} FROM {last} l WHERE NOT EXISTS (SELECT 1 FROM {last} {name} WHERE ({columns}) NOT IN ({stays.replace(f'FROM {name}', f'FROM {last}')}))", table


def two_core(k: int = 2) -> tuple[str, str]:
    """SELECT and common table of the vertices of the k-core, by rounds."""
    many = f"SELECT src FROM core GROUP BY src HAVING count(*) >= {k}"
    body, table = _rounds("core", "src, dst", "edges", f"SELECT src, dst FROM core WHERE src IN ({many}) AND dst IN ({many})")
    return f"SELECT DISTINCT src AS id FROM ({body})", table


def truss(k: int) -> tuple[str, str]:
    """SELECT and common table of the edges of which each is on k triangles or more of the rest, by rounds."""
    found = "SELECT x.u AS a, x.v AS b, y.v AS c FROM truss x JOIN truss y ON x.v = y.u JOIN truss z ON z.u = x.u AND z.v = y.v"
    on = f"SELECT u, v FROM (SELECT unnest([{{'u': a, 'v': b}}, {{'u': a, 'v': c}}, {{'u': b, 'v': c}}], recursive := true) FROM ({found})) GROUP BY u, v HAVING count(*) >= {k}"
    return _rounds("truss", "u, v", "(SELECT src AS u, dst AS v FROM edges WHERE src < dst)", on)
