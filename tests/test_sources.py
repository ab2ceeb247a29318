"""Files: what is written is read again."""

from edgelift import cli
from edgelift.model import Graph
from edgelift.sources import convert, csr, results, text

LABELS, PAIRS = {0: 3, 1: 1, 2: 1, 3: 0, 4: 7}, [(0, 1), (1, 2), (0, 2), (2, 3)]


def edges(g):
    return sorted(map(tuple, g.edges.select("src", "dst", "src_label", "dst_label").collect()))


def test_round_trips(spark, tmp_path):
    g = Graph.in_memory(spark, LABELS, PAIRS)
    text.write_graph(g, f"file:{tmp_path}/t")
    assert edges(text.read_graph(spark, f"file:{tmp_path}/t")) == edges(g)
    csr.write_graph(g, f"{tmp_path}/c")
    back = csr.read_graph(spark, f"file:{tmp_path}/c")
    assert edges(back) == edges(g) and back.vertices.count() == 5
    g.store(f"file:{tmp_path}/p")
    assert edges(Graph.load(spark, f"file:{tmp_path}/p")) == edges(g)


def test_loops_and_repeats_are_dropped(spark):
    g = Graph.in_memory(spark, LABELS, [*PAIRS, (1, 0), (3, 3), (0, 1)])
    assert g.edges.count() == 8


def test_edge_list(spark, tmp_path):
    (tmp_path / "raw").write_text("# comment\n1 2\n2\t1\n3 3\n2 3\n\n")
    g = convert.read_edge_list(spark, f"file:{tmp_path}/raw", 4)
    assert sorted((r["src"], r["dst"]) for r in g.edges.collect()) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert all(0 <= r["label"] < 4 for r in g.vertices.collect())


def test_query_files_and_command_line(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q/tri").write_text("t 3 3\nv 0 0 2\nv 1 0 2\nv 2 0 2\ne 0 1 0\ne 1 2 0\ne 0 2 0\n")
    (tmp_path / "list").write_text("tri\n")
    (tmp_path / "g").write_text("t 4 3\nv 0 0 1\nv 1 0 2\nv 2 0 2\nv 3 0 1\ne 0 1 0\ne 1 2 0\ne 2 3 0\n")
    q = text.read_query_list(spark, f"file:{tmp_path}/list", f"file:{tmp_path}/q")[0]
    assert q.labels == (0, 0, 0) and q.edges == ((0, 1), (1, 2), (0, 2))
    assert text.residual_degrees(q, 0) == [1, 1, 2]
    cli.main(["-d", f"file:{tmp_path}/g", "-q", f"file:{tmp_path}/q", "-ql", f"file:{tmp_path}/list", "-k", "2", "-crq", "JointEnum", "-output_path", f"file:{tmp_path}/out"])
    rows = results.read(spark, f"file:{tmp_path}/out").collect()
    assert len(rows) == 6 and {r["inc_cnt"] for r in rows} == {1}


def test_csr_rows_come_packed_to_the_driver(spark, tmp_path, monkeypatch):
    n = 30_000
    pairs = spark.range(n - 1).selectExpr("id AS u", "id + 1 AS v")
    g = Graph.of(spark.range(n).selectExpr("id", "cast(id % 5 as int) AS label"), pairs).persist()
    rows, frame = [], type(g.edges)
    monkeypatch.setattr(frame, "toLocalIterator", lambda self, *a, f=frame.toLocalIterator, **b: (rows.append(1) or r for r in f(self, *a, **b)))
    csr.write_graph(g, f"{tmp_path}/c")
    assert len(rows) < 100
    monkeypatch.setattr(csr, "BLOCK", 7_000)
    back = csr.read_graph(spark, f"file:{tmp_path}/c")
    assert back.edges.exceptAll(g.edges).count() == g.edges.exceptAll(back.edges).count() == 0
    assert back.vertices.exceptAll(g.vertices).count() == 0 and back.vertices.count() == n


def test_csr_gaps_are_refused(spark, tmp_path):
    with __import__("pytest").raises(ValueError, match="without gaps"):
        csr.write_graph(Graph.in_memory(spark, {0: 1, 2: 1}, [(0, 2)]), f"{tmp_path}/c")


def test_csr_passes_the_driver_by(spark, tmp_path, monkeypatch):
    pairs = [(i, j) for i in range(0, 60, 3) for j in range(i + 1, 60, 7)]
    g = Graph.in_memory(spark, {i: i % 5 for i in range(70)}, pairs).persist()  # the last ten have no edges
    monkeypatch.setattr(csr.shared, "RANGE", 50)
    monkeypatch.setattr(type(g.edges), "toLocalIterator", lambda *_, **__: 1 / 0)
    csr.write_graph(g, f"{tmp_path}/c")
    monkeypatch.setattr(csr, "BLOCK", 40)
    monkeypatch.setattr(csr, "BATCH", 7)
    back = csr.read_graph(spark, f"file:{tmp_path}/c")
    assert "Exchange" not in back.edges._jdf.queryExecution().executedPlan().toString()
    assert edges(back) == edges(g) and sorted(map(tuple, back.vertices.collect())) == [(i, i % 5) for i in range(70)]
    near = {u: sorted({b for a, b in pairs if a == u} | {a for a, b in pairs if b == u}) for u in range(70)}
    read = lambda x: __import__("numpy").fromfile(f"{tmp_path}/c_{x}.bin", "<i4").tolist()
    assert read("deg") == [4, 70, len(set(pairs)), *(len(near[u]) for u in range(70))] and read("adj") == [v for u in range(70) for v in near[u]]


def test_text_to_csr_with_odd_lines(spark, tmp_path, monkeypatch):
    (tmp_path / "t").write_text("t 6 5\n" + "".join(f"v {i} {i % 2} 0\n" for i in (3, 0, 5, 1, 4, 2)) + "e 0 1 0\ne 1 0 0\ne 0 1 0\ne 2 2 0\n e 4  2 0\ne 3 9 0\ne 1 4\n")
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *_, **__: 1 / 0)
    csr.text_to_csr(spark, f"file:{tmp_path}/t", f"{tmp_path}/c")
    wanted = edges(text.read_graph(spark, f"file:{tmp_path}/t"))
    assert len(wanted) == 6 and edges(csr.read_graph(spark, f"file:{tmp_path}/c")) == wanted
    (tmp_path / "gap").write_text("v 0 0 0\nv 2 0 0\ne 0 2 0\n")
    with __import__("pytest").raises(ValueError, match="without gaps"):
        csr.text_to_csr(spark, f"file:{tmp_path}/gap", f"{tmp_path}/g")


def test_csr_lists_that_are_no_simple_graph(spark, tmp_path):
    """Repeats, loops and edges in one of two lists only are read as before."""
    import numpy as np

    for kind, x in (("deg", [4, 4, 3, 3, 2, 0, 1]), ("adj", [1, 1, 0, 0, 2, 0]), ("label", [5, 6, 7, 8])):
        np.array(x, "<i4").tofile(f"{tmp_path}/c_{kind}.bin")
    wanted = [(0, 1), (0, 3), (1, 2)]
    assert [e[:2] for e in edges(csr.read_graph(spark, f"file:{tmp_path}/c"))] == sorted([*wanted, *((b, a) for a, b in wanted)])
