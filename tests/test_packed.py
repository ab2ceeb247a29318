"""Packed shuffles against plain joins, and what they write."""

import random

import pytest
from pyspark.sql import functions as F

from edgelift.operators import packed


def _rows(seed, n, most):
    r = random.Random(seed)
    return [(r.choice([None, r.randrange(-most, most)]) if r.random() < 0.1 else r.randrange(most), r.randrange(most) * 4) for _ in range(n)] + [(2**60, -5), (2**60, -5)]


@pytest.mark.parametrize("n", [1, 9])
def test_distinct_join_and_together(spark, n):
    left, right = _rows(1, 3000, 200), _rows(2, 400, 200)
    a, b = spark.createDataFrame(left, "k long, x long").repartition(3), spark.createDataFrame(right, "k long, y long")
    assert sorted(map(tuple, packed.distinct(packed.deal(a, n)).collect()), key=str) == sorted(set(left), key=str)
    met = packed.distinct(packed.join(packed.deal(a, n), packed.deal(b, n), n)).collect()
    assert sorted(map(tuple, met)) == sorted({(y, x) for k, x in left for m, y in right if k is not None and k == m})
    pairs = packed.distinct(packed.together(packed.deal(a, n), n)).collect()
    assert sorted(map(tuple, pairs)) == sorted({(x, y) for k, x in left for m, y in left if k is not None and k == m and x < y})


def test_no_rows(spark):
    none = packed.deal(spark.createDataFrame([], "k long, x long"), 8)
    assert packed.distinct(packed.join(none, none, 8)).count() == packed.distinct(packed.together(none, 8)).count() == 0


def test_a_run_is_small(spark):
    """A distinct pair takes a fraction of the 28 bytes of a row that Spark shuffles, after compression of the planes."""
    import zlib

    frame = spark.range(200_000).select((F.col("id") % 20_000).alias("u"), (F.hash("id") % 1000).cast("long").alias("v"))
    size = sum(len(zlib.compress(r["a"], 1)) + len(zlib.compress(r["b"], 1)) for r in packed.deal(frame.coalesce(1), 8).collect())
    assert size < 5 * frame.distinct().count()


def test_hash_plan_looks_small_sides_up(spark, monkeypatch):
    """No join of two relations on the right is formed: its relations are broadcast and the plan has no more shuffled rows than the left side."""
    from edgelift import fixtures
    from edgelift.operators import matching

    g, q = fixtures.graph(spark, "/root/testdata/sf0.001", "het"), fixtures.template("c4")
    small = matching.hash_plan(g, q, "[[0, 1], [2, 3]]")
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2
    rows = sorted(map(tuple, small.collect()))
    monkeypatch.setattr(matching, "LOOKUP", 0)
    plain = matching.hash_plan(g, q, "[[0, 1], [2, 3]]")
    assert "strategy=broadcast" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert rows == sorted(map(tuple, plain.collect())) == sorted(map(tuple, matching.match_rows(g, q).collect()))
    with pytest.raises(ValueError, match="common vertices"):
        matching.hash_plan(g, q, "[[0, 2], [1, 3]]")
