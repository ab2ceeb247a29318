"""Similarity join, passages, decontamination, urls and vectors against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edgelift.llm import chunk_dedup, decontaminate, graph, ngram_join, url_rules, vector_index


def brute_components(texts, n, percent):
    sets = [ngram_join.ngrams(t, n) for _, t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(texts))


def near_copies(seed, groups=6, each=25):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 12, 30, 90, 260]))]
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 15))):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(3000)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate([*out, "", None, "one", "one", "ONE two", "one\u00a0two", "x " * 3000])]


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_similarity_join(spark, n, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    texts = near_copies(n)
    docs = spark.createDataFrame([(d, t, 1, 1, 1) for d, t in texts], "doc_id long, text string, node int, key int, component int")
    got = sorted(map(tuple, ngram_join.similar_documents(docs, n, percent).collect()))
    assert got == brute_components(texts, n, percent)


def test_repeated_rows_and_keep_first(spark):
    long = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, long, "a"), (2, long, "b"), (2, long, "b"), (3, "other text entirely here now", "c"), (3, "other text entirely here now", "c"), (4, None, "d"), (None, long, "e")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, ngram_join.keep_first(docs, 5, 80).collect()), key=str) == sorted([(1, long, "a"), (3, "other text entirely here now", "c"), (4, None, "d"), (None, long, "e")], key=str)
    # B is no copy of anything, though a copy of A has its id; of near copies under one id one stays
    other, third = (" ".join(f"{c}{i}" for i in range(50)) for c in "xy")
    docs = spark.createDataFrame([(1, long), (5, long), (5, other), (6, other + " y"), (6, other + " z"), (7, long), (8, third), (8, third + " q")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.keep_first(docs, 5, 80).collect())) == [(1, long), (5, other), (8, third)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_documents(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 600), st.integers(0, 10**6), st.sampled_from([(90, 3), (80, 5)]))
def test_similar_sets_share_an_entry(size, seed, kind):
    percent = kind[0]
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, size).astype(np.uint64))
    most = len(a) * (100 - percent) // (100 + percent)
    swap = int(rng.integers(0, most + 1))
    b = np.unique(np.concatenate([a[swap:], rng.integers(0, 2**63, swap).astype(np.uint64)]))
    both = len(np.intersect1d(a, b))
    common = np.sort(rng.choice(a, int(rng.integers(0, len(a) + 1)), replace=False))
    if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
        assert set(ngram_join.signatures(a, percent, common).tolist()) & set(ngram_join.signatures(b, percent, common).tolist())


def test_many_rows_without_an_id(spark):
    texts = [(None if i % 3 else 77, t) for i, t in near_copies(1, groups=4, each=12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = [ngram_join.ngrams(t, 3) for _, t in texts]
    got = sorted(((r["doc_id"], r["n_shingles"]) for r in ngram_join.similar_documents(docs).collect()), key=str)
    assert got == sorted(((d, len(s)) for (d, _), s in zip(texts, sets, strict=True)), key=str)
    found = {r["node"]: r["component"] for r in ngram_join.judged_sets(docs, 3, 90).collect() if r["node"] is not None}
    numbered = brute_components([(i, t) for i, (_, t) in enumerate(texts)], 3, 90)
    assert len({c for _, n, c in numbered if n}) == len(set(found.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200), (7, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(55)) for _ in range(12)]
    docs = []
    for i in range(60):
        body = [word() for _ in range(200)]
        if i < 36:
            body.insert(rng.randrange(200), passages[i % 12])
        docs.append((i, ("é " if i % 2 else "") + " ".join(body)))
    docs += [(900, "of " * 300), (901, "x of " + "of " * 200), (902, None), (903, ""), (904, "short"), (904, "short")]
    found = chunk_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = dict(docs)
    assert {r["doc_id"] for r in found} == {*range(36), 900, 901}
    for r in found:
        assert texts[r["doc_id"]][r["start"] : r["stop"]] in texts[r["first_doc"]]
    assert chunk_dedup.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_equal_brute_force(spark):
    """Every chunk against every other row's, one digest being held by most rows."""
    rng = random.Random(9)
    common, words = " ".join(f"licence{i}" for i in range(40)), [f"w{i}" for i in range(400)]
    texts = [" ".join([*rng.choices(words, k=30), common, *rng.choices(words, k=30)]) if i % 4 else " ".join(rng.choices(words, k=90)) for i in range(300)]
    texts += texts[:5] + ["", None, "\u00e9 " * 500, "\u00e9 " * 400]
    cut = []
    for t in texts:
        data = (t or "").encode()
        stops = chunk_dedup.cuts(data).tolist()
        cut.append([(data[a:b], len(data[:a].decode()), len(data[:b].decode())) for a, b in zip([0, *stops], stops)])
    holders = {}
    for i, chunks in enumerate(cut):
        for chunk, _, _ in chunks:
            holders.setdefault(chunk, set()).add(i)
    want = []
    for i, chunks in enumerate(cut):
        start = first = None
        for chunk, a, b in [*chunks, (None, None, None)]:
            if chunk is not None and len(holders[chunk]) > 1:
                start, first, end = (a, min(holders[chunk]), b) if start is None else (start, first, b)
            elif start is not None:
                if end - start >= chunk_dedup.LEAST:
                    want.append((i, start, end, first))
                start = None
    frame = spark.createDataFrame([(i, t, i, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, digest int, _hot string, _part int")
    assert sorted(map(tuple, chunk_dedup.repeated_passages(frame).collect())) == sorted(want)
    assert len(want) > 200


def edit_distance_anywhere(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, e in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=14), st.text("abc", min_size=1, max_size=25))
def test_myers(pattern, text):
    assert decontaminate.myers(pattern, text, len(pattern) + 1)[0] == edit_distance_anywhere(pattern, text)


def test_decontamination(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 40)))) for i in range(20)] + [(50, None), (51, "!!")]
    docs = []
    for i in range(80):
        _, t = items[i % 20]
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["", "z", "q" + t[at]]) + t[at + 1 :]
        docs.append((i, " ".join(word() for _ in range(30)) + " " + t.upper() + ",\n " + word()))
    docs += [(200, None), (201, ""), (7, docs[7][1])]
    wanted = set()
    for d, t in docs:
        for i, item in items[:20]:
            p, budget = decontaminate.normalize(item), int(decontaminate.RATE * len(decontaminate.normalize(item)))
            if edit_distance_anywhere(p, decontaminate.normalize(t)) <= budget:
                wanted.add((d, i))
    assert len(wanted) > 20
    for size in (10**6, 300):
        monkeypatch.setattr(decontaminate, "BLOCK", size)
        frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(frame, tests).collect()} == wanted
        assert {r["doc_id"] for r in decontaminate.drop_contaminated(frame, tests).collect()} == {d for d, _ in docs} - {d for d, _ in wanted}
    assert decontaminate.find_items(frame, tests.limit(0)).count() == 0
    assert decontaminate.find_items(frame.limit(0), tests).count() == 0 and decontaminate.drop_contaminated(frame, tests.limit(0)).count() == len(docs)


def test_texts_of_one_item(spark, monkeypatch):
    """Two texts share an item_id: both are found, whatever the blocks; the least distance counts."""
    one, two = "the first text of the item has so many letters", "and quite another text stands second in this item"
    items = spark.createDataFrame([(1, one), (1, two), (1, two), (2, "zz")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"q {one} q", 5), (2, f"q {two.replace('quite', 'quote')} {two} q", 5), (3, f"q {two.replace('quite', 'quote')}", 5), (4, "zz", 5), (5, "zzz", 5), (None, one, 5)], "doc_id long, text string, item_id int")
    for size in (10**6, 60):
        monkeypatch.setattr(decontaminate, "BLOCK", size)
        assert sorted(map(tuple, decontaminate.find_items(docs, items).distinct().collect()), key=str) == sorted([(1, 1, 0), (2, 1, 0), (3, 1, 1), (4, 2, 0), (None, 1, 0)], key=str)
        assert decontaminate.drop_contaminated(docs, items).collect() == [(5, "zzz", 5)]


def test_urls(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "Example.net", "/en/x"), ("block", "a.b.c", ""), ("allow", "org", "/fr/"), ("block", "org", "/fr/")]
    hosts = ["example.net", "www.EXAMPLE.net", "net", "notexample.net", "x.a.b.c", "a.b.c", "org", "q.org:80", "", "com"]
    paths = ["", "/", "/en/", "/en/x/y?z", "/fr/1#t", "/fr", "?q=/en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "a://b://c/en/", "http://net/", "http://net/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), "allow").collect()}
    assert len(got) == len(urls)
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in ((v, lower(h), p) for v, h, p in rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert got[i] == (host, path, best[1], best[2]), u
    empty = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r["verdict"] for r in url_rules.judge_urls(pages, empty).collect()} == {"allow"}
    assert url_rules.judge_urls(pages.limit(0), empty).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[1000:1900] = x[1000]  # a large class of equal vectors
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [1.0] * 15 + [float("nan")]), (5060, [None] * 16), (5080, [1.0]), (5100, [])]
    got = {}
    for r in vector_index.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>"), "vec_id % 20 = 0", 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 20))
    hit = 0
    d = x.astype(float)
    for q, rows in got.items():
        scores = (d * d[q]).sum(1)
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 21))
        assert all(v != q and abs(s - scores[v]) < 1e-9 for _, v, s in rows)
        scores[q] = -np.inf
        wanted = np.lexsort((np.arange(len(d)), -scores))[:20]
        if q == 1000:
            assert [v for _, v, _ in sorted(rows)] == wanted.tolist()
        hit += len({v for _, v, _ in rows} & set(wanted.tolist()))
    assert hit >= 0.9 * 20 * len(got)
    few = spark.createDataFrame(data[:5] * 3 + [(0, data[7][1])], "vec_id long, embedding array<float>")
    ranked = sorted(map(tuple, vector_index.nearest(few, "vec_id = 0").collect()))
    both = {v: max(float(d[q] @ d[v]) for q in (0, 7)) for v in range(1, 5)}  # two vectors bear the query's id
    assert [(r, v) for _, r, v, _ in ranked] == list(enumerate(sorted(both, key=lambda v: -both[v]), 1))
    assert vector_index.nearest(few.limit(0), "true").count() == 0


@pytest.mark.parametrize(("groups", "row"), [(0, 0), (0, vector_index.ROW), (400, vector_index.ROW)])
def test_vectors_of_many_lists(spark, monkeypatch, groups, row):
    monkeypatch.setattr(vector_index, "ROW", row)  # 0: lists are read wherever they hold less than the table
    plans, plan = [], vector_index.plan
    monkeypatch.setattr(vector_index, "plan", lambda *a: plans.append(plan(*a)) or plans[-1])
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40_000, 64))
    if groups:
        x = rng.normal(size=(groups, 64))[rng.integers(0, groups, len(x))] + 0.2 * x
    x /= np.sqrt((x * x).sum(1))[:, None]
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = vector_index.nearest(table, "vec_id % 400 = 0", 20).toPandas().groupby("query_id")["vec_id"].apply(set)
    scores = x[::400] @ x.T
    scores[np.arange(100), np.arange(0, 40_000, 400)] = -np.inf
    wanted = np.argpartition(-scores, 20, 1)[:, :20]
    recall = np.mean([len(got[400 * i] & set(w.tolist())) / 20 for i, w in enumerate(wanted)])
    assert recall >= 0.9
    if not plans[0]:
        assert row and not groups and recall == 1.0
    else:
        assert groups or plans[0][0] > 48
