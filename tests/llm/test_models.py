"""Secrets, toxicity, quality and the pipeline."""

import hashlib
import random
import re

import pytest

from edgelift.llm import quality, secrets, toxicity

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
SF = "/root/testdata/sf0.001"


def brute_base(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def random_text(rng):
    alphabet = ["token", "Secret", "api_key", "APIKEY", "password", "passwd", "=", ":", " ", '"', "'", "AKIA", "ABC123", "deadbeef", "0123", "é", "🙂", "xyz.", "\n", "abcdefghijkl", "-"]
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))


def test_base_spans(spark):
    rng = random.Random(2)
    texts = [random_text(rng) for _ in range(400)] + ["token=secret:abcdefghijklmnop", "", None, "ordinarylongidentifierword " * 700]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    kinds = list(secrets.BASE)
    for r in secrets.find_secrets(docs).collect():
        spans = brute_base(texts[r["doc_id"]] or "")
        rendered = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(rendered).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("markov")] == rendered
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def mean_ratio(model, text):
    n = len(secrets.ALPHABET)
    return sum(model[secrets.ALPHABET.index(a) * n + secrets.ALPHABET.index(b)] for a, b in zip(text, text[1:], strict=False)) / (len(text) - 1)


def test_markov_held_out():
    """Precision and recall on strings of another seed, and on words of another language."""
    model = secrets.train(*secrets.labelled_strings())
    keys, names = secrets.labelled_strings(2, 3000)
    hits, false = (sum(mean_ratio(model, s) >= secrets.THRESHOLD for s in x) for x in (keys, names))
    assert hits >= 0.98 * len(keys) and hits / (hits + false) >= 0.99
    rng = random.Random(6)
    words = ["".join(rng.choice(["lle", "cion", "oga", "aux", "eur", "que", "sch", "ung", "heit", "ein", "ment", "ado"]) for _ in range(6)) for _ in range(1000)]
    assert sum(mean_ratio(model, w) >= secrets.THRESHOLD for w in words) <= 5


def test_markov_finds_bare_secrets_and_masks_them(spark):
    rng = random.Random(5)
    key = lambda: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(32))
    bare = key()
    texts = [f"getUserName token = {key()} defaultPageHeader"] * 3 + [f"see {bare} and InternationalAccountSettings", "www/document/template/example", "", None]
    docs = spark.createDataFrame([(i, t, -1, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, _whole string, _base string").selectExpr("*", "'c' AS _runs", "'d' AS spans", "'e' AS doc", "'f' AS hit")
    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    assert spans[3] == f"markov:4:{4 + len(bare)}" and not any(spans[i] for i in (4, 5, 6))
    frame = secrets.redact(docs)
    assert frame.columns == docs.columns
    masked = {r["doc_id"]: r for r in frame.collect()}
    assert all(tuple(r)[3:] == tuple("abcdef") for r in masked.values())
    assert masked[3]["text"] == "see [SECRET] and InternationalAccountSettings" and masked[3]["n_chars"] == len(masked[3]["text"])
    assert all(masked[i]["text"] == texts[i] and masked[i]["n_chars"] == -1 for i in (4, 5, 6))
    assert masked[0]["text"] == "getUserName [SECRET] defaultPageHeader"


def labelled(spark, n=600):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(3, 9)))
    docs, labels = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.3, rng.random() < 0.25
        body = [word() for _ in range(rng.randint(20, 120))]
        if toxic:
            body.insert(3, rng.choice(["vileword", "nastyword", "meanword"]))
        text = "### ".join(body) if junk else " ".join(body)
        docs.append((i, text, f"s{i % 5}", "en"))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(9000, None, None, None), (9001, "", "s1", "en"), (3, docs[3][1], "s3", "en")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), labels


def test_toxicity_held_out(spark):
    docs, rows = labelled(spark)
    labels = spark.createDataFrame([r for r in rows if r[0] % 2] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.find_toxic(docs, labels.selectExpr("doc_id", "1 - quality AS low_quality", "toxic"), ["low_quality", "toxic"]).collect()}
    assert len(got) == 602
    held = [r for r in rows if not r[0] % 2]
    assert sum(got[d]["is_toxic"] == bool(t) for d, _, t in held) > 0.95 * len(held)
    none = toxicity.find_toxic(docs, labels.limit(0), ["toxic"])
    assert none.columns == ["doc_id", "p_toxic", "is_toxic"]
    assert none.filter("is_toxic").count() == 0 and none.count() == 603
    assert toxicity.find_toxic(docs.limit(0), labels, ["toxic"]).count() == 0


def test_quality_held_out(spark):
    docs, rows = labelled(spark)
    labels = spark.createDataFrame([r for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    held = [r for r in rows if not r[0] % 2]
    assert sum(got[d]["keep"] == bool(q) for d, q, _ in held) > 0.95 * len(held)
    named = docs.selectExpr("*", "'a' AS p_path", "'b' AS p_host", "'c' AS keep", "'d' AS z", "'e' AS doc", "'f' AS path", "'g' AS host")
    kept = quality.keep_good(named, labels).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in quality.judge(docs, labels).filter("keep").collect())
    assert {tuple(r)[4:] for r in kept} == {tuple("abcdefg")}
    assert set(quality.judge(named, labels).columns) == {*named.columns, *quality.RESULTS}
    assert quality.judge(docs, labels.limit(0)).filter("keep").count() == 603
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_sparse_sites_shrink_to_the_mean(spark):
    scored = spark.createDataFrame([(i, "big" if i < 400 else "bad" if i < 600 else "one", "en", 3.0 if i < 400 else -3.0) for i in range(601)], "doc_id long, source string, lang string, z double")
    table, mean = quality.paths(scored, spark.createDataFrame([], "doc_id long, quality int"), "quality", "source", "lang", "z")
    p = {r["source"]: r["p_path"] for r in table.collect()}
    assert p["bad"] < p["one"] < mean < p["big"]


@pytest.mark.parametrize("drop", [0, 10**9])
def test_pipeline(spark, drop):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(f"doc_id >= {drop}")
    columns = docs.columns
    for i, (_, stage) in enumerate(pipeline.STAGES):
        before = docs
        docs = pipeline.materialize(stage(spark, docs, SF), "stage")
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert (docs.count() > 0) == (drop == 0)
    if not drop:
        totals = docs.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()
        assert all(r["doc_tokens"] == r["sum(length)"] for r in totals)


def test_chain_of_three(spark):
    """Each category shows in the one before it, so the chain beats independent models."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(3, 9)))
    docs, labels = [], []
    for i in range(900):
        rude = rng.random() < 0.5
        toxic = rude and rng.random() < 0.6
        threat = toxic and rng.random() < 0.9
        body = [word() for _ in range(40)] + ["rudeword"] * rude + ["toxicword"] * toxic
        rng.shuffle(body)
        docs.append((i, " ".join(body)))
        labels.append((i, int(rude), int(toxic), int(threat)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    names = ["rude", "toxic", "threat"]
    known = spark.createDataFrame([r for r in labels if r[0] % 2], "doc_id long, rude int, toxic int, threat int")
    chain = toxicity.train_chain(frame, known, names)
    assert [len(m.weights) - len(chain.models[0].weights) - 2 * (len(m.words) - len(chain.models[0].words)) for m in chain.models] == [0, 1, 2]
    got = {r["doc_id"]: r for r in toxicity.score_chain(frame, chain, names).collect()}
    right = lambda k, c: sum((got[r[0]][f"p_{c}"] >= 0.5) == bool(r[1 + k]) for r in labels if not r[0] % 2) / 450
    assert right(0, "rude") > 0.98 and right(1, "toxic") > 0.98 and right(2, "threat") > 0.9
    alone = {r["doc_id"]: r["p_threat"] for r in toxicity.score_chain(frame, toxicity.train_chain(frame, known, ["threat"]), ["threat"]).collect()}
    assert right(2, "threat") >= sum((alone[r[0]] >= 0.5) == bool(r[3]) for r in labels if not r[0] % 2) / 450
