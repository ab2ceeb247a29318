"""Token store and packing: exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from edgelift.llm import packing, token_store
from edgelift.llm.tokens import Encoder, encoder

TEXTS = ["The quick brown fox", "", None, "Élan  vital\n\n\tça va?  ", "don't WE'LL x's 12345 ½²", "日本語 and emoji 🙂 mixed", "nbsp\u00a0here \u200b", "<|endoftext|> text", "a <|ENDOFTEXT|>b <|startoftext|><|x|> <|endoftext|", "a" * 5000, "word " * 9000, "é" * 3, " lead", "trail ", "tabs\t\tand\r\nlines", "e\u0301 combining", "x'S 'T"]
WORD, BYTE = (str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


_libraries = {}


def library(path, text, end):
    k = _libraries.setdefault(path, Tokenizer.from_file(path))
    return np.array([*k.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("path,kind", [(WORD, "word"), (BYTE, "byte")])
def test_encoder_equals_library(path, kind):
    e = Encoder(path, kind, memo=3)
    for _ in range(2):
        for t in TEXTS:
            assert e.encode(t) == library(path, t, 0)[:-1].tobytes()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(st.characters(max_codepoint=255)), st.text("ab A'1.\t\n\r \xa0é½\xad<|", max_size=40), st.text(max_size=30)))
def test_encoder_equals_library_on_any_text(text):
    for path, kind in ((WORD, "word"), (BYTE, "byte")):
        assert encoder(path, kind).encode(text) == library(path, text, 0)[:-1].tobytes()


def rows(spark, texts=TEXTS):
    # repeated rows, a null id, and columns with clashing names
    data = [(i * 3, t, 1, "x") for i, t in enumerate(texts)] + [(0, texts[0], 1, "x"), (None, "no id", 1, "x")]
    return spark.createDataFrame(data, "doc_id long, text string, start int, key string")


def test_store_round_trip(spark, tmp_path):
    store = f"file:{tmp_path}/store"
    token_store.write_store(rows(spark), store, WORD)
    wanted = [(None, "no id"), (0, TEXTS[0]), *((i * 3, t) for i, t in enumerate(TEXTS))]
    checked = sorted(map(tuple, token_store.read_checked(spark, store).collect()), key=lambda r: r[1])
    ids = {(r["doc_id"], r["start"]): r["ids"] for r in token_store.read_ids(spark, store).collect()}
    at = 0
    for (doc_id, text), row in zip(wanted, checked, strict=True):
        expected = library(WORD, text, 2)
        assert row == (doc_id, at, len(expected), zlib.crc32(expected.tobytes()))
        assert ids[doc_id, at] == expected.tolist()
        at += len(expected)
    assert spark.read.parquet(f"{store}/manifest").filter("level = 0").count() == 1
    raw = spark.read.parquet(f"{store}/raw").filter("kind = 'chunk'")
    assert raw.count() == raw.select("payload").distinct().count()


def test_damage_is_found(spark, tmp_path):
    store = f"file:{tmp_path}/store"
    token_store.write_store(rows(spark), store, WORD)
    raw = spark.read.parquet(f"{store}/raw")
    raw.selectExpr("key", "case when kind = 'chunk' then concat(substring(payload, 1, 1), reverse(substring(payload, 2))) else payload end as payload", "doc_id", "n_tokens", "recipe", "kind").write.partitionBy("kind").parquet(f"file:{tmp_path}/bad/raw")
    spark.read.parquet(f"{store}/recipes").write.parquet(f"file:{tmp_path}/bad/recipes")
    token_store._level(spark, store, 0).write.parquet(f"file:{tmp_path}/bad/manifest/level=0")
    with pytest.raises(Exception, match="damaged|rebuilt"):
        token_store.read_checked(spark, f"file:{tmp_path}/bad").collect()


def test_tampering_is_found(spark, tmp_path):
    store = f"file:{tmp_path}/store"
    token_store.write_store(rows(spark), store, WORD)
    recipes, raw = spark.read.parquet(f"{store}/recipes"), spark.read.parquet(f"{store}/raw")
    one = recipes.filter("doc_id = 3").first()
    swapped = recipes.drop("recipe", "root", "n_tokens").crossJoin(recipes.filter("doc_id = 3").select("recipe", "root", "n_tokens"))
    changes = {
        "swapped": (swapped.select(recipes.columns), raw),
        "lost": (recipes.filter("doc_id <> 9 or doc_id is null"), raw),
        "renamed": (recipes.selectExpr("case when doc_id = 9 then 10 else doc_id end as doc_id", *recipes.columns[1:]), raw),
        "chunks": (recipes, raw.filter("kind <> 'chunk'")),
    }
    assert one["n_tokens"]
    for name, (changed, chunks) in changes.items():
        at = f"file:{tmp_path}/{name}"
        changed.write.parquet(f"{at}/recipes")
        chunks.write.partitionBy("kind").parquet(f"{at}/raw")
        for level in spark.read.parquet(f"{store}/manifest").select("level").distinct().collect():
            token_store._level(spark, store, level[0]).write.parquet(f"{at}/manifest/level={level[0]}")
        for read in (token_store.read_checked, token_store.read_ids):
            with pytest.raises(Exception, match="rebuilt" if name == "chunks" else "manifest"):
                read(spark, at).collect()


def test_chunks_resist_shifts():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49000, 20_000).astype(np.uint32)
    cut = lambda x: {token_store.digest(token_store.payload(x[a:b])) for a, b in zip([0, *token_store.cut(x)], token_store.cut(x), strict=False)}
    a, b = cut(ids), cut(np.concatenate([ids[:5000], [7], ids[5000:]]).astype(np.uint32))
    assert len(a & b) > 0.9 * len(a)


def test_crc_of_parts():
    a, b = b"hello", b"world, again" * 40
    assert token_store.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_packing_holds_every_id_once(spark):
    for window, open_windows in ((1024, 64), (16, 2)):
        pieces = packing.pack_documents(rows(spark).repartition(3), BYTE, open_windows=open_windows, window=window, fan_in=2).collect()
        by, sequences = {}, {}
        for p in pieces:
            by.setdefault(p["doc_id"], []).append(p)
            sequences.setdefault(p["sequence_id"], []).append(p)
        texts = {i * 3: t for i, t in enumerate(TEXTS)} | {None: "no id"}
        assert set(by) == set(texts)
        for doc_id, text in texts.items():
            expected = library(BYTE, text, 0)
            copies = 2 if doc_id == 0 else 1
            assert sum(p["length"] for p in by[doc_id]) == copies * len(expected)
            for p in by[doc_id]:
                assert p["doc_tokens"] == len(expected)
                assert p["ids_crc32"] == zlib.crc32(expected[p["start"] : p["start"] + p["length"]].tobytes())
        waste = 0
        for s in sequences.values():
            at = 0
            for p in sorted(s, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at <= window
            waste += 0 if at & (at - 1) == 0 else window - at
        assert waste == 0


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, BYTE).count() == 0
    token_store.write_store(none, f"file:{tmp_path}/none", WORD)
    assert token_store.read_checked(spark, f"file:{tmp_path}/none").count() == 0


def test_documents_are_cut_together_as_alone():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, high, n).astype(np.uint32) for n in (0, 1, 64, 65, 300, 5000, 2, 40_000, 0, 900) for high in (3, 49_000, 90_000)]
    parts.append(np.zeros(9000, np.uint32))
    together = token_store.cut_each(np.concatenate(parts), [len(p) for p in parts])
    for p, ends in zip(parts, together, strict=True):
        h = token_store.rolling((p & 0xFFFF).astype(np.uint16), token_store.gear_table()) >> np.uint16(16 - token_store.MEAN_BITS) == 0
        expected, last = [], 0
        for at in range(1, len(p)):  # id by id
            if at - last >= token_store.MOST or (h[at - 1] and at - last >= token_store.LEAST):
                expected.append(at)
                last = at
        assert ends == expected + [len(p)] * bool(len(p))
