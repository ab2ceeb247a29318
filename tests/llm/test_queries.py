"""The registered queries of the subpackage against their SQL or a plain version, on whole small tables."""

import glob
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from edgelift.llm import queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    wanted = tables.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    found = rows(df.columns, map(tuple, df.collect()))
    assert found and found == rows(wanted.columns, wanted.fetchall())


def encoded(tables, file, end):
    library = Tokenizer.from_file(str(public_tokenizers.path(file)))
    return [(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for d, t in tables.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()]


def test_token_store(spark, tables):
    at, wanted = 0, []
    for doc_id, ids in encoded(tables, "word_bpe_49k.json", 2):
        wanted.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    found = QUERIES["op1_token_store"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == wanted


def test_packing(spark, tables):
    ids = dict(encoded(tables, "byte_bpe_50k.json", 0))
    pieces = QUERIES["op8_packing"](spark, SF).collect()
    ends, held = {d: 0 for d in ids}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]]
        assert p["start"] == ends[p["doc_id"]] and p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        ends[p["doc_id"]] += p["length"]
        held.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert ends == {d: len(x) for d, x in ids.items()}
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(map(len, ids.values())) > 0.97 * 1024 * (len(held) - 1)
