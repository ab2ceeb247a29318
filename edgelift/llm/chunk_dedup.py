"""Passages that repeat across documents, by content-defined chunks.

A gear hash of the last 16 bytes decides where a text is cut, so the same
passage is cut alike wherever it stands and insertions only move the chunks
that they touch.  A chunk whose digest occurs in several documents is a
repeat; neighbouring repeats make a passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialize, width
from .token_store import gear_table, rolling

#: One in 2**BITS places is a cut, unless another hit lies within GAP bytes before.
BITS, GAP = 5, 8
#: Bytes without a cut from which a stretch is cut where its commonest hash stands.
STRETCH = 256
#: Characters from which neighbouring repeats are reported: fifty words less the chunks at their ends.
LEAST = 100

#: The two halves of a chunk's 128-bit digest.
DIGEST = ["digest", "rest"]
_CHUNK = "digest long, rest long, doc_id long, row long, at int, stop int"


def cuts(data: bytes):
    """Byte offsets where chunks end, the last one included."""
    import numpy as np

    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    hashes = rolling(raw, gear_table())
    hits = np.flatnonzero(hashes >> np.uint16(16 - BITS) == 0) + 1
    hits = hits[(np.diff(hits, prepend=-GAP) >= GAP) & (hits < len(raw))]
    hits = np.concatenate([hits, *_stretches(hashes, np.concatenate([[0], hits]), np.append(hits, len(raw)))])
    hits = np.sort(hits[raw[hits] & 0xC0 != 0x80])  # never inside a character
    return np.append(hits, len(raw))


def _stretches(hashes, begins, ends):
    """Further cuts in long stretches, such as one word over and over, whose few hashes never hit the mask."""
    import numpy as np

    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b - a > STRETCH:
            values, counts = np.unique(hashes[a:b], return_counts=True)
            places = np.flatnonzero(hashes[a:b] == values[2 * counts >= counts.max()].max()) + a + 1
            step = -(-GAP * len(places) // (b - a))
            yield places[::step][places[::step] < b]


def chunk_documents(docs: DataFrame) -> DataFrame:
    """digest, rest, doc_id, row, at, stop of every chunk; ``row`` tells repeated rows apart, places are in code points."""

    def chunk(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from xxhash import xxh3_128_digest

        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            digests, counts, ends, starts, ids = [], [], [], [], batch.column(0).to_pylist()
            for text in batch.column(1):
                data = (text.as_py() or "").encode("utf-8", "replace")
                stops = cuts(data)
                begins = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
                digests.extend([xxh3_128_digest(data[a:b]) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)])
                if not data.isascii():
                    points = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)])
                    begins, stops = points[begins], points[stops]
                counts.append(len(stops))
                starts.append(begins)
                ends.append(stops)
            n = np.array(counts, np.int64)
            rows = np.repeat(np.arange(row, row + len(n)), n)
            row += len(n)
            flat = lambda parts: pa.array(np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32))
            doc_ids = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n)))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), doc_ids, pa.array(rows), flat(starts), flat(ends)], [*DIGEST, "doc_id", "row", "at", "stop"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(chunk, _CHUNK)


def repeated_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start, stop, first_doc of every passage of ``docs`` (doc_id, text) that repeats.

    A passage is a run of neighbouring chunks of at least ``least`` characters
    in all, each of which another row holds too; ``first_doc`` is the smallest
    doc_id that holds its first chunk.  What repeats within one row alone is
    no passage.  Repeated rows repeat each other; null and empty texts have no
    chunks; texts of any length are cut whole; further columns are not read;
    an empty table gives no rows.
    """
    counts = chunk_documents(docs).groupBy(*DIGEST).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.min("row").alias("_low"), F.max("row").alias("_high"))
    repeats = materialize(counts.filter("_low < _high").select(*DIGEST, "first_doc", "n"), "repeats")
    # the rows of a hot digest are dealt to ``parts`` tasks, each of which holds a copy of its entry
    hot, parts = hot_keys(repeats, "digest").distinct().withColumn("_hot", F.lit(True)), width(docs.sparkSession)
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64("row", "at"), F.lit(parts))).otherwise(0).cast("int").alias("_part")
    copies = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))).alias("_part")
    entries = repeats.join(F.broadcast(hot), "digest", "left").select(*DIGEST, "first_doc", copies)
    chunks = chunk_documents(docs).join(F.broadcast(hot), "digest", "left").select(*DIGEST, "doc_id", "row", "at", "stop", part)
    # places of one text only meet in a group, so a group is no longer than a text
    held = chunks.join(entries, [*DIGEST, "_part"]).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "stop", "first_doc"))).alias("chunks"))

    def join_up(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, chunks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                start = stop = first = None
                for c in [*chunks, {"at": -1, "stop": -1, "first_doc": None}]:
                    if c["at"] != stop:
                        if stop is not None and stop - start >= least:
                            for column, value in zip(out, (doc_id, start, stop, first), strict=True):
                                column.append(value)
                        start, first = c["at"], c["first_doc"]
                    stop = c["stop"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "stop", "first_doc"])

    return held.mapInArrow(join_up, "doc_id long, start long, stop long, first_doc long")
