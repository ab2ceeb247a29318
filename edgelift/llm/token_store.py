"""Token ids in a content-addressed store.

``write_store`` encodes every text and cuts its ids into chunks where a rolling
hash of the last 16 ids hits a mask.  Each chunk is named by its digest and
kept once; a document is a recipe (its chunk digests in order) under a Merkle
root.  A store holds three Parquet tables:

``kind=chunk``  key (``c`` + digest), payload (a width byte, then the ids)
``recipes``     one row a document in ascending doc_id order (files too)
``manifest``    the Merkle tree above the recipes, fan-out 1024, up to one root

``read_chunks`` checks every chunk against its name, ``read_checked`` checks the
manifest, puts the documents' checksums together along their recipes and checks
each Merkle root, and ``read_ids`` rebuilds the ids themselves.
"""

from __future__ import annotations

import zlib
from functools import cache
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, width
from .tokens import encoder

#: Chunk sizes in ids: least, the mask's mean beyond it, most.
LEAST, MEAN_BITS, MOST = 64, 8, 4096
#: Bytes of ids, about, that a task cuts together.
LOT = 4_000_000
#: Pre-tokens that a worker remembers in each of two generations (some 190 bytes each).
MEMO = 600_000
DIGEST = 16
MANIFEST_FAN = 1024


def _gear(n: int = 65536):
    """Random 16-bit words, by splitmix64 from a fixed seed."""
    import numpy as np

    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(48)).astype(np.uint16)


@cache
def gear_table():
    return _gear()


def rolling(values, table):
    """At each position the gear hash of the last 16 values, as 16 bits."""
    h = table[values]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << k
    return h


def cut(ids, least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks of an id array."""
    return cut_each(ids, [len(ids)], least, bits, most)[0]


def cut_each(ids, lengths: list[int], least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> list[list[int]]:
    """``cut`` of the arrays of those lengths that stand in ``ids`` one after the other; ends count from each one's begin.

    They are hashed together: a chunk has at least ``least`` ids, so no cut
    depends on a hash that reaches back over an array's begin.
    """
    import numpy as np

    if least < 16:
        raise ValueError("a chunk must be as long as the hash's window")
    hits = np.flatnonzero(rolling((ids & 0xFFFF).astype(np.uint16), gear_table()) >> np.uint16(16 - bits) == 0) + 1
    out, begin = [], 0
    borders = np.searchsorted(hits, np.cumsum([0, *lengths]), "right").tolist()
    hits = hits.tolist()
    for n, a, b in zip(lengths, borders, borders[1:], strict=False):
        ends, last = [], 0
        for hit in hits[a:b]:
            hit -= begin
            while hit - last > most:
                last += most
                ends.append(last)
            if hit - last >= least and hit < n:
                ends.append(hit)
                last = hit
        while n - last > most:
            last += most
            ends.append(last)
        out.append([*ends, n] if n else [])
        begin += n
    return out


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree; an odd node at the end moves up as it is."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def payload(ids) -> bytes:
    """ids: an array of unsigned 32-bit integers."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 65536 else b"\4" + ids.astype("<u4").tobytes()


def unpack(data: bytes) -> bytes:
    """The payload's ids as little-endian unsigned 32-bit integers."""
    import numpy as np

    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4").tobytes()


@cache
def _shift_tables(n: int) -> tuple[list[int], ...]:
    """Tables of the linear map that n zero bytes apply to a CRC-32 register."""
    times = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    step = [0xEDB88320 if i == 0 else 1 << i - 1 for i in range(32)]  # one bit
    total, n = [1 << i for i in range(32)], 8 * n
    while n:
        if n & 1:
            total = [times(step, v) for v in total]
        step = [times(step, v) for v in step]
        n >>= 1
    return tuple([_xor(total[8 * k + i] for i in range(8) if b >> i & 1) for b in range(256)] for k in range(4))


def _xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def join_crc(first: int, second: int, n_second: int) -> int:
    """CRC-32 of two byte strings in a row, from theirs and the second's length."""
    a, b, c, d = _shift_tables(n_second)
    return a[first & 255] ^ b[first >> 8 & 255] ^ c[first >> 16 & 255] ^ d[first >> 24] ^ second


def write_store(docs: DataFrame, store: str, path: str, kind: str = "word", end_id: int = 2) -> None:
    """Encode ``docs`` (doc_id, text) into a new store folder.

    A null or empty text is the end id alone.  Rows with a null doc_id come
    first, repeated rows are kept each; an empty table makes empty tables.
    """
    end = end_id.to_bytes(4, "little")

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, code, at = TaskContext.get().partitionId(), encoder(path, kind, MEMO), 0

        def stored(doc_ids, encoded):
            """The rows of some documents: their new chunks, and themselves."""
            nonlocal at
            ids = np.frombuffer(b"".join(encoded), "<u4")
            short = ids.astype("<u2").tobytes() if int(ids.max()) < 65536 else None
            keys, loads, ids_of, counts, recipes, begin = [], [], [], [], [], 0
            seen = set()
            lengths = [len(e) // 4 for e in encoded]
            for doc_id, n, ends in zip(doc_ids, lengths, cut_each(ids, lengths), strict=True):
                start, names = begin, []
                for stop in ends:
                    stop += begin
                    load = payload(ids[start:stop]) if short is None else b"\2" + short[2 * start : 2 * stop]
                    names.append(name := digest(load))
                    if name not in seen:
                        seen.add(name)
                        keys.append(b"c" + name), loads.append(load), ids_of.append(None), counts.append(None), recipes.append(None)
                    start = stop
                keys.append(b"d%8d%16d" % (part, at)), loads.append(None), ids_of.append(doc_id), counts.append(n), recipes.append(b"".join(names))
                at += 1
                begin += n
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(loads, pa.binary()), pa.array(ids_of, pa.int64()), pa.array(counts, pa.int64()), pa.array(recipes, pa.binary())], ["key", "payload", "doc_id", "n_tokens", "recipe"])

        for batch in batches:
            doc_ids, encoded, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                encoded.append(code.encode(text.as_py()) + end)
                size += len(encoded[-1])
                if size >= LOT:
                    yield stored(doc_ids, encoded)
                    doc_ids, encoded, size = [], [], 0
            if doc_ids:
                yield stored(doc_ids, encoded)

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "key binary, payload binary, doc_id long, n_tokens long, recipe binary")
    once = rows.groupBy("key").agg(*(F.first(c).alias(c) for c in ("payload", "doc_id", "n_tokens", "recipe")))
    once.withColumn("kind", F.when(F.col("payload").isNull(), "doc").otherwise("chunk")).write.partitionBy("kind").option("compression", "zstd").parquet(f"{store}/raw")

    def rooted(batches):
        import pyarrow as pa

        for batch in batches:
            roots = [merkle([r[i : i + DIGEST] for i in range(0, len(r), DIGEST)]) for r in batch.column("recipe").to_pylist()]
            yield batch.append_column("root", pa.array(roots, pa.binary()))

    ordered = _raw(spark, store).filter("kind = 'doc'").select("doc_id", "key", "n_tokens", "recipe").repartitionByRange(width(spark), "doc_id", "key").sortWithinPartitions("doc_id", "key").withColumn("shard", F.spark_partition_id())
    ordered.mapInArrow(rooted, "doc_id long, key binary, n_tokens long, recipe binary, shard int, root binary").write.parquet(f"{store}/recipes")
    _write_manifest(spark, store)


def _raw(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("key binary, payload binary, doc_id long, n_tokens long, recipe binary, kind string").parquet(f"{store}/raw")


def read_recipes(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, key, n_tokens, recipe, root; ``place`` counts the documents and ``start`` the ids before."""
    recipes = spark.read.schema("doc_id long, key binary, n_tokens long, recipe binary, shard int, root binary").parquet(f"{store}/recipes")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row a shard: their number is that of the writing tasks
    shards = recipes.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("ids"))
    shards = shards.select("shard", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before"))
    inside = Window.partitionBy("shard").orderBy("doc_id", "key")
    placed = recipes.withColumns({"nth": F.row_number().over(inside), "sum": F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    return placed.join(shards, "shard").select("doc_id", "key", "n_tokens", "recipe", "root", (F.col("docs_before") + F.col("nth") - 1).alias("place"), (F.col("ids_before") + F.col("sum") - F.col("n_tokens")).alias("start"))


def _parents(nodes: DataFrame) -> DataFrame:
    """place, children and hash of the nodes above ``nodes`` (place, hash)."""
    place = F.floor(F.col("place") / MANIFEST_FAN).cast("long")
    return nodes.groupBy(place.alias("parent")).agg(F.count("*").alias("children"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"])).cast("binary"), 256).alias("hash")).select(F.col("parent").alias("place"), "children", "hash")


def _leaves(recipes: DataFrame) -> DataFrame:
    """place and hash of each document: of its id, its length and its root."""
    return recipes.select("place", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens").cast("string"), F.hex("root")).cast("binary"), 256).alias("hash"))


def _level(spark: SparkSession, store: str, level: int) -> DataFrame:
    return spark.read.schema("place long, children long, hash string").parquet(f"{store}/manifest/level={level}")


def _write_manifest(spark: SparkSession, store: str) -> None:
    nodes, level = _leaves(read_recipes(spark, store)), 0
    while True:
        _parents(nodes).write.parquet(f"{store}/manifest/level={level}")
        nodes, level = _level(spark, store, level), level + 1
        if nodes.count() <= 1:
            return


def check_manifest(spark: SparkSession, store: str, recipes: DataFrame) -> None:
    """Fails unless the Merkle tree over ``recipes`` is the stored one, level by level up to its root."""
    nodes, level = _leaves(recipes), 0
    while True:
        stored = _level(spark, store, level).withColumn("stored", F.struct("children", "hash")).select("place", "stored")
        found = _parents(nodes).withColumn("found", F.struct("children", "hash")).select("place", "found")
        count, wrong = stored.join(found, "place", "full").agg(F.count("*"), F.count_if(~F.col("stored").eqNullSafe(F.col("found")))).first()
        if wrong:
            raise ValueError(f"{wrong} nodes of the manifest's level {level} do not fit the recipes")
        nodes, level = _level(spark, store, level), level + 1
        if count <= 1:
            return


def read_chunks(spark: SparkSession, store: str, contents: bool = False) -> DataFrame:
    """digest, crc, n (and the ids, as payload) of each chunk; one that does not match its name fails the task."""

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            names, sums, counts = [], [], []
            for key, load in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest(load) != key[1:]:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                ids = unpack(load)
                names.append(key[1:]), sums.append(zlib.crc32(ids)), counts.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sums, pa.int64()), pa.array(counts, pa.int64()), *([batch.column(1)] if contents else [])], ["digest", "crc", "n", *(["payload"] if contents else [])])

    return _raw(spark, store).filter("kind = 'chunk'").select("key", "payload").mapInArrow(check, "digest binary, crc long, n long" + ", payload binary" * contents)


def _parts(recipes: DataFrame) -> DataFrame:
    """root, nth, digest of each distinct recipe."""
    distinct = recipes.groupBy("root").agg(F.first("recipe").alias("recipe"))
    count = (F.length("recipe") / DIGEST).cast("int")
    return distinct.select("root", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("recipe"), i * DIGEST + 1, F.lit(DIGEST)))).alias("nth", "digest"))


def _verified(spark: SparkSession, store: str) -> DataFrame:
    """The recipes, after a check of the manifest over them."""
    recipes = materialize(read_recipes(spark, store), "recipes")
    check_manifest(spark, store, recipes)
    return recipes


def _whole(root: bytes, parts: list[dict]) -> None:
    if any(p["crc"] is None for p in parts) or merkle([p["digest"] for p in parts]) != root:
        raise ValueError(f"document {root.hex()} can't be rebuilt")


def _sized(recipes: DataFrame, whole: DataFrame, column: str) -> DataFrame:
    """doc_id, start, n_tokens and the ``column`` of ``whole`` (root, found and it), whose length must be the recipe's."""
    checked = F.when(F.col("found") == F.col("n_tokens"), F.col(column)).otherwise(F.raise_error(F.lit("a document has another length than its recipe")).cast(whole.schema[column].dataType))
    return recipes.join(whole, "root", "left").select("doc_id", "start", "n_tokens", checked.alias(column))


def read_checked(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    The manifest is computed again from the recipes and compared.  Each
    distinct recipe is followed once: the checksums of its chunks, taken from
    their contents, are combined in its order and its Merkle root is computed
    again.  A changed, lost or swapped recipe, a damaged or missing chunk or
    another length fails.
    """
    recipes = _verified(spark, store)

    def combine(batches):
        import pyarrow as pa

        for batch in batches:
            sums, counts = [], []
            for root, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _whole(root, parts)
                total, crc = 0, 0
                for p in parts:
                    crc = join_crc(crc, p["crc"], 4 * p["n"]) if total else p["crc"]
                    total += p["n"]
                sums.append(crc), counts.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64()), pa.array(counts, pa.int64())], ["root", "ids_crc32", "found"])

    followed = _parts(recipes).join(read_chunks(spark, store), "digest", "left").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("nth", "digest", "crc", "n"))).alias("parts"))
    return _sized(recipes, followed.mapInArrow(combine, "root binary, ids_crc32 long, found long"), "ids_crc32")


def read_ids(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of long): every document rebuilt from its chunks.

    Verified like ``read_checked``.  A document's ids must fit in a task's
    memory, as its text did; repeated rows come back each.
    """
    recipes = _verified(spark, store)

    def rebuild(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = []
            for root, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _whole(root, parts)
                ids.append(np.frombuffer(b"".join(unpack(p["payload"]) for p in parts), "<u4").astype("int64"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array([len(x) for x in ids], pa.int64())], ["root", "ids", "found"])

    followed = _parts(recipes).join(read_chunks(spark, store, True), "digest", "left").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("nth", "digest", "crc", "payload"))).alias("parts"))
    return _sized(recipes, followed.mapInArrow(rebuild, "root binary, ids array<long>, found long"), "ids")
