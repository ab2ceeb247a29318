"""Documents whose sets of word n-grams are nearly equal, by an exact set-similarity join.

Universe partition with pigeonhole.  Sets of a size band are split into
segments by a hash of their n-grams.  Two sets that reach the threshold differ
in at most ``distance`` n-grams, so with more segments than that some segment
is the same in both.  A segment is indexed by the hash of its subset of the
set, which bears no error, or also by its one-deletion neighbourhood, which
bears one and counts double.  How many segments a band gets, how many of them
with deletions, and how many a set may leave out because they hold next to
nothing, is the cheapest choice under a cost model of index entries and
overfull buckets.

Each document is first compared with one central member of its buckets.  What
is linked then needs no further comparison.  Members of a bucket that are still
in different components are compared within blocks of the bucket by parity
vectors.  The nearest pair of two components is verified first; members that
may still link to another component are compared by their hashes, where only
links that join two components are given out: a group of near copies yields as
many rows as it has members, and no connection is lost.  Every link is verified
on the n-grams of the texts themselves.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_keys, materialize, split_join, width
from .graph import components

#: Band edges grow by this factor; it exceeds the ratio of the sizes of two similar sets.
GROWTH = 4 / 3
#: Cost of a set that must index an empty segment, in index entries.
OVERFULL = 1000.0
#: Sets that a task remembers, to index copies once.
REMEMBERED = 50_000
#: Documents sampled for common n-grams, how many of them an n-gram must be in, and n-grams kept.
COMMON_SAMPLE, COMMON_LEAST, COMMON_MOST = 2000, 6, 20_000
#: Rows of a few numbers each (about 24 bytes) up to which a table is broadcast.
MOST_BROADCAST = 200_000
#: Members up to which a bucket's pairs are listed, and members of a block beyond.
FEW, BLOCK = 8, 2048
#: n-grams of texts (some 200 bytes each) that a verifying task remembers, besides the two it compares.
HELD = 100_000
#: Most bits of the parity vector that bounds the difference of two sets from below.
PARITY = 8192


def words(text: str | None) -> list[bytes]:
    """Runs of other signs than blank, tab, line feed, vertical tab, form feed and carriage return; A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def ngrams(text: str | None, n: int) -> set[tuple]:
    """Distinct n-grams of words; the whole sequence as one if it is shorter; nothing without words."""
    found = words(text)
    return set(zip(*(found[i:] for i in range(n)), strict=False)) if len(found) >= n else {tuple(found)} if found else set()


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``high`` n-grams, and how they are split."""

    number: int
    low: int
    high: int
    distance: int
    segments: int
    doubled: int
    spare: int


def allocate(distance: int, size: float) -> tuple[int, int, int]:
    """(segments, doubled, spare) of least cost; segments + doubled = distance + 1 + 2 * spare."""
    best = None
    for spare in range(17):
        for doubled in range(4):
            segments = distance + 1 + 2 * spare - doubled
            if segments < max(1, doubled) or spare > segments - doubled:
                continue
            held = size / segments
            empty = segments * math.exp(-held)
            over = 1 - sum(math.exp(-empty) * empty**k / math.factorial(k) for k in range(spare + 1))
            over += doubled * (1 + held) * math.exp(-held)  # nor may one deletion leave nothing
            cost = segments - spare + doubled * held + OVERFULL * over
            best = min(best or (cost, 0, 0, 0), (cost, segments, doubled, spare))
            if best[1] == 0:
                best = (cost, segments, doubled, spare)
    return best[1:]


@cache
def bands(percent: int, most: int) -> list[Band]:
    """Bands up to sets of ``most`` n-grams.  Sets of the first one are similar only if equal."""
    out, low, number = [], 1, 0
    while low <= most or number < 2:
        if number:
            high = max(low + 1, int(low * GROWTH))
        else:
            high = max(1, math.ceil((100 + percent) / (2 * (100 - percent))) - 1)
        distance = 2 * high * (100 - percent) // (100 + percent)
        out.append(Band(number, low, high, distance, *(allocate(distance, low) if distance else (0, 0, 0))))
        low, number = high + 1, number + 1
    return out


def mix(h):
    """splitmix64's finalizer, on unsigned 64-bit arrays."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 100_000:
            self.clear()
        self[word] = out = xxh3_64_intdigest(word)
        return out


_hashes = WordHashes()


def hashed_ngrams(text: str | None, n: int):
    """Sorted distinct 64-bit hashes of the n-grams."""
    import numpy as np

    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.array(list(map(_hashes.__getitem__, found)), np.uint64)
    k = min(n, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total = mix(total + h[i : len(h) - k + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(total)


def common_ngrams(docs: DataFrame, n: int):
    """Sorted hashes of n-grams that many sampled documents share, such as those of licence lines.

    Index entries leave them out, as two sets differ by no more without them
    than with them.  The bounded sample only steers cost, never the result.
    """
    import numpy as np

    def grams(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([hashed_ngrams(t.as_py(), n).view(np.int64) for t in batch.column(0)], pa.list_(pa.int64()))], ["grams"])

    chosen = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(COMMON_SAMPLE)  # so the broadcast has at most that many rows
    sample = docs.join(F.broadcast(chosen), "doc_id").select("text")
    counts = sample.mapInArrow(grams, "grams array<long>").select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    found = counts.filter(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "gram").limit(COMMON_MOST).select("gram").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def variants(grams, common, percent: int) -> list[tuple[int, object]]:
    """(salt, hashes to index): the set without common n-grams, or as it is if they are most of it; near the border both.

    Of two similar sets, one that is mostly uncommon leaves the other enough
    to be indexed without the common ones too.
    """
    import numpy as np

    if not len(common):
        return [(1, grams)]
    rest = grams[common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] != grams]
    t, out = percent / 100, []
    if 2 * len(rest) <= len(grams):
        out.append((1, grams))
    if len(rest) and len(rest) >= max(0.0, t / 2 - (1 + 1 / t) * (1 - t) / (1 + t)) * len(grams) - 1:
        out.append((2, rest))
    return out


def signatures(grams, percent: int, common=()):
    """Index entries of a set (sorted hashes): own band, and the next one if it can hold a similar larger set."""
    import numpy as np

    size, out = len(grams), []
    if not size:
        return np.empty(0, np.uint64)
    table = bands(percent, 2 ** max(8, size.bit_length() + 1))
    own = next(b for b in table if size <= b.high)
    near = [b for b in (own, table[own.number + 1]) if b.distance and 100 * size >= percent * b.low]
    for (kind, grams), band in product(variants(grams, common, percent), near):
        values = mix(grams ^ np.uint64(0x5851F42D4C957F2D))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        of = (grams >> np.uint64(40)) * np.uint64(band.segments) >> np.uint64(24)
        edges = np.searchsorted(of, np.arange(band.segments + 1, dtype=np.uint64))
        held = np.diff(edges)
        key = sums[edges[1:]] - sums[edges[:-1]]
        salt = mix(np.arange(band.segments, dtype=np.uint64) + np.uint64(band.number << 32 | kind << 24))
        light = sorted((n, i) for i, n in enumerate(held.tolist()) if i >= band.doubled)[: band.spare]
        stays = np.ones(band.segments, bool)
        stays[[i for _, i in light]] = False
        out.append(mix(key + salt)[stays])
        for i in range(band.doubled):
            out.append(mix(key[i] - values[edges[i] : edges[i + 1]] + salt[i]))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def node_of(grams) -> int:
    """A set's id: a digest of its hashes, signed 64 bits."""
    return int.from_bytes(blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def set_of_documents(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, node of each row of ``docs``; node is null for an empty set."""

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            grams = [hashed_ngrams(t.as_py(), n) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(g) for g in grams], pa.int64()), pa.array([node_of(g) if len(g) else None for g in grams], pa.int64())], ["doc_id", "n_shingles", "node"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, n_shingles long, node long")


def entries_of_documents(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """key, node: the index entries; copies that a task has just seen get none again."""
    common = common_ngrams(docs, n)

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        seen = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):  # small parts, as a text has hundreds of entries
                keys, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for text in batch.column(0).slice(lo, 500):
                    grams = hashed_ngrams(text.as_py(), n)
                    node = node_of(grams)
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    if node not in seen:
                        seen.add(node)
                        keys.append(signatures(grams, percent, common).view(np.int64))
                        nodes.append(np.full(len(keys[-1]), node, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["key", "node"])

    return docs.select("text").mapInArrow(sign, "key long, node long")


def members_of(entries: DataFrame) -> DataFrame:
    """key, node of the buckets with several nodes.

    Most keys are in one set only.  The entries pass through one exchange,
    sorted by key, and a row stays if a neighbour has its key; a bucket is
    never gathered, and holds a small part of all entries, as each set has many.
    """

    def runs(batches):
        import numpy as np
        import pyarrow as pa

        held, out = None, lambda k, n: pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["key", "node"])
        for batch in batches:
            if not batch.num_rows:
                continue
            k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            alone = True  # no row before the first one has its key
            if held:
                k, n, alone = np.append(held[0], k), np.append(held[1], n), held[2]
            new = np.append(True, (k[1:] != k[:-1]) | (n[1:] != n[:-1]))
            k, n = k[new], n[new]
            same = k[1:] == k[:-1]
            before, after = np.append(not alone, same), np.append(same, False)
            keep = before | after
            yield out(k[:-1][keep[:-1]], n[:-1][keep[:-1]])
            held = (k[-1], n[-1], not before[-1])
        if held and not held[2]:
            yield out([held[0]], [held[1]])

    near = materialize(entries.repartition(width(entries.sparkSession), "key").sortWithinPartitions("key", "node").mapInArrow(runs, "key long, node long"), "near")
    shared = near.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    return materialize(near.join(shared, "key").distinct(), "members")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) that are links; texts: node, text."""

    def count(batches):
        import pyarrow as pa

        known: OrderedDict[int, set] = OrderedDict()
        held = 0

        def grams(node, text):
            nonlocal held
            if node not in known:
                known[node] = ngrams(text.as_py(), n)
                held += len(known[node])
                while held > HELD and len(known) > 2:
                    held -= len(known.popitem(last=False)[1])
            known.move_to_end(node)
            return known[node]

        for batch in batches:
            u, v, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (a, b) in enumerate(zip(u, v, strict=True)):
                x, y = grams(a, batch.column(2)[i]), grams(b, batch.column(3)[i])
                both = len(x & y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = _small(pairs.select("u", "v"))
    one = texts.join(pairs, texts["node"] == pairs["u"]).select("u", "v", F.col("text").alias("first"))
    two = _of_nodes(texts, pairs.select(F.col("v").alias("node"))).select(F.col("node").alias("v"), F.col("text").alias("second"))
    return one.join(two, "v").select("u", "v", "first", "second").mapInArrow(count, "u long, v long")


def _of_nodes(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose node is among ``nodes``."""
    return texts.join(_small(nodes.select("node").distinct()), "node", "left_semi")


def parity(grams, bits: int):
    """One bit for each remainder of the hashes: odd or even.  Two sets differ at least as much as their vectors."""
    import numpy as np

    return np.packbits((np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def folded(vectors: list[bytes]):
    """Parity vectors as rows of 64-bit words, all at the length of the shortest."""
    import numpy as np

    least = min(len(v) for v in vectors)
    return np.array([np.bitwise_xor.reduce(np.frombuffer(v, np.uint8).reshape(-1, least)) for v in vectors]).view(np.uint64)


def close_pairs(sizes, vectors, group, part, first: int, second: int, percent: int):
    """(a, places b, distance by size) of members of two blocks that sizes and parity vectors do not tell apart, by current group."""
    import numpy as np

    for a in np.flatnonzero(part == first):
        can = (group != group[a]) & (part == second)
        if first == second:
            can[: a + 1] = False
        can = np.flatnonzero(can & (100 * np.minimum(sizes, sizes[a]) >= percent * np.maximum(sizes, sizes[a])))
        apart, both = np.bitwise_count(vectors[can] ^ vectors[a]).sum(1).astype(np.int64), sizes[can] + sizes[a]
        near = (100 + percent) * apart <= (100 - percent) * both
        yield a, can[near], apart[near] / both[near]


def _grouped(frame):
    import numpy as np

    component = frame["component"].tolist()
    number = {c: i for i, c in enumerate(dict.fromkeys(component))}
    return np.array([number[c] for c in component]), frame["part"].to_numpy(), frame["i"].iloc[0], frame["j"].iloc[0]


def dealt(rows: DataFrame, *columns: str):
    """Rows (key, node, component, held, ...) of buckets, grouped as pairs of blocks."""
    parts = F.ceil(F.col("held") / BLOCK).cast("int")
    out = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    return out.select("key", "node", "component", "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), *columns).groupBy("key", "i", "j")


def partners(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The members (key, node, component, held) of large buckets that may link to another component.

    key, node, component, and the nearest such member of a pair of blocks:
    mate, its component ``other`` and their distance.  Short parity vectors
    show it, which never call a link too far; a row a block pair.
    """

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(1):
                grams = hashed_ngrams(text.as_py(), n)
                out.append(parity(grams, max(64, min(PARITY, 1 << (2 * len(grams) - 1).bit_length()))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["node", "size", "bits"])

    def partnered(frame):
        import numpy as np
        import pandas as pd

        group, part, first, second = _grouped(frame)
        best, mate = np.full(len(frame), np.inf), np.zeros(len(frame), np.int64)
        for a, near, distance in close_pairs(frame["size"].to_numpy(), folded(frame["bits"].tolist()), group, part, first, second, percent):
            if len(near):
                nearer = distance < best[near]
                best[near[nearer]], mate[near[nearer]] = distance[nearer], a
                if distance.min() < best[a]:
                    best[a], mate[a] = distance.min(), near[distance.argmin()]
        alive = np.isfinite(best)
        key, node, component = (frame[c].to_numpy() for c in ("key", "node", "component"))
        return pd.DataFrame({"key": key[alive], "node": node[alive], "component": component[alive], "mate": node[mate[alive]], "other": component[mate[alive]], "distance": best[alive]})

    short = members.join(_of_nodes(texts, members).select("node", "text", "size").mapInArrow(vectors, "node long, size long, bits binary"), "node")
    return dealt(short, "size", "bits").applyInPandas(partnered, "key long, node long, component long, mate long, other long, distance double")


def nearest_pairs(close: DataFrame) -> DataFrame:
    """u, v: each node of ``partners`` with its nearest mate, and of those one pair for two components."""
    best = close.groupBy("node").agg(F.min(F.struct("distance", "mate", "component", "other")).alias("b"))
    ends = [F.least("b.component", "b.other").alias("one"), F.greatest("b.component", "b.other").alias("two")]
    pairs = best.select(*ends, F.struct("b.distance", F.greatest("node", "b.mate").alias("u"), F.least("node", "b.mate").alias("v")).alias("p"))
    return pairs.groupBy("one", "two").agg(F.min("p").alias("p")).select("p.u", "p.v")


def uniting(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """u, v: likely links among the members (key, node, component, held) of buckets that join components.

    They are compared by their hashes, and what links is united at once, so a
    block gives out fewer rows than it has members.
    """

    def hashes(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashed_ngrams(t.as_py(), n).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], ["node", "grams"])

    def unite(frame):
        import numpy as np
        import pandas as pd

        grams = [np.sort(g.view(np.uint64)) for g in frame["grams"]]
        size = np.array([len(g) for g in grams])
        bits = folded([parity(g, PARITY).tobytes() for g in grams])
        group, part, first, second = _grouped(frame)
        node, u, v = frame["node"].to_numpy(), [], []
        for a, near, _ in close_pairs(size, bits, group, part, first, second, percent):
            for b in near:
                if group[a] != group[b]:
                    both = len(np.intersect1d(grams[a], grams[b], assume_unique=True))
                    if 100 * both >= percent * (size[a] + size[b] - both):
                        u.append(max(node[a], node[b]))
                        v.append(min(node[a], node[b]))
                        group[group == group[b]] = group[a]
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return dealt(members.join(_of_nodes(texts, members).select("node", "text").mapInArrow(hashes, "node long, grams array<long>"), "node"), "grams").applyInPandas(unite, "u long, v long")


def open_buckets(placed: DataFrame, label: DataFrame) -> DataFrame:
    """key, node, component, held of the rows (key, node) of buckets that are still in several components."""
    placed = placed.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("held")).filter("a < b").select("key", "held")
    return materialize(placed.join(split, "key"), "open")


def similar_documents(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Rows link when 100 * common >= percent * united n-grams; ``component_id``
    is the smallest doc_id reachable.  Texts with equal sets are one node of
    the graph, so copies are never paired.  A null text, or one without words,
    has no n-grams and links with nothing, not even its like.  Rows with a
    null doc_id take part but never name a component that has other ids; rows
    that share a doc_id are judged each by its own text.  Texts are read whole;
    further columns are not read; an empty table gives no rows.
    percent: above 50, below 100.
    """
    return judged_sets(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def judged_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``similar_documents`` with ``node`` and ``component``, a node of the component; null for empty sets."""
    members = members_of(entries_of_documents(docs, n, percent))
    signed = materialize(set_of_documents(docs, n), "sets")
    nodes = materialize(signed.filter("node is not null").groupBy("node").agg(F.min("n_shingles").alias("size"), F.min("doc_id").alias("_id"), F.count("*").alias("n")), "nodes")
    texts = materialize(texts_of(docs, signed, members.select("node").distinct().join(nodes, "node").select("node", "_id", "size"), n), "texts")
    size = texts.select("node", "size")

    def fits(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow a link."""
        a, b = size.select(F.col("node").alias("u"), F.col("size").alias("_a")), size.select(F.col("node").alias("v"), F.col("size").alias("_b"))
        return pairs.join(a, "u").join(b, "v").filter(100 * F.least("_a", "_b") >= percent * F.greatest("_a", "_b")).select("u", "v")

    # each node with the one of its bucket mates that is in most buckets
    weight = members.groupBy("node").agg(F.count("*").alias("n"))
    weighed = members.join(weight, "node").select("key", F.struct("n", "node").alias("w"))
    central = weighed.groupBy("key").agg(F.max("w").alias("top"))
    # buckets with the same centre mostly have the same members, so they are taken as one from here on
    around = materialize(members.join(central, "key").select("top", "node").distinct(), "around")
    best = around.groupBy("node").agg(F.max("top").alias("top")).select(F.col("node").alias("u"), F.col("top.node").alias("v")).filter("u <> v")
    tried = materialize(best, "pairs")
    links = materialize(verify(fits(tried), texts, n, percent), "links")
    label = materialize(components(links), "label")
    open_ = open_buckets(around.select(F.col("top.node").alias("key"), "node"), label)
    few, many = open_.filter(F.col("held") <= FEW), open_.filter(F.col("held") > FEW)
    other = few.select("key", F.col("node").alias("v"), F.col("component").alias("c"))
    pairs = few.join(other, "key").filter("component <> c AND node > v").select(F.col("node").alias("u"), "v")
    # the nearest mates unite most components, so few sets are left whose hashes must be compared
    close = materialize(partners(many, texts, n, percent), "close")
    fresh = fits(pairs.union(nearest_pairs(close)).distinct().join(tried, ["u", "v"], "left_anti"))
    links = links.union(materialize(verify(fresh, texts, n, percent), "links"))
    rest = open_buckets(close.select("key", "node").distinct(), materialize(components(links), "label"))
    rest = rest.join(materialize(partners(rest, texts, n, percent).select("key", "node").distinct(), "close"), ["key", "node"])
    held = rest.groupBy("key").agg(F.count("*").alias("held"))
    links = links.union(materialize(verify(uniting(rest.drop("held").join(held, "key"), texts, n, percent).distinct(), texts, n, percent), "links"))
    # groups of near copies are hot components, groups of exact copies hot nodes
    label = materialize(components(links), "label")
    linked = materialize(label.join(nodes, "node").select("node", "component", "_id"), "linked")
    smallest = materialize(linked.groupBy("component").agg(F.min("_id").alias("component_id"), F.count("*").alias("n")), "smallest")
    named = split_join(linked.select("node", "component"), smallest.drop("n"), "component", hot_keys(smallest, "component"))
    alone = nodes.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"), F.col("_id").alias("component_id"))
    named = materialize(named.unionByName(alone), "named")
    return split_join(signed, named, "node", hot_keys(nodes, "node"), "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def texts_of(docs: DataFrame, signed: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, size, text of the ``wanted`` nodes (node, _id, size), by their least doc_id.

    Rows whose doc_id is null or not theirs alone are told apart by their sets.
    """
    rows, wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _small(wanted)
    odd = _odd_ids(signed)
    plain = rows.join(wanted, rows["doc_id"] == wanted["_id"]).select("doc_id", "node", "size", "text")
    if odd is None:
        return plain.drop("doc_id")
    found = with_nodes(_of_ids(rows, odd), n).drop("doc_id").join(wanted, "node").select("node", "size", "text").dropDuplicates(["node"])
    return plain.join(odd, "doc_id", "left_anti").drop("doc_id").unionByName(found)


def _odd_ids(signed: DataFrame) -> DataFrame | None:
    """The doc_ids that are null or on several rows; None without any."""
    odd = _small(signed.groupBy("doc_id").count().filter("doc_id is null or count > 1").select("doc_id"))
    return None if odd.isEmpty() else odd


def _of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among ``ids``, null included."""
    return rows.join(ids.withColumnRenamed("doc_id", "_odd"), F.col("doc_id").eqNullSafe(F.col("_odd")), "left_semi")


def with_nodes(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (``text`` and others) with the node of each."""

    def add(batches):
        import pyarrow as pa

        for batch in batches:
            grams = [hashed_ngrams(t.as_py(), n) for t in batch.column("text")]
            yield batch.append_column("node", pa.array([node_of(g) if len(g) else None for g in grams], pa.int64()))

    return rows.mapInArrow(add, T.StructType([*rows.schema.fields, T.StructField("node", T.LongType())]))


def _small(frame: DataFrame) -> DataFrame:
    """To be broadcast if it is small enough; else it is joined like any other."""
    frame = materialize(frame, "small")
    return F.broadcast(frame) if frame.count() <= MOST_BROADCAST else frame


def keep_first(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    Rows without a doc_id stay, and those without n-grams; of rows that repeat
    a doc_id, one of each component stays if the doc_id is its smallest, and
    one of each text without n-grams.  All columns stay as they are.
    """
    judged = materialize(judged_sets(docs, n, percent), "judged")
    later = _small(judged.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct())
    odd = _odd_ids(judged)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"))
    if odd is None:
        return rows.join(later, rows["doc_id"] == later["_id"], "left_anti").select("doc.*")
    once = rows.join(odd, "doc_id", "left_anti")  # null ids are kept by this join
    nameless, once = once.filter("doc_id is null"), once.filter("doc_id is not null")
    again = _of_ids(rows, odd).filter("doc_id is not null").select("doc", "doc_id", F.col("doc.text").alias("text"))
    verdict = judged.join(odd.filter("doc_id is not null"), "doc_id", "left_semi").filter("node is not null").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), "component", "component_id").distinct()
    again = with_nodes(again, n).join(verdict, (F.col("doc_id") == F.col("_id")) & (F.col("node") == F.col("_node")), "left").filter("component_id is null or component_id = doc_id")
    # the one of each component (or empty text) that comes first by its text
    again = again.groupBy("doc_id", "component", F.when(F.col("component").isNull(), F.coalesce("text", F.lit(""))).alias("_text")).agg(F.min_by("doc", F.struct("text")).alias("doc"))
    return once.join(later, once["doc_id"] == later["_id"], "left_anti").select("doc.*").unionByName(again.select("doc.*")).unionByName(nameless.select("doc.*"))
