"""Packing of token streams into fixed-size training sequences.

Bounded-space online packing.  Every partition keeps at most ``open_windows``
windows.  A document first fills whole windows of its own; what remains goes to
the open window that it leaves with the least room (best fit).  When none has
room and all are open, the fullest one is topped up with a cut of the document
and emitted.  The windows still open at the end of a partition are merged in a
tree of bounded groups; the last rest is cut at powers of two, where a sequence
needs no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder

WINDOW = 1024
OPEN_WINDOWS = 64
#: Leftover groups that one merging task takes.
FAN_IN = 64

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LEFT = f"{PIECE}, ids binary, source long"


class _Rows:
    """Pieces as columns, with their ids only where a later stage needs them."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in range(9)]

    def add(self, *row) -> None:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)

    def emit(self, sequence: int, pieces: list[tuple], source: int | None = None) -> None:
        """pieces: (doc_id, start, doc_tokens, ids); with a source, they are left over."""
        offset = 0
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            self.add(doc_id, start, n, zlib.crc32(ids), total, sequence, offset, ids if source is not None else None, source)
            offset += n

    def batch(self):
        import pyarrow as pa

        types = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "source"]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, types, strict=True)], names)
        self.columns = [[] for _ in range(9)]
        return out


def pack_stream(documents: Iterator[tuple], window: int, open_windows: int) -> Iterator[tuple[bool, list[tuple]]]:
    """(full, pieces) for (doc_id, ids as bytes) in turn; those not full come last."""
    rooms: list[int] = []
    held: list[list[tuple]] = []
    for doc_id, ids in documents:
        total, at = len(ids) // 4, 0
        while total - at >= window:
            yield True, [(doc_id, at, total, ids[4 * at : 4 * (at + window)])]
            at += window
        while at < total:
            rest = total - at
            best = min((i for i, room in enumerate(rooms) if room >= rest), key=rooms.__getitem__, default=None)
            if best is None:
                if len(rooms) < open_windows:
                    rooms.append(window)
                    held.append([])
                    best = len(rooms) - 1
                else:
                    best = min(range(len(rooms)), key=rooms.__getitem__)
            n = min(rest, rooms[best])
            held[best].append((doc_id, at, total, ids[4 * at : 4 * (at + n)]))
            rooms[best] -= n
            at += n
            if not rooms[best]:
                yield True, held.pop(best)
                rooms.pop(best)
    for pieces in held:
        yield False, pieces


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]


def cut_pieces(pieces: list[tuple], sizes: list[int]) -> Iterator[list[tuple]]:
    """The pieces in a row, cut into runs of the given sizes."""
    rest = list(reversed(pieces))
    for size in sizes:
        out = []
        while size:
            doc_id, start, total, ids = rest.pop()
            n = min(size, len(ids) // 4)
            out.append((doc_id, start, total, ids[: 4 * n]))
            if 4 * n < len(ids):
                rest.append((doc_id, start + n, total, ids[4 * n :]))
            size -= n
        yield out


def pack_documents(docs: DataFrame, path: str, kind: str = "byte", end_id: int = 0, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces (see ``PIECE``) that hold every id of every document exactly once.

    docs: needs ``doc_id`` and ``text``; other columns are not read.  A null or
    empty text is the end id alone; a null doc_id stays null; repeated rows are
    packed each on their own; a text of any length is cut across windows; an
    empty table gives no pieces.  Memory of a task: ``open_windows`` windows
    and one document; of a merging task ``fan_in * open_windows`` windows.
    """
    end = end_id.to_bytes(4, "little")

    def pack(batches):
        from pyspark import TaskContext

        part, code, out, at = TaskContext.get().partitionId(), encoder(path, kind), _Rows(), 0

        def documents():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc_id, code.encode(text.as_py()) + end

        for full, pieces in pack_stream(documents(), window, open_windows):
            out.emit(part << 32 | at, pieces, None if full else part)
            at += 1
            if len(out.columns[0]) >= 8192:
                yield out.batch()
        yield out.batch()

    pieces = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, _LEFT), "packed")
    done = [pieces.filter("source is null").drop("ids", "source")]
    left = pieces.filter("source is not null")
    level = 1
    while True:
        sources = left.agg(F.max("source")).first()[0]
        if sources is None:
            break
        last = sources < fan_in
        merged = materialize(left.withColumn("source", F.floor(F.col("source") / fan_in).cast("long")).groupBy("source").applyInPandas(_merge(level, window, last), _LEFT), "merged")
        done.append(merged.filter("source is null").drop("ids", "source"))
        left, level = merged.filter("source is not null"), level + 1
        if last:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _merge(level: int, window: int, last: bool):
    """The open windows of a group in a row; full ones are done, one rest stays."""

    def merge(frame):
        frame = frame.sort_values(["sequence_id", "offset"])
        pieces = [(None if d != d else d, int(s), int(t), i) for d, s, t, i in zip(frame["doc_id"].astype(object), frame["start"], frame["doc_tokens"], frame["ids"], strict=True)]
        n = sum(len(p[3]) for p in pieces) // 4
        group, out = int(frame["source"].iloc[0]), _Rows()
        sizes = [window] * (n // window) + (powers(n % window) if last else [n % window] * (n % window > 0))
        for k, run in enumerate(cut_pieces(pieces, sizes)):
            out.emit(level << 56 | group << 24 | k, run, group if not last and k == n // window else None)
        return out.batch().to_pandas()

    return merge
