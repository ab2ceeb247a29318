"""Distinct pairs and joins of two long columns that shuffle little.

Rows are dealt by a hash of their key in sorted runs, without repeats and byte
by byte (``blocks``), which a shuffle's compression makes a few bytes a row.
A share of the keys must fit in a task's memory; ``shares`` keeps it small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Rows that a share should hold, about.
SHARE = 500_000
#: Stands for null while packed.
NULL = -(1 << 62)
RUNS = "task int, a binary, b binary"


def shares(rows: int) -> int:
    return max(8, -(-rows // SHARE))


def ordered(a, b):
    """The distinct rows of two arrays, in order."""
    import numpy as np

    if not len(a):
        return a, b
    lo, high, low, most = int(a.min()), int(a.max()), int(b.min()), int(b.max())
    wide = most - low + 1
    if (high - lo + 1) * wide < 1 << 62:
        code = np.sort((a - lo) * wide + (b - low))
        code = code[np.diff(code, prepend=-1) != 0]
        return code // wide + lo, code % wide + low
    at = np.lexsort((b, a))
    a, b = a[at], b[at]
    new = np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0))
    return a[new], b[new]


def runs(a, b, n: int) -> dict:
    """The distinct rows as runs, one a share of the keys ``a``."""
    import numpy as np

    a, b = ordered(a, b)
    share = ((a.astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)).astype("u2" if n <= 65536 else "int32")
    at = np.argsort(share, kind="stable")  # a still rises within a share
    a, b, share = a[at], b[at], share[at]
    starts = np.flatnonzero(np.append(True, share[1:] != share[:-1])) if len(a) else np.zeros(0, "int64")
    spans = list(zip(starts, [*starts[1:], len(a)], strict=True))
    return {"task": share[starts].astype("int32"), "a": [blocks._planes(np.diff(a[s:e], prepend=0)) for s, e in spans], "b": [blocks._planes(b[s:e]) for s, e in spans]}


def deal(rows: DataFrame, n: int) -> DataFrame:
    """Two columns of long as runs."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        def packed(held):
            a, b = (np.concatenate([batch.column(i).fill_null(NULL).to_numpy(zero_copy_only=False) for batch in held]) for i in (0, 1))
            made = runs(a, b, n)
            return pa.RecordBatch.from_arrays([pa.array(made["task"], pa.int32()), pa.array(made["a"], pa.binary()), pa.array(made["b"], pa.binary())], ["task", "a", "b"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= blocks.PACKED:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return rows.mapInArrow(pack, RUNS)


def opened(frame):
    """The rows of runs, as two arrays."""
    import numpy as np

    if not len(frame):
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    return np.concatenate([np.cumsum(blocks._numbers(x, "<i8")) for x in frame["a"]]), np.concatenate([blocks._numbers(x, "<i8") for x in frame["b"]])


def distinct(dealt: DataFrame) -> DataFrame:
    """u, v: the distinct rows of runs."""

    def merge(frame):
        import pandas as pd

        u, v = ordered(*opened(frame))
        return pd.DataFrame({"u": pd.array(u, "Int64"), "v": pd.array(v, "Int64")}).mask(lambda x: x == NULL) if (u == NULL).any() or (v == NULL).any() else pd.DataFrame({"u": u, "v": v})

    return dealt.groupBy("task").applyInPandas(merge, "u long, v long")


def join(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """Runs of (y, x) for the rows (k, x) of ``left`` and (k, y) of ``right`` with one k; all are runs by n shares."""

    def meet(frame):
        import numpy as np
        import pandas as pd

        k, x = opened(frame[frame["side"] == 0])
        m, y = ordered(*opened(frame[frame["side"] == 1]))
        x, k = x[k != NULL], k[k != NULL]
        first, last = np.searchsorted(m, k), np.searchsorted(m, k, "right")
        count = last - first
        at = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
        return pd.DataFrame(runs(y[at], np.repeat(x, count), n))

    both = left.withColumn("side", F.lit(0)).union(right.withColumn("side", F.lit(1)))
    return both.groupBy("task").applyInPandas(meet, RUNS)


def together(lines: DataFrame, n: int) -> DataFrame:
    """Runs of the pairs x < y that stand with one k in the runs of (k, x)."""

    def pair(frame):
        import numpy as np
        import pandas as pd

        k, x = ordered(*opened(frame))
        known = (k != NULL) & (x != NULL)
        k, x = k[known], x[known]
        more = np.searchsorted(k, k, "right") - np.arange(len(k)) - 1  # later ones of the same k
        upto = np.cumsum(more)
        cuts = np.searchsorted(upto, np.arange(blocks.WEDGES, upto[-1], blocks.WEDGES), "right") if len(k) else []
        made = []
        for lo, hi in zip([0, *cuts], [*cuts, len(k)], strict=True):
            count = more[lo:hi]
            one = np.repeat(np.arange(lo, hi), count)
            two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count)
            made.append(pd.DataFrame(runs(x[one], x[two], n)))
        return pd.concat(made, ignore_index=True)

    return lines.groupBy("task").applyInPandas(pair, RUNS)
