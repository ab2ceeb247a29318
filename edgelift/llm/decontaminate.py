"""Benchmark items in documents, within an edit budget.

An item of n characters may differ by up to ``RATE * n`` edits.  Split into one
piece more than that, at least one piece of a true hit is untouched, so an
Aho-Corasick automaton over all pieces finds every place worth checking; the
item is then aligned there with Myers' bit-parallel distance.  Items are taken
in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edits for each character of an item.
RATE = 0.05
#: Normalized items below this length are matched without edits and as whole words.
LEAST = 20
#: Characters of items that one automaton holds.
BLOCK = 2_000_000
_SPACES = re.compile(r"[\W_]+")


def normalize(text: str | None) -> str:
    """Lower case, every run of other signs than letters and digits as one blank, a blank at both ends."""
    return f" {_SPACES.sub(' ', (text or '').lower()).strip()} "


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in budget + 1 pieces of nearly equal length, with their offsets."""
    n = len(item)
    edges = [n * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the pattern's best end in the text, if at most ``most``; bit-parallel over the pattern."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = full, 0, m, (most + 1, 0)
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = (minus | ~(xh | plus)) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best[0]:
            best = (score, j)
        ph = (ph << 1) & full  # a match may start anywhere
        mh = (mh << 1) & full
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv
    return best if best[0] <= most else None


class Matcher:
    """Finds the items of one block in texts; several items may share an id."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = [(i, t) for i, t in items if len(t) > 2]
        self.budget = [int(rate * len(t)) if len(t) >= LEAST else 0 for _, t in self.items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t) in enumerate(self.items):
            for offset, piece in pieces(t, self.budget[k]):
                places[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """item_id -> least distance of a hit in the normalized text."""
        found: dict[int, int] = {}
        if not self.items:
            return found
        checked: dict[int, int] = {}  # item -> where its last alignment began
        for end, (n, where) in self.automaton.iter(text):
            for k, offset in where:
                item, pattern = self.items[k]
                if found.get(item) == 0:
                    continue
                budget, begin = self.budget[k], end + 1 - n - offset
                if begin >= 0 and text.startswith(pattern, begin):
                    found[item] = 0
                # a hit that holds this piece begins within the budget of here, and the last stretch reached twice as far
                elif budget and abs(begin - checked.get(k, -budget - 1 - len(pattern))) > budget:
                    checked[k] = begin
                    hit = myers(pattern, text[max(0, begin - 2 * budget) : begin + len(pattern) + 2 * budget], budget)
                    if hit:
                        found[item] = min(hit[0], found.get(item, hit[0]))
        return found


def blocks(items: DataFrame, size: int | None = None):
    """Items (item_id, text) as normalized (item_id, text), in blocks of at most ``size`` characters (BLOCK), one after the other.

    The benchmark is the stated query set.  It passes through the driver a
    block at a time, and each block costs one automaton of bounded size and one
    pass over the documents.
    """
    out, room = [], size or BLOCK
    for r in items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        text = normalize(r["text"])
        if out and room < len(text):
            yield out
            out, room = [], size or BLOCK
        out.append((r["item_id"], text))
        room -= len(text)
    if out:
        yield out


@lru_cache(4)
def _matcher(items: tuple, rate: float) -> Matcher:
    return Matcher(list(items), rate)


def find_items(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance of every item found in every row of ``docs`` (doc_id, text).

    Null and empty texts and items match nothing; a text of any length is read
    whole; items are compared without regard to case, punctuation and white
    space; an item without letters or digits is left out; several texts under
    one item_id are one item, of which the nearest counts; repeated rows report
    each; further columns are not read; an empty table gives no rows.  With
    several blocks each one's hits are written before the next is fetched.
    """
    schema = "doc_id long, item_id long, distance long"
    own, found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), []
    for block in blocks(items):
        key = tuple(block)

        def match(batches, key=key):
            import pyarrow as pa

            matcher = _matcher(key, rate)
            for batch in batches:
                rows = [(d, i, n) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for i, n in sorted(matcher.find(normalize(t.as_py())).items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["doc_id", "item_id", "distance"])

        if found:
            found[-1] = materialize(found[-1], "hits")
        found.append(own.mapInArrow(match, schema))
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns.

    Null and empty texts hold nothing and stay; texts, items and repeats are
    taken as by ``find_items``.  Between blocks the rows left are written.
    """
    out, at = docs, docs.columns.index(text)
    for n, block in enumerate(blocks(items)):
        key = tuple(block)

        def keep(batches, key=key):
            import pyarrow as pa

            matcher = _matcher(key, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normalize(t.as_py())) for t in batch.column(at)], pa.bool_()))

        out = (materialize(out, "clean") if n else out).mapInArrow(keep, docs.schema)
    return out
