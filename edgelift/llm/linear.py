"""Linear document classifiers, fitted on a bounded sample of labelled rows.

Features of a text: shares of character classes and of repeated words, each
put into bins at fixed quantiles, and presence of the words that tell the
classes apart best (log-likelihood ratio statistic).  A word's beginnings
count too, with their density, so that inflected forms share weight.

The sample's words are counted on the cluster; what reaches the driver is one
Arrow table of at most ``SAMPLE`` rows, with pairs of numbers for those of the
``CANDIDATES`` best words that a text holds.  The fit is ridge logistic
regression by Newton's method over at most ``WORDS`` words a category; its
matrix holds 32-bit floats and its Hessian is summed by blocks of rows, so the
driver needs some 50 MB for it.  Scoring runs everywhere.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled documents that a fit takes at most, by a hash of their ids.
SAMPLE = 6000
#: Words that a category's model takes at most, and labelled documents that must have one.
WORDS, LEAST_DOCS = 200, 4
#: Statistic that a word must reach; thousands are tried, so chance ones must stay out.
LEAST_STATISTIC = 15.0
#: Words of the sample that reach the driver: the best by the same statistic.
CANDIDATES = 3000
#: Ridges of the bins' weights, and of the words', which have to pass the statistic first.
BIN_RIDGE, WORD_RIDGE = 1.0, 0.05
#: Lengths of the beginnings of words that are features too.
STEMS = (4, 5, 6, 7)
#: Quantiles of the dense features at which bins begin; junk is rare, so the tails are finer.
QUANTILES = (0.01, 0.03, 0.1, 0.3, 0.5, 0.7, 0.85, 0.9, 0.93, 0.95, 0.97, 0.99)
BINS = 2 * len(QUANTILES) + 1
FOLDS = 5
#: Rows whose part of the Hessian is summed at once; words whose forms a worker remembers.
ROWS, MEMO = 1000, 100_000
#: Texts whose words, with all their forms, a task of the fit holds at once (some 300 KB each).
FEW = 50
_WORD = re.compile(r"[^\W_]+").findall


def describe(text: str | None) -> tuple[list[float], Counter]:
    """Dense features of a text, and its words with their counts."""
    import numpy as np

    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    upto = [0, *np.cumsum(raw).tolist()]
    many = lambda a, b: upto[b] - upto[a]
    size = max(1, upto[-1])
    found = _WORD(text.lower())
    words, n = Counter(found), max(1, len(found))
    letters = many(65, 91) + many(97, 123) + many(128, 256)
    blank = many(32, 33) + many(9, 14)
    digits = many(48, 58)
    return [
        math.log1p(n),
        many(65, 91) / max(1, letters),
        digits / size,
        (size - letters - blank - digits) / size,
        many(124, 125) / n,
        many(33, 34) / n,
        (many(35, 39) + many(42, 43)) / n,
        (many(46, 47) + many(44, 45)) / n,
        many(10, 11) / n,
        letters / n,
        len(words) / n,
        max(words.values(), default=0) / n,
    ], words


def forms(word: str) -> tuple[str, ...]:
    """The word and its beginnings (``begi*``)."""
    return (word, *(word[:k] + "*" for k in STEMS if len(word) > k))


def shares(words: Counter, of) -> dict[str, float]:
    """Counts, for each hundred words, of the forms that ``of`` gives for each word."""
    out: dict[str, float] = {}
    one = 100 / max(1, words.total())
    for w, c in words.items():
        for f in of(w):
            out[f] = out.get(f, 0.0) + c * one
    return out


class Known(dict):
    """Maps a word to those of its forms that some model has."""

    def __init__(self, wanted):
        self.wanted = wanted

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > MEMO:
            self.clear()
        self[word] = out = tuple(f for f in forms(word) if f in self.wanted)
        return out


@dataclass
class Sample:
    """Labelled documents in ascending doc_id order, their words as (row, word, share) triples."""

    ids: object
    labels: list
    dense: object
    names: list[str]
    row: object
    word: object
    share: object

    def part(self, mask) -> Sample:
        import numpy as np

        keep = mask[self.row]
        return Sample(self.ids[mask], [y[mask] for y in self.labels], self.dense[mask], self.names, (np.cumsum(mask) - 1)[self.row[keep]], self.word[keep], self.share[keep])


@dataclass
class Model:
    """One logistic model: bin edges, names of its words by number, weights by column; extra inputs come last."""

    edges: list
    words: dict[str, int]
    weights: list[float]

    def logit(self, dense: list[float], found: dict[str, float], extra=()) -> float:
        """found: shares of the forms in a text, those of the model at least."""
        w = self.weights
        total = w[0]
        for i, (value, edge) in enumerate(zip(dense, self.edges, strict=True)):
            total += w[1 + i * BINS + bisect_right(edge, value)]
        at = 1 + len(dense) * BINS
        for f, share in found.items():
            k = self.words.get(f)
            if k is not None:
                total += w[at + 2 * k]
                if f[-1] == "*":  # anyone's texts have a few such forms, so their density counts
                    total += w[at + 2 * k + 1] * math.log1p(share)
        return total + sum(a * b for a, b in zip(w[len(w) - len(extra) :], extra, strict=True))


def design(edges: list, words: list[int], sample: Sample, extra):
    """The matrix of a model's inputs; words: places in the sample's names."""
    import numpy as np

    n, d = sample.dense.shape
    at = 1 + d * BINS
    x = np.zeros((n, at + 2 * len(words) + extra.shape[1]), np.float32)
    x[:, 0] = 1
    for i in range(d):
        x[np.arange(n), 1 + i * BINS + np.searchsorted(edges[i], sample.dense[:, i], "right")] = 1
    place = np.full(len(sample.names) + 1, -1)
    place[words] = np.arange(len(words))
    column = place[sample.word]
    hit = column >= 0
    x[sample.row[hit], at + 2 * column[hit]] = 1
    hit &= np.array([name.endswith("*") for name in sample.names] + [False])[sample.word]
    x[sample.row[hit], at + 2 * column[hit] + 1] = np.log1p(sample.share[hit])
    x[:, x.shape[1] - extra.shape[1] :] = extra
    return x


def statistic(hit, total, positives: float, n: float):
    """G statistic of the 2x2 tables of words that ``total`` of ``n`` texts have, ``hit`` of the ``positives``."""
    import numpy as np

    a, t, rest = hit.astype(float), total.astype(float), n - positives
    cells = [(a, t * positives / n), (t - a, t * rest / n), (positives - a, (n - t) * positives / n), (rest - t + a, (n - t) * rest / n)]
    return sum(np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0) for o, e in cells)


def telling_words(sample: Sample, y, most: int = WORDS, least: int = LEAST_DOCS) -> list[int]:
    """The words whose presence tells y best, best first and ties by name."""
    import numpy as np

    positives, n = float(y.sum()), len(y)
    if not 0 < positives < n:
        return []
    total = np.bincount(sample.word, minlength=len(sample.names))
    hit = np.bincount(sample.word[y[sample.row] == 1], minlength=len(sample.names))
    g = statistic(hit, total, positives, n)
    good = [i for i in np.flatnonzero((total >= least) & (g > LEAST_STATISTIC)).tolist()]
    return sorted(good, key=lambda i: (-g[i], sample.names[i]))[:most]


def newton(x, y, ridge, steps: int = 12):
    """Weights of logistic regression with a ridge for each column."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        slope, bend = -ridge * w, np.diag(ridge)
        for i in range(0, len(x), ROWS):
            part = x[i : i + ROWS]
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope += part.T @ (y[i : i + ROWS] - p)
            bend += (part * (p * (1 - p) + 1e-9)[:, None].astype(np.float32)).T @ part
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def edges_of(values) -> list[float]:
    """Where bins begin: the quantiles, and just above a value that several of them share, so that it has its own bin."""
    import numpy as np

    found, times = np.unique(np.quantile(values, QUANTILES), return_counts=True)
    return sorted({*found.tolist(), *np.nextafter(found[times > 1], np.inf).tolist()})


def fit(sample: Sample, y, extra=None, held: tuple | None = None):
    """The model of the labels y; extra: one row of further inputs for each document.

    held: another sample and its extra inputs, whose log-odds are returned instead.
    """
    import numpy as np

    extra = np.zeros((len(y), 0)) if extra is None else extra
    edges = [edges_of(sample.dense[:, i]) for i in range(sample.dense.shape[1])]
    words = telling_words(sample, y)
    x = design(edges, words, sample, extra)
    ridge = np.full(x.shape[1], WORD_RIDGE)
    ridge[0], ridge[1 : 1 + len(edges) * BINS] = 1e-6, BIN_RIDGE
    weights = newton(x, y.astype(float), ridge)
    if held:
        return design(edges, words, *held) @ weights
    return Model(edges, {sample.names[k]: i for i, k in enumerate(words)}, weights.tolist())


def chance(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Scorer:
    """Log-odds of a text by models of which each sees the probabilities of those before it."""

    def __init__(self, models: list[Model]):
        self.models, self.known = models, Known(set().union(*(m.words for m in models)))

    def logits(self, text: str | None) -> list[float]:
        dense, words = describe(text)
        found = shares(words, self.known.__getitem__)
        out: list[float] = []
        for model in self.models:
            out.append(model.logit(dense, found, [chance(z) for z in out] if len(self.models) > 1 else ()))
        return out


@dataclass
class Chain:
    """Models of the categories in order; each sees the probabilities of those before it."""

    names: list[str]
    models: list[Model]


def fit_chain(names: list[str], sample: Sample, folds) -> Chain:
    """Later models are trained on out-of-fold probabilities of the earlier ones; folds: a fold for each document."""
    import numpy as np

    models, extra = [], np.zeros((len(sample.ids), 0))
    for k, y in enumerate(sample.labels):
        models.append(fit(sample, y, extra))
        if k == len(names) - 1:
            break
        z = np.zeros(len(y))
        for fold in range(FOLDS):
            out = folds == fold
            if out.any() and not out.all():
                z[out] = fit(sample.part(~out), y[~out], extra[~out], (sample.part(out), extra[out]))
        extra = np.hstack([extra, 1 / (1 + np.exp(-np.clip(z, -30, 30)))[:, None]])
    return Chain(names, models)


def labelled_sample(docs: DataFrame, labels: DataFrame, names: list[str], sample: int = SAMPLE) -> Sample | None:
    """At most ``sample`` documents that are labelled; None without any.

    Labelled rows with a null id or a null label in ``names`` take no part; of
    several labels of one id the greatest count, of several documents the one
    whose text has the smallest hash.
    """
    import numpy as np

    marks = [f"_{c}" for c in names]
    known = labels.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in ["doc_id", *names])).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.col(c).cast("int")).alias(m) for c, m in zip(names, marks, strict=True)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # so the broadcast has at most that many rows
    chosen = known.join(own.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = own.join(F.broadcast(materialize(chosen, "chosen")), "doc_id").groupBy("doc_id", *marks).agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))

    def features(batches):
        import pyarrow as pa

        for part in (batch.slice(lo, FEW) for batch in batches for lo in range(0, batch.num_rows, FEW)):
            found = [(dense, shares(words, forms)) for dense, words in map(describe, part.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([d for d, _ in found], pa.list_(pa.float64())), pa.array([list(w) for _, w in found], pa.list_(pa.string())), pa.array([list(w.values()) for _, w in found], pa.list_(pa.float32()))], [*part.schema.names[1:], "dense", "words", "shares"])

    ddl = "doc_id long, " + ", ".join(f"`{c}` int" for c in marks) + ", dense array<double>"
    got = materialize(rows.select("text", "doc_id", *marks).mapInArrow(features, ddl + ", words array<string>, shares array<float>"), "sample")
    size = got.agg(F.count("*"), *(F.sum(c) for c in marks)).first()
    if not size[0]:
        return None
    counts = got.select(*marks, F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in marks)).filter(F.col("n") >= LEAST_DOCS)
    scores = [_statistic(F.col(c), F.col("n"), size[1 + k], size[0]) for k, c in enumerate(marks)]
    best = counts.select("word", (F.greatest(*scores) if len(scores) > 1 else scores[0]).alias("g")).orderBy(F.desc("g"), "word").limit(CANDIDATES)
    wanted = sorted(r["word"] for r in best.collect())
    number = {w: i for i, w in enumerate(wanted)}

    def narrow(batches):
        import pyarrow as pa

        at = len(marks) + 2
        for batch in (whole.slice(lo, FEW) for whole in batches for lo in range(0, whole.num_rows, FEW)):
            kept = [[(number[w], x) for w, x in zip(*pair, strict=True) if w in number] for pair in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array([[w for w, _ in x] for x in kept], pa.list_(pa.int32())), pa.array([[x for _, x in k] for k in kept], pa.list_(pa.float32()))], batch.schema.names)

    table = got.mapInArrow(narrow, ddl + ", words array<int>, shares array<float>").toArrow().sort_by("doc_id").combine_chunks()
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    lengths = np.array([len(x) for x in table.column("words")], np.int64)
    return Sample(table.column("doc_id").to_numpy(), [table.column(c).to_numpy() for c in marks], flat("dense").reshape(table.num_rows, -1), wanted, np.repeat(np.arange(table.num_rows), lengths), flat("words").astype(np.int64), flat("shares"))


def _statistic(hit, n, positives, total):
    """``statistic`` as a column."""
    positives, total = positives or 0, max(1, total)
    cells = [(hit, n * positives / total), (n - hit, n * (total - positives) / total), (positives - hit, (total - n) * positives / total), (total - positives - n + hit, (total - n) * (total - positives) / total)]
    return sum((F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
