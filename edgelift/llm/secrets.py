"""Secrets in texts: three patterns, and character Markov models for the rest.

Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are counted from a labelled sample that a seeded
generator makes: keys over the usual alphabets, and names put together from
common words in the usual ways.  So the models are the same for every corpus,
and no text that is to be judged takes part in its own judgement.  A run of
identifier characters outside the patterns' matches whose mean log-likelihood
ratio per transition is high enough is a secret too.  DataFrame functions only:
positions come from the gaps and matches of a pattern, scores from a table of
one value per pair of characters.
"""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pattern, group whose length counts, least length.  Fixed values.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),
}
KINDS = [*BASE, "markov"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Labelled strings of each kind, and the words that ordinary ones are made of.
LABELLED = 4000
COMMON = (
    "account action address all and application article author available back base before between block body build button by cache call category change check child class client code color column command comment "
    "common config connection content context control copy count create current data date default delete description document down edit element email enable end english error event example external field file "
    "filter find first for form format from function general get group handler has header height hello home html http icon id image implementation import index information input instance international interface "
    "internal item java key label language last left length level library line link list load local location log main management manager map margin match max member menu message method min mode model module month "
    "move name national next node not number object of on open option order organization original other output package page parameter parent password path position post preview print private process product "
    "profile program project property provider public query read record reference register remove report request required resource response result return right row sample save script search section select send "
    "server service session set setting shop show simple size sort source standard start state status stop string style subject support system table tag target template test text the their this time title to token "
    "transaction tree type under unit university update upload url user utility value vector version view visible web width window with without word work world www year"
).split()
#: Runs that the models judge; shorter ones say too little.
RUN = "[A-Za-z0-9+/_=-]{16,}"
#: Least mean log-likelihood ratio per transition, in nats.
THRESHOLD = 1.3
#: Weight of single characters in the models, in occurrences.
BACKOFF = 20.0
_BLOCK = 256
_SPAN = "struct<at:int,stop:int,value:string,part:string>"


def _spans(text: str, pattern: str, group: int) -> Column:
    """Array of (at, stop, value, part) of a pattern's matches, leftmost first, in code points.

    Gaps and matches alternate, so places are running sums of their lengths,
    taken block by block to keep long arrays cheap.
    """
    q = pattern.replace("\\", "\\\\").replace("'", "\\'")
    parts = f"regexp_extract_all({text}, '{q}', {group})"
    step = (
        "(a, i) -> named_struct('pos', a.pos + length(x.gaps[i]) + length(x.hits[i]), 'out', concat(a.out, array(named_struct("
        "'at', a.pos + length(x.gaps[i]), 'stop', a.pos + length(x.gaps[i]) + length(x.hits[i]), 'value', x.hits[i], 'part', x.parts[i]))))"
    )
    inner = f"aggregate(sequence(b * {_BLOCK}, least(size(x.hits), (b + 1) * {_BLOCK}) - 1), named_struct('pos', o.pos, 'out', cast(array() as array<{_SPAN}>)), {step})"
    outer = f"aggregate(sequence(0, (size(x.hits) - 1) div {_BLOCK}), named_struct('pos', 0, 'out', cast(array() as array<array<{_SPAN}>>)), (o, b) -> transform(array({inner}), n -> named_struct('pos', n.pos, 'out', concat(o.out, array(n.out))))[0])"
    all_of = f"transform(array(named_struct('gaps', split({text}, '{q}', -1), 'hits', regexp_extract_all({text}, '{q}', 0), 'parts', {parts})), x -> flatten({outer}.out))[0]"
    return F.expr(f"CASE WHEN {text} RLIKE '{q}' THEN {all_of} ELSE cast(array() as array<{_SPAN}>) END")


def base_spans(text: str) -> Column:
    """Array of (at, order, stop, value) of the three patterns' matches that are long enough, sorted."""

    def one(order: int, pattern: str, group: int, least: int) -> Column:
        long_enough = F.filter(_spans(text, pattern, group), lambda s: F.length(s["part"]) >= least)
        return F.transform(long_enough, lambda s: F.struct(s["at"].alias("at"), F.lit(order).alias("order"), s["stop"].alias("stop"), s["part"].alias("value")))

    found = [one(order, *rule) for order, rule in enumerate(BASE.values())]
    return F.array_sort(F.concat(*found))


def runs(text: str) -> Column:
    """Array of (at, order, stop, value) of the runs that the models judge."""
    return F.transform(_spans(text, RUN, 0), lambda s: F.struct(s["at"].alias("at"), F.lit(len(BASE)).alias("order"), s["stop"].alias("stop"), s["value"].alias("value")))


def apart(spans: str, others: str) -> Column:
    """The spans that no other one touches."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["at"] < s["stop"]) & (s["at"] < o["stop"])))


def scan(rows: DataFrame) -> DataFrame:
    """``rows`` (text and others) with ``_base`` and ``_runs``."""
    whole = rows.withColumn("_whole", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return whole.withColumn("_base", base_spans("_whole")).withColumn("_runs", runs("_whole")).withColumn("_runs", apart("_runs", "_base")).drop("_whole")


def labelled_strings(seed: int = 1, n: int = LABELLED) -> tuple[list[str], list[str]]:
    """(random, ordinary) strings, ``n`` of each."""
    rng = random.Random(seed)
    upper, digits = ALPHABET[26:52], ALPHABET[52:62]
    alphabets = [ALPHABET[:62], ALPHABET[:65], upper + digits, ALPHABET[:26] + digits]
    keys = ["".join(rng.choices(alphabet, k=rng.randint(16, 48))) for alphabet in rng.choices(alphabets, [4, 2, 1, 1], k=n)]

    def name() -> str:
        parts = rng.choices(COMMON, k=rng.randint(2, 5))
        if rng.random() < 0.2:
            parts.append(str(rng.randint(0, 9999)))
        kind = rng.randrange(7)
        if kind < 2:
            out = "".join(p.capitalize() if i or kind else p for i, p in enumerate(parts))
        else:
            out = ("_", "-", "/", "", "_")[kind - 2].join(parts)
        return out.upper() if kind == 6 or rng.random() < 0.05 else out

    names = []
    while len(names) < n:
        names += [x for x in (name(),) if len(x) >= 16]
    return keys, names


def train(keys: list[str], names: list[str]) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random over ordinary; pairs back off to single characters."""
    rate = []
    for strings in (keys, names):
        pair = Counter(p for s in strings for p in zip(s, s[1:], strict=False))
        after = Counter(c for s in strings for c in s[1:])
        before = Counter(c for s in strings for c in s[:-1])
        total = after.total()
        single = {b: (after[b] + 0.5) / (total + 0.5 * len(ALPHABET)) for b in ALPHABET}
        rate.append([math.log((pair[a, b] + BACKOFF * single[b]) / (before[a] + BACKOFF)) for a in ALPHABET for b in ALPHABET])
    return [x - y for x, y in zip(*rate, strict=True)]


def markov_spans(model: list[float], threshold: float = THRESHOLD) -> Column:
    """Those of ``_runs`` that the models call random."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    place = lambda s, i: F.instr(F.lit(ALPHABET), F.substring(s, i, F.lit(1)))
    pair = lambda s, i: F.element_at(table, (place(s, i) - 1) * len(ALPHABET) + place(s, i + 1))
    total = lambda s: F.aggregate(F.sequence(F.lit(1), F.length(s) - 1), F.lit(0.0), lambda a, i: a + pair(s, i))
    return F.filter("_runs", lambda s: total(s["value"]) >= threshold * (F.length(s["value"]) - 1))


def render(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["order"] + 1), s["at"].cast("string"), s["stop"].cast("string"))))


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD, model: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs`` (doc_id, text).

    Spans are in code points, ends exclusive; those of one kind never overlap.
    A null text counts as empty and has no spans; a text of any length is read
    whole; repeated rows are kept; of a run at the threshold the models say it
    is a secret; further columns are not read; an empty table gives no rows.
    model: ``train``'s result, by default that of ``labelled_strings``.
    """
    scanned = scan(docs.select("doc_id", "text")).drop("text")
    count = lambda order: F.size(F.filter("_base", lambda s: s["order"] == order)).cast("long")
    spans = F.array_sort(F.concat("_base", markov_spans(model or train(*labelled_strings()), threshold)))
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(render(F.col("_base")), 256).alias("base_sha256"), render(spans).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", threshold: float = THRESHOLD, model: list[float] | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``, overlapping ones by one.

    Rows and all columns stay, whatever their names; ``n_chars``, where there
    is one, counts the new text of a row that was changed.  Null and empty
    texts stay as they are; repeated rows are masked each.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text"))
    spans = F.array_sort(F.concat("_base", markov_spans(model or train(*labelled_strings()), threshold)))
    marked = scan(rows).select("doc", "text", spans.alias("spans"))
    # spans are sorted: (done up to, text so far)
    state = F.struct(F.lit(0).alias("done"), F.lit("").alias("out"))
    piece = lambda a, upto: F.when(upto > a["done"], F.substring(F.col("text"), a["done"] + 1, upto - a["done"])).otherwise("")
    step = lambda a, s: F.struct(F.greatest(a["done"], s["stop"]).alias("done"), F.concat(a["out"], piece(a, s["at"]), F.when((s["at"] >= a["done"]), F.lit(mask)).otherwise("")).alias("out"))
    fold = F.aggregate("spans", state, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["done"] + 1, F.length("text"))))
    out = marked.select("doc", (F.size("spans") > 0).alias("hit"), F.when(F.size("spans") > 0, fold).otherwise(F.col("text")).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return out.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))
