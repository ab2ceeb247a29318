"""Toxicity by a classifier chain.

The categories are predicted one after the other; each model sees the
probabilities of the earlier ones, and is trained on out-of-fold predictions
of them.  A labels table with one category of toxicity only can put any other
0/1 label before it, as the registered query does with low quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import FOLDS, SAMPLE, Chain, Scorer, chance, fit_chain, labelled_sample

#: Probability from which a document counts as toxic.
THRESHOLD = 0.35


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> Chain | None:
    """The chain over ``categories`` (0/1 columns of ``labels``) in that order; None without labelled documents."""
    found = labelled_sample(docs, labels, categories, sample)
    return fit_chain(categories, found, found.ids % 7919 % FOLDS) if found else None


def score_chain(docs: DataFrame, chain: Chain | None, categories: list[str]) -> DataFrame:
    """doc_id and ``p_<category>`` for every row of ``docs`` (doc_id, text).

    A null text counts as empty; a text of any length is read whole, and a
    batch of texts is held at a time; repeated rows are scored each, equal ones
    alike; further columns are not read, whatever their names; without a chain
    all probabilities are null; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not chain:
        return own.select("doc_id", *(F.lit(None).cast("double").alias(f"p_{c}") for c in categories))

    def score(batches):
        import pyarrow as pa

        scorer = Scorer(chain.models)
        for batch in batches:
            found = [[chance(z) for z in scorer.logits(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([p[k] for p in found], pa.float64()) for k in range(len(categories)))], ["doc_id", *(f"p_{c}" for c in categories)])

    return own.mapInArrow(score, "doc_id long, " + ", ".join(f"`p_{c}` double" for c in categories))


def find_toxic(docs: DataFrame, labels: DataFrame, categories: list[str], target: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``score_chain`` with ``is_<target>``: a probability of ``threshold`` or more.

    Nobody is toxic without labelled documents.
    """
    scored = score_chain(docs, train_chain(docs, labels, categories, sample), categories)
    return scored.withColumn(f"is_{target}", F.coalesce(F.col(f"p_{target}") >= threshold, F.lit(False)))
