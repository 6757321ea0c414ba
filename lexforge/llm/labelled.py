"""Bounded samples of labelled rows, and the small models that are fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.plans.tables import materialize

#: Labelled rows that a classifier is fitted on: all, or if there are more, about so many, those with the smallest hashes
#: of their ids.
SAMPLE_ROWS = 16_000
#: Parts of the hashes' range.
PARTS = 1 << 40


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id is in none."""
    return F.crc32(id_col.cast("long").cast("string").cast("binary")) % folds


def by_hash(value: Column, wanted: int, there: int) -> Column:
    """Whether a hash is among the smallest, so that about ``wanted`` of ``there`` rows are: no sort, no single task."""
    return F.lit(True) if there <= wanted else F.pmod(value, F.lit(PARTS)) < int(PARTS * (wanted / there))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, learns: Column, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, label) of about ``rows`` labelled rows at most for which ``learns`` (over doc_id) holds. Their ids are
    so few that they are broadcast to the texts, which are not shuffled; what is found is written, as it is read more than once. Of several labels of an id the largest counts, of
    several texts each; where there are more rows than asked for, as an id has many, the distinct ones are sampled by
    their texts, too."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    usable = marks.where(learns)
    bound = usable.where(by_hash(F.xxhash64("doc_id"), rows, usable.count()))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = materialize(found.join(F.broadcast(bound), "doc_id").select("doc_id", "text", "label"))
    there = marked.count()
    if there <= rows:
        return marked
    once = materialize(marked.distinct())
    return once.where(by_hash(F.xxhash64("doc_id", "text"), rows, once.count()))


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias for targets in [0, 1], by full gradients with adaptive steps."""
    w = np.zeros(x.shape[1] + 1)
    ones = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        grad = ones.T @ (1 / (1 + np.exp(-np.clip(ones @ w, -30, 30))) - y) / max(1, len(x))
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])
