"""9. Quality by Bradley-Terry pairwise ranking.

Each document has a strength, linear in features of its whole text: the shares of all byte values, and how much of it is
repeated. A bounded sample of labelled rows gives preference pairs, a good document over a bad one; logistic loss on the
differences of their features fits the weights. The cut is a quantile of the sample's strengths, the one that parts its
labels best, and strengths are mapped to scores so that it lies at the threshold.

Rows: a null id is in no fold, so never held out; null and empty texts have the features of no text; repeated rows are scored alike; without labelled rows of both
kinds every document scores 1 (0 if all are bad); an empty table gives an empty table; other columns are no inputs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.labelled import SAMPLE_ROWS, fold, sample
from lexforge.llm.text import map_arrow, words_of

#: Score from which a document is good; preference pairs, and pairs in a step.
THRESHOLD, PAIRS, STEP = 0.3, 400_000, 2_000


def features(text: str) -> np.ndarray:
    """Of one whole text."""
    raw = text.encode()
    words = words_of(text)
    n, size = len(words), max(1, len(raw))
    shares = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size)
    windows = max(0, n - 2)
    fresh = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    more = [
        np.log1p(n),
        min(n, 50) / 50,
        1 - fresh / windows if windows else 0.0,
        len(set(words)) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)),
        runs / max(1, n),
        sum(map(len, words)) / max(1, n) / 10,
        max(map(len, words), default=0) > 40,
    ]
    return np.concatenate([shares, np.array(more, float)])


N_FEATURES = 256 + 8


@dataclass
class Model:
    """score = sigmoid((weights . features - cut) / spread + logit(THRESHOLD))."""

    weights: np.ndarray
    cut: float
    spread: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights - self.cut) / self.spread + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(x: np.ndarray, good: np.ndarray, seed: int = 9, l2: float = 1e-4, pairs: int = PAIRS, rate: float = 0.02) -> np.ndarray:
    """Weights from pairs of a good and a bad row, drawn by a fixed seed."""
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    for t in range(1, pairs // STEP + 1):
        d = x[rng.choice(better, STEP)] - x[rng.choice(worse, STEP)]
        grad = -d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30)))) / STEP + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(rows: DataFrame) -> Model:
    """From a bounded (doc_id, text, label)."""

    def make() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], np.float32)
            return {"doc_id": batch.column(0), "label": batch.column(2), "x": pa.array([r.tobytes() for r in x], pa.binary())}

        return each

    got = map_arrow(rows.select("doc_id", "text", "label"), make, "doc_id long, label int, x binary").toPandas().sort_values("doc_id", kind="stable")
    good = got["label"].to_numpy() > 0
    if not len(got) or good.all() or not good.any():
        return Model(np.zeros(N_FEATURES), -30.0 if not len(got) or good.any() else 30.0, 1.0)
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), N_FEATURES)
    spread = x.std(axis=0) + 1e-3
    w = bradley_terry((x - x.mean(axis=0)) / spread, good) / spread
    strength = x @ w
    options = np.quantile(strength, np.linspace(0.002, 0.998, 499))
    right = [(good & (strength >= c)).sum() + (~good & (strength < c)).sum() for c in options]
    best = np.flatnonzero(np.array(right) == max(right))
    cut = float(options[best[len(best) // 2]])
    return Model(w, cut, float(np.std(strength)) / 2 or 1.0)


def score(text: Column, model: Model) -> Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        out = [model.scores(np.array([features(t) for t in texts.iloc[i : i + 512]])) for i in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0), dtype="float64")

    return of(F.coalesce(text, F.lit("")))


def train(docs: DataFrame, labels: DataFrame, learns: Column, rows: int = SAMPLE_ROWS, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``learns``, over doc_id, tells the rows whose labels may be used."""
    return fit(sample(docs, labels, label_col, learns, rows, id_col, text_col))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) with a model that never saw the labels of the held-out fold."""
    model = train(docs, labels, fold(F.col("doc_id"), folds) != held)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
