"""7. Toxicity by weak supervision.

Voters, up to ENTRIES of them, are single lexicon entries: words, and beginnings of words, that a bounded sample of labelled
rows finds far more often in toxic documents than chance would have it. An entry votes toxic on the documents that hold it
and abstains on the others. Pattern voters see how dense and how varied such entries are, shouting and capitals, and vote
either way. From here on the labels play no part: a generative label model starts from how many entries vote on a document,
estimates by expectation maximization how often each voter votes on toxic and on clean documents and how the votes are
correlated within each class, and counts correlated votes for less. So an entry that stands alone where the others abstain
loses its say. A linear classifier is trained on the posterior labels and scores every document from its whole text.

Rows: a null id is in no fold, so never held out; null and empty texts are scored as texts without words; repeated rows
alike; without labelled rows of both kinds every score is near 0 (near 1 if all are toxic); an empty table gives an empty table;
other columns are no inputs.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.labelled import SAMPLE_ROWS, fold, logistic, sample
from lexforge.llm.text import map_arrow

#: Lexicon entries at most; bytes of the beginning of a longer word; least toxic documents of an entry, least share of toxic
#: ones among its documents, and least distance from chance in standard deviations.
ENTRIES, STEM, LEAST_DOCS, LEAST_SHARE, LEAST_Z = 256, 5, 5, 0.8, 6.0
#: Rounds of the label model; score from which a document counts as toxic.
ROUNDS, THRESHOLD = 8, 0.7
#: Share of the covariance over all rows that is added to that within the classes, and the correlation up to which voters count
#: as independent.
SHRINK, CHANCE = 0.1, 0.3
#: Letters stay, A-Z lower-cased; ASCII punctuation parts words.
PLAIN = bytes(32 if chr(b) in string.punctuation else b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain_words(text: str) -> list[bytes]:
    return text.encode().translate(PLAIN).split()


def entries_of(words: list[bytes]) -> set[bytes]:
    """The words of a text, and the beginnings of the longer ones, marked by a star (which is no letter of a word)."""
    found = set(words)
    return found | {w[:STEM] + b"*" for w in found if len(w) > STEM}


def patterns(text: str, n_words: int, hits: int) -> list[float]:
    """The features beside single entries: the share of toxic-looking words, how many there are, shouting, capitals."""
    raw = text.encode()
    letters = max(1, len(raw))
    upper = len(raw) - len(raw.translate(None, string.ascii_uppercase.encode()))
    return [min(1.0, 50.0 * hits / max(1, n_words)), float(np.log1p(hits)), min(1.0, 20.0 * raw.count(b"!") / letters), upper / letters]


N_PATTERNS = 4


@dataclass
class Model:
    entries: list[bytes] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_PATTERNS))
    bias: float = -50.0
    #: Of each voter: how often it votes on toxic and on clean documents, as the label model sees it.
    rates: dict[str, tuple[float, float]] = field(default_factory=dict)

    def scorer(self) -> Callable[[str], float]:
        place = {w: i for i, w in enumerate(self.entries)}
        by_entry, rest, bias = self.weights[: len(place)], self.weights[len(place) :], self.bias

        def score(text: str) -> float:
            hits, more = found_in(text, place)
            z = bias + sum(by_entry[i] for i in hits) + float(np.dot(rest, more))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def found_in(text: str, place: dict[bytes, int]) -> tuple[list[int], list[float]]:
    """Entries that a text holds, ascending, and its patterns."""
    words = plain_words(text)
    found = ((w if w in place else w[:STEM] + b"*") for w in set(words))  # a word that is an entry is not its beginning, too
    hits = sorted({place[e] for e in found if e in place})
    return hits, patterns(text, len(words), len(hits))


def lexicon(rows: DataFrame) -> list[bytes]:
    """Entries of the sampled (text, label) that tell toxic documents, best first."""

    def make() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            total, toxic = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                entries = entries_of(plain_words(text))
                total.update(entries)
                if label:
                    toxic.update(entries)
            return {"entry": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64()), "p": pa.array([toxic[w] for w in total], pa.int64())}

        return each

    n, p = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not p or p == n:
        return []
    counts = map_arrow(rows.select("text", "label"), make, "entry binary, n long, p long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    share = p / n
    z = (F.col("p") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = counts.where((F.col("p") >= LEAST_DOCS) & (F.col("p") >= LEAST_SHARE * F.col("n"))).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    return [bytes(r["entry"]) for r in best.orderBy(F.desc("z"), "entry").limit(ENTRIES).collect()]


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of a 0/1 vote matrix, and the rates of votes by class. A zero says nothing. What a vote
    says is divided among it and the votes on the same row that are correlated with it within the classes."""
    votes = votes.astype(np.float32)
    q = start.astype(np.float64)
    rates = np.zeros((2, votes.shape[1]))
    apart = votes - votes.mean(axis=0)
    overall = apart.T @ apart / max(1, len(votes))
    for _ in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        cov = SHRINK * overall  # voters that the classes explain wholly would look uncorrelated
        for c, weight in ((0, 1 - q), (1, q)):
            rates[c] = (weight @ votes + 0.5) / (weight.sum() + 1)
            d = (votes - rates[c].astype(np.float32)) * np.sqrt(weight / max(1, len(votes)))[:, None].astype(np.float32)
            cov = cov + d.T @ d
        sd = np.sqrt(np.diag(cov)) + 1e-4
        alike = np.clip((cov / np.outer(sd, sd) - CHANCE) / (1 - CHANCE), 0, 1)
        np.fill_diagonal(alike, 0)
        says = np.log(rates[1] / rates[0])
        z = np.log(prior / (1 - prior)) + (votes * says / (1 + votes @ alike)).sum(axis=1)
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q, rates


def fit(rows: DataFrame) -> Model:
    """From a bounded (doc_id, text, label)."""
    entries = lexicon(rows.dropDuplicates(["text"]))  # copies of a document are no evidence for its words

    def make() -> Callable:
        place = {w: i for i, w in enumerate(entries)}

        def each(batch: pa.RecordBatch) -> dict:
            found = [found_in(t, place) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "label": batch.column(2), "hits": pa.array([h for h, _ in found], pa.list_(pa.int32())), "more": pa.array([m for _, m in found], pa.list_(pa.float64()))}

        return each

    got = map_arrow(rows.select("doc_id", "text", "label"), make, "doc_id long, label int, hits array<int>, more array<double>").toPandas().sort_values("doc_id", kind="stable")
    labels = got["label"].to_numpy(float)
    if not len(got) or labels.min() == labels.max():
        return Model(bias=30.0 if len(got) and labels.min() == 1 else -30.0)
    x = np.zeros((len(got), len(entries) + N_PATTERNS), np.float32)
    for i, hits in enumerate(got["hits"]):
        x[i, hits] = 1
    x[:, len(entries) :] = np.vstack(got["more"])
    more = x[:, len(entries) :]
    count = x[:, : len(entries)].sum(axis=1)
    seen = {"some": count > 0, "several": count > 1, "dense": more[:, 0] >= 1.0, "shouting": more[:, 2] >= 0.5, "capitals": more[:, 3] >= 0.3}
    seen |= {f"not {n}": ~v for n, v in seen.items()}
    votes = np.column_stack([x[:, : len(entries)], *seen.values()])
    posterior, rates = label_model(votes, np.clip(1 - 0.5**count, 0.02, 0.98))
    weights, bias = logistic(x, posterior, l2=3e-4)
    names = [e.decode("utf-8", "replace") for e in entries] + list(seen)
    return Model(entries, weights, bias, {n: (float(rates[1][i]), float(rates[0][i])) for i, n in enumerate(names)})


def score(text: Column, model: Model) -> Column:
    """The score of a text column."""
    made: list = []  # filled in the task

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(model.scorer())
        return pd.Series([made[0](t) for t in texts], dtype="float64")

    return of(F.coalesce(text, F.lit("")))


def train(docs: DataFrame, labels: DataFrame, learns: Column, rows: int = SAMPLE_ROWS, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``learns``, over doc_id, tells the rows whose labels may be used."""
    return fit(sample(docs, labels, label_col, learns, rows, id_col, text_col))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) with a model that never saw the labels of the held-out fold."""
    model = train(docs, labels, fold(F.col("doc_id"), folds) != held)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
