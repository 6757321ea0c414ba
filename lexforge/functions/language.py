"""Language identification by profiles of letter trigrams that are learned from counts over a corpus.

Lower-cased texts with everything but letters made one space give trigrams, which are hashed into slots. A language's profile are the
smoothed log shares of its slots; a text has the language under which its trigrams are most likely, weighed by all of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of trigrams, what each count starts from, and languages at most, the most frequent ones.
SLOTS, PRIOR, MOST = 1 << 16, 0.5, 64
_OTHER = regex.compile(r"[^\p{L}]+")


def trigram_slots(text: str) -> np.ndarray:
    """The slot of each trigram of a text, in its order."""
    points = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    mixed = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
    return ((mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype(np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            totals.setdefault(lang, np.zeros(SLOTS, np.int64))
            np.add.at(totals[lang], trigram_slots(text), 1)
    for lang, counts in totals.items():
        slots = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "slot": slots, "n": counts[slots]})


@dataclass
class Languages:
    """Names, and log shares by (language, slot)."""

    names: list[str]
    weights: np.ndarray

    def best(self, text: str | None) -> str | None:
        """The language of a text; none of one without letters."""
        slots = trigram_slots(text or "")
        return self.names[int(self.weights[:, slots].sum(axis=1).argmax())] if len(slots) > 1 and self.names else None

    def of(self, text: Column) -> Column:
        """The language as a column, for gates that ask for one."""

        @F.pandas_udf("string")
        def identify(texts: pd.Series) -> pd.Series:
            return pd.Series([self.best(t) for t in texts], dtype=object)

        return identify(text)


def learned(rows: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Profiles from all rows that name a language. A task sums up its own rows; the driver gets a number for each slot of each of
    the ``MOST`` most frequent languages at most."""
    named = rows.select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("lang IS NOT NULL")
    frequent = [r["lang"] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST).collect()]
    counts = named.where(F.col("lang").isin(frequent)).mapInPandas(_counted, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    names = sorted(frequent)
    table = np.full((len(names), SLOTS), PRIOR)
    for r in counts.toLocalIterator():
        table[names.index(r["lang"]), r["slot"]] += r["n"]
    return Languages(names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if names else table)
