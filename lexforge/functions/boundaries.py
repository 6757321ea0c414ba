"""Sentence boundaries with abbreviations that are learned from counts over the corpus (Kiss and Strunk, 2006).

A type that stands before a period much more often than words do, that is short, and that is rarely seen without the period is an
abbreviation: the log-likelihood ratio of that collocation, weighed by length, inner periods and occurrences without one. A text is
split after . ! ? and white space as ever, but not behind an abbreviation's period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.operators.chunking import sentences

# Fixed values of the method: share of periods after an abbreviation, and the score from which a type is one.
SURE, THRESHOLD = 0.99, 0.3
#: Abbreviations that a split is given at most, the highest scores.
MOST = 2000
DOTTED, PLAIN = "^\\p{L}[\\p{L}.]*\\.$", "^\\p{L}([\\p{L}.]*\\p{L})?[,;:]?$"
_MARK = "\u0001\u0000\u0001"


def scored(rows: DataFrame, text: str = "text") -> DataFrame:
    """(type, dotted, plain, score) of all types that are seen before a period."""
    token = rows.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\\s+")).alias("t")).where("t <> ''")
    dotted, plain = F.col("t").rlike(DOTTED), F.col("t").rlike(PLAIN)
    kind = token.select(F.when(dotted, F.regexp_replace("t", "\\.$", "")).when(plain, F.regexp_replace("t", "[,;:]$", "")).alias("type"), dotted.alias("dot"))
    types = kind.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if("dot").alias("dotted"))
    # one row, from counts that are partial sums of tasks
    total = types.agg(F.sum("n").alias("all"), F.sum("dotted").alias("periods"))
    seen = types.where("type IS NOT NULL AND dotted > 0").crossJoin(F.broadcast(total))
    n, c, p = (F.col(x).cast("double") for x in ("n", "dotted", "periods"))
    share = F.least(F.lit(1 - 1e-12), p / F.col("all"))
    likelihood = lambda q: c * F.ln(q) + (n - c) * F.ln(1 - q)
    ratio = -2 * (likelihood(share) - likelihood(F.lit(SURE)))
    inner = (F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))).cast("double")
    letters = F.length("type") - inner + 1
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, c - n)
    return seen.select("type", "dotted", (F.col("n") - F.col("dotted")).alias("plain"), score.alias("score"))


def abbreviations(rows: DataFrame, text: str = "text", threshold: float = THRESHOLD, most: int = MOST) -> list[str]:
    """The types of the highest scores."""
    found = scored(rows, text).where(F.col("score") >= threshold).orderBy(F.desc("score"), "type").limit(most)
    return [r["type"] for r in found.collect()]


def split(text: Column, known: Sequence[str] = ()) -> Column:
    """Sentences; without abbreviations those of the plain rule."""
    pieces = sentences(F.replace(text, F.lit(_MARK), F.lit("")))
    if not known:
        return pieces

    def ended(piece: Column) -> Column:
        last = F.regexp_replace(F.regexp_extract(F.lower(piece), "\\S+\\z", 0), "\\.\\z", "")
        goes_on = F.endswith(piece, F.lit(".")) & last.isin(*known)
        return F.concat(piece, F.when(goes_on, F.lit(" ")).otherwise(F.lit(_MARK)))

    joined = F.array_join(F.transform(pieces, ended), "")
    return F.filter(F.transform(F.split(joined, _MARK), lambda s: F.trim(s)), lambda s: s != "")
