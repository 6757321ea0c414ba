"""The default embedder: hashed term weights under a signed projection, so that any text has a vector and needs no model.

A token's md5 names a component and a sign; a text's component is the signed sum of 1 + ln(tf) of its distinct tokens there, and the
vector has length one (a text without tokens has none but zeros). Texts that share words share components; words that collide cancel
out as often as they add up, so inner products are unbiased estimates of those of the whole term vectors.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.operators.dedup import tokens
from lexforge.operators.retrieval import normalised

DIMS = 384
#: Tokens whose places a worker remembers.
KNOWN = 300_000


def place(term: Column, dims: int = DIMS) -> tuple[Column, Column]:
    """Component and sign of a token, from the first eight digits of its md5."""
    h = F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long")
    return (h % dims).cast("int"), F.when(F.floor(h / dims) % 2 == 0, 1.0).otherwise(-1.0)


def embedded(rows: DataFrame, key: str, text: str, dims: int = DIMS) -> DataFrame:
    """(key, v) of every row; keys are distinct and not null. A row's tokens become its vector in the task that has read them, and
    nothing is shuffled."""
    words = rows.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    schema = T.StructType([words.schema[key], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}

        def placed(term: str) -> tuple[int, float]:
            h = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
            if len(known) >= KNOWN:
                known.clear()
            known[term] = found = (h % dims, 1.0 if h // dims % 2 == 0 else -1.0)
            return found

        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                v = np.zeros((batch.num_rows, dims))
                for r, terms in enumerate(batch.column(1)):
                    counts = Counter(terms.as_py())
                    if counts:
                        places = [known.get(t) or placed(t) for t in counts]
                        weights = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
                        v[r] = np.bincount([i for i, _ in places], weights * [sign for _, sign in places], minlength=dims)
                length = np.sqrt((v * v).sum(axis=1))
                v /= np.where(length == 0, 1.0, length)[:, None]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * dims, v.reshape(-1))], names=[key, "v"])

    return words.mapInArrow(embed, schema)


def of_text(text: Column, dims: int = DIMS) -> Column:
    """The same as an expression, for short texts such as queries: it walks over all components for each distinct token."""
    words = tokens(F.coalesce(text, F.lit("")))

    def add(v: Column, term: Column) -> Column:
        i, sign = place(term["t"], dims)
        return F.transform(v, lambda x, at: F.when(at == i, x + sign * (1 + F.ln(term["tf"].cast("double")))).otherwise(x))

    counts = F.transform(F.array_distinct(words), lambda t: F.struct(t.alias("t"), F.size(F.filter(words, lambda w: w == t)).alias("tf")))
    return normalised(F.aggregate(counts, F.array_repeat(F.lit(0.0), dims), add))
