"""Functions for SQL texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lexforge.operators.chunking import SPACES, packed
from lexforge.plans.tables import ship

CHUNKS = "lexforge_chunks"
_ENDS = re.compile(f"(?<=[.!?])[{re.escape(SPACES)}]+")


@udtf(returnType="ord int, first_sentence int, past_sentence int, chunk string")
class Chunks:
    """``lexforge_chunks(text, max_chars, overlap)``: a row for each chunk of whole sentences, as ``chunking.pack`` cuts them."""

    def eval(self, text: str, max_chars: int, overlap: int) -> Iterator[tuple]:
        found = [s for s in _ENDS.split((text or "").strip(SPACES)) if s]
        for ord_, cut in enumerate(packed([len(s) for s in found], max_chars, overlap)):
            yield ord_, cut["b"], cut["e"], " ".join(found[cut["b"] : cut["e"]])


def register(spark: SparkSession) -> None:
    """Make them known to a session."""
    ship(spark)
    spark.udtf.register(CHUNKS, Chunks)
