"""What the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.plans.tables import ship

#: The code points that part words.
SPACES = " \t\n\x0b\x0c\r"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row; a null text is the empty one. Other columns play no part, whatever their names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: What a worker keeps between batches and gives up at the end of a task.
AT_END: list[Callable[[], None]] = []


def release() -> None:
    """Give a worker's free memory back; workers stay for the tasks of other stages."""
    for forget in AT_END:
        forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, rows: int = 512) -> DataFrame:
    """``mapInArrow`` with one table of columns for each ``rows`` rows; ``make`` runs once in a task, before its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(each(batch.slice(at, rows)))
            del batch
        del each
        release()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def words_of(text: str) -> list[bytes]:
    """The words of a text with A-Z lower-cased, as UTF-8; bytes.split() parts at exactly the six code points above."""
    return text.encode().lower().split()
