"""Sentences, chunks, segments and context windows as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the chunker and of what is worth a vector.
CHUNK_CHARS, OVERLAP, MIN_CHUNK, MAX_CHUNK, SLICE, SEGMENT = 600, 1, 50, 1500, 8000, 1000
CONTEXT, WORD_EDGE = 250, 30
#: What a pattern takes for white space.
SPACES = " \t\n\x0b\f\r"


def sentences(text: Column) -> Column:
    """Split after . ! ? and white space; stripped, without empty ones. Only a text's own ends can leave white space."""
    return F.filter(F.split(F.btrim(text, F.lit(SPACES)), "(?<=[.!?])\\s+"), lambda s: s != "")


def pack(sentence_list: Column, max_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> Column:
    """Chunks as arrays of sentence places. A chunk is closed before a sentence that would bring its sentences over
    ``max_chars`` (blanks between them don't count); the next begins with its last ``overlap`` sentences, which do count.

    The lengths alone go to the fold, one step for each sentence, in Arrow batches; texts stay where they are and are joined
    afterwards, once for each chunk."""

    @F.pandas_udf("array<struct<b: int, e: int>>")
    def fold(lists: pd.Series) -> pd.Series:
        return pd.Series([packed(x.tolist(), max_chars, overlap) if x is not None else None for x in lists], dtype=object)

    return fold(F.transform(sentence_list, F.length))


def packed(lengths: list[int], max_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> list[dict[str, int]]:
    """Chunks of sentences of these lengths."""
    cuts, begin, size = [], 0, 0
    for i, n in enumerate(lengths):
        if size + n > max_chars and i > begin:
            cuts.append({"b": begin, "e": i})
            begin = max(begin, i - overlap)
            size = sum(lengths[begin:i])
        size += n
    if lengths:
        cuts.append({"b": begin, "e": len(lengths)})
    return cuts


def chunk_texts(sentence_list: Column, places: Column) -> Column:
    return F.transform(places, lambda p: F.array_join(F.slice(sentence_list, p["b"] + 1, p["e"] - p["b"]), " "))


def slices(text: Column, width: int = SLICE) -> Column:
    """Fixed-width pieces; none of an empty text."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / width).cast("int")), lambda i: F.substr(text, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def word_segments(text: Column, width: int = SEGMENT) -> Column:
    """Whole words, closed once their lengths, with a blank each, reach ``width``: numbers of words of each segment."""
    words = F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")

    def step(acc: Column, w: Column) -> Column:
        size = acc["size"] + F.length(w) + 1
        full = size >= width
        return F.struct(F.when(full, 0).otherwise(acc["n"] + 1).alias("n"), F.when(full, 0).otherwise(size).alias("size"), F.when(full, F.concat(acc["out"], F.array(acc["n"] + 1))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.expr("cast(array() as array<int>)").alias("out")), step)
    return F.when(done["n"] > 0, F.concat(done["out"], F.array(done["n"]))).otherwise(done["out"])


def worth_a_vector(chunk: Column) -> Column:
    return F.length(chunk).between(MIN_CHUNK, MAX_CHUNK)


def context_window(text: Column, start: Column, end: Column, reach: int = CONTEXT, edge: int = WORD_EDGE) -> Column:
    """What surrounds [start, end) by ``reach`` characters, cut back to a word where a blank is within ``edge`` characters of
    the cut. Cuts at the text's own ends stay."""
    lo, hi = F.greatest(start - reach, F.lit(0)), F.least(end + reach, F.length(text))
    piece = F.substr(text, lo + 1, hi - lo)
    first = F.locate(" ", piece) - 1
    head = F.when((lo > 0) & (first >= 0) & (first < edge), F.substr(piece, first + 2)).otherwise(piece)
    last = F.locate(" ", F.reverse(head)) - 1
    tail = F.when((hi < F.length(text)) & (last >= 0) & (last < edge), F.substr(head, F.lit(1), F.length(head) - last - 1)).otherwise(head)
    return F.trim(tail)
