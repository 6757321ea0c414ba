"""13. Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of all hashes is kept.

The sketch of a text is a function of its set of shingles alone, so that the sketch of a union is the union of the sketches, and a
small document's share in a large one can be told without the texts. Built-in functions only.

Words are parted by the six blanks and lower-cased; a text of fewer words than a shingle has one shingle, its word sequence; one
without words has none. A fingerprint lists the kept hashes, ascending, in 16 hexadecimal digits each; a text that keeps none has
"=" and the hash of its word sequence instead, and is like (1.0) only what has the same. Rows: a null text is the empty one; null
ids come first in the order of documents, equal ids follow the digests of their texts, of repeated rows all but the last are
followed by an equal one; an only document is followed by itself; an empty table gives an empty table; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.text import texts
from lexforge.plans.tables import materialize

#: Words of a shingle; one hash in so many is kept.
SHINGLE, FRACTION = 5, 4
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Rows that a repeated document's result is copied into in one step.
COPIES = 1000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")


def sketch(text: Column, shingle: int = SHINGLE, fraction: int = FRACTION) -> Column:
    """The kept hashes, ascending and distinct: of 64-bit hashes as signed numbers those in the lowest ``fraction``-th."""
    limit = F.lit(-(1 << 63) + (1 << 64) // fraction)

    def hashes(w: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
        return F.when(F.size(w) >= shingle, several).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))

    # the words are bound to a name, so that they are made once and not for each shingle
    every = F.get(F.transform(F.array(words(text)), hashes), F.lit(0))
    return F.sort_array(F.array_distinct(F.filter(every, lambda h: h < limit)))


def fingerprint(kept: Column, whole: Column) -> Column:
    """A sketch as text; ``whole``, the hash of all words, stands for a sketch that keeps nothing."""

    def digits(h: Column) -> Column:
        return F.lower(F.lpad(F.hex(h), 16, "0"))

    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, digits), "")).otherwise(F.concat(F.lit("="), digits(whole)))


def merged(one: Column, other: Column) -> Column:
    """The sketch of both texts' shingles together."""
    return F.sort_array(F.array_union(one, other))


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets; null where neither sketch keeps anything."""
    both = F.size(F.array_intersect(one, other))
    return F.try_divide(both.cast("double"), (F.size(one) + F.size(other) - both).cast("double"))


def containment(one: Column, other: Column) -> Column:
    """Estimated share of the first one's shingles that the other has; null where the first keeps nothing."""
    return F.try_divide(F.size(F.array_intersect(one, other)).cast("double"), F.size(one).cast("double"))


def followers(keyed: DataFrame) -> DataFrame:
    """(key, n, quarter, next) of each distinct (key, doc_id, text): how many rows have it, a fourth of its characters, and the key
    of the document after it. Keys alone are sorted by ranges; ranges are tied together by their first keys."""
    counted = keyed.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.first(F.length("text")).alias("size"))
    ranged = counted.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    numbered = materialize(ranged.select("key", "n", (F.col("size") / 4).cast("long").alias("quarter"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    # as many rows as there were partitions
    first = numbered.groupBy("part").agg(F.min_by("key", "at").alias("first"))
    order = Window.orderBy("part")
    around = first.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = F.lead("key").over(Window.partitionBy("part").orderBy("at"))
    return numbered.withColumn("inside", inside).join(F.broadcast(around), "part").select("key", "n", "quarter", F.coalesce("inside", "after").alias("next"))


def edited_and_next(docs: DataFrame, shingle: int = SHINGLE, fraction: int = FRACTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text (the last quarter of its characters replaced by the first as many, or
    all, of the next document's), and how like it is to both; ``in_edited`` and ``in_next`` are the contained shares.

    Texts are shuffled once; what a document's predecessor needs (its beginning and sketch) is sent to where that lies. Repeated
    rows are one until their result is copied."""
    rows = texts(docs, id_col, text_col)
    keyed = rows.select(F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.col("text").cast("binary"))).cast("binary"))).alias("key"), "doc_id", "text")
    order = materialize(followers(keyed))
    once = keyed.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    sent = once.join(order.select(F.col("next").alias("key"), F.col("key").alias("to"), "n", "quarter"), "key")
    sent = sent.select(F.col("to").alias("key"), "n", "quarter", F.col("doc_id").alias("next_doc_id"), F.substring("text", F.lit(1), F.col("quarter").cast("int")).alias("start"), sketch(F.col("text"), shingle, fraction).alias("next"), F.xxhash64(words(F.col("text"))).alias("next_words"))
    met = once.join(sent, "key").withColumn("own", sketch(F.col("text"), shingle, fraction)).withColumn("own_words", F.xxhash64(words(F.col("text"))))
    begins = F.substring("text", F.lit(1), F.col("quarter").cast("int"))
    last = F.struct(F.lit(1).cast("long").alias("rows"), "next_doc_id", "start", "next", "next_words")
    repeats = F.struct((F.col("n") - 1).alias("rows"), F.col("doc_id").alias("next_doc_id"), begins.alias("start"), F.col("own").alias("next"), F.col("own_words").alias("next_words"))
    cases = met.select("doc_id", "text", "quarter", "own", "own_words", F.explode(F.filter(F.array(last, repeats), lambda c: c["rows"] > 0)).alias("c"))
    changed = cases.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.length("text") - F.col("quarter")).cast("int")), F.col("c.start")))
    both = changed.withColumn("new", sketch(F.col("edited"), shingle, fraction)).withColumn("new_words", F.xxhash64(words(F.col("edited"))))

    def near(measure: Column, other_words: str) -> Column:
        return F.coalesce(measure, (F.col("own_words") == F.col(other_words)).cast("double"))

    after = both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own"), F.col("own_words")).alias("fingerprint"), fingerprint(F.col("new"), F.col("new_words")).alias("edited_fingerprint"),
        near(likeness(F.col("own"), F.col("new")), "new_words").alias("near_edited"), near(likeness(F.col("own"), F.col("c.next")), "c.next_words").alias("near_next"),
        near(containment(F.col("own"), F.col("new")), "new_words").alias("in_edited"), near(containment(F.col("own"), F.col("c.next")), "c.next_words").alias("in_next"),
        F.col("c.next_doc_id").alias("next_doc_id"), F.col("c.rows").alias("rows"),
    )
    for step in (COPIES, 1):
        after = after.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / step)))).withColumn("rows", F.least(F.col("rows") - F.col("part") * step, F.lit(step)))
    return after.drop("part", "rows")
