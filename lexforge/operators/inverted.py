"""A written inverted index for BM25: queries read posting blocks, never the corpus, and skip blocks that cannot matter.

A posting is a document and its impact on a term, all of a BM25 part but the inverse document frequency. A term's postings lie in
levels of impact, and a level in blocks of a bounded size, by the documents' hashes, each with its largest impact. A block can be
skipped for a query if its largest part and the largest parts of all other terms together do not reach a score that k documents
are known to have, or if its term is a weak one and none of the candidates lies in it. What reaches that score has all of its
postings in the blocks that are left, so what is read of it adds up to its whole score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.operators.retrieval import EPSILON, K1, TERMS, B, few, ranked, terms
from lexforge.plans.tables import materialize

#: Postings of a block, levels of impact, and parts of the index by terms: few queries read few of them.
BLOCK, LEVELS, PARTS = 512, 16, 64
#: Terms of a query whose best blocks give a first bound of its scores.
SCOUTS = 4
#: What names a block.
KEYS = ["part", "term", "level", "sub"]

SCHEMAS = {
    "blocks": "term string, level int, sub int, posts array<struct<doc_id: long, impact: double>>, top double, blocks int, part int",
    "heads": "term string, level int, sub int, top double, blocks int, size int, part int",
    "stats": "docs long, avgdl double, mean_idf double",
}


def _sub(blocks: Column) -> Column:
    """The block of its level that a document's posting lies in."""
    return F.pmod(F.xxhash64("doc_id"), blocks).cast("int")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(d, len(ts), t, c) for d, ts in zip(batch["doc_id"], batch["ts"], strict=True) for t, c in Counter(ts).items()]
        yield pd.DataFrame(rows, columns=["doc_id", "n", "term", "tf"])


class Index:
    """An index in ``folder``. Document ids are distinct; a null text has no terms."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def build(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> Index:
        """Write the index. The corpus is read twice, for its mean length and for its postings, which are shuffled once to their
        blocks; a term that all documents have is as many blocks."""
        lists = docs.select(F.col(id_col).cast("long").alias("doc_id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("ts"))
        n, length = lists.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("ts")), F.lit(0.0))).first()
        counted = lists.mapInPandas(_counted, "doc_id long, n long, term string, tf long")
        impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(max(length, 1e-9))))
        level = F.least(F.lit(LEVELS - 1), F.floor(impact / (k1 + 1) * LEVELS)).cast("int")
        posts = materialize(counted.select("term", "doc_id", impact.alias("impact"), level.alias("level")))
        wide = posts.groupBy("term", "level").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        # most levels of most terms are one block; only the others have to be looked up
        crowded = few(materialize(wide.where("blocks > 1")), TERMS)
        cut = posts.join(crowded, ["term", "level"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("sub", _sub(F.col("blocks")))
        part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int").alias("part")
        grouped = cut.groupBy("term", "level", "sub").agg(F.collect_list(F.struct("doc_id", "impact")).alias("posts"), F.max("impact").alias("top"), F.max("blocks").alias("blocks"))
        grouped.select("*", part).repartition("part", F.pmod(F.xxhash64("term", "sub"), F.lit(8))).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/blocks")
        heads = self._read("blocks").select(*KEYS, "top", "blocks", F.size("posts").alias("size"))
        heads.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/heads")
        frequency = self._read("heads").groupBy("term").agg(F.sum("size").alias("df"))
        idf = F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
        frequency.agg(F.lit(n).cast("long").alias("docs"), F.lit(length).alias("avgdl"), F.coalesce(F.avg(idf), F.lit(0.0)).alias("mean_idf")).write.mode("overwrite").parquet(f"{self.folder}/stats")
        return self

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def _asked(self, queries: DataFrame, k: int, epsilon: float) -> tuple[DataFrame, DataFrame, list[int]]:
        """Of each (qid, term): its weight, the most that it gives, the most that all terms up to it give (the weakest first), and the
        query's bound; the heads of these terms' blocks; the parts of the index that they lie in."""
        n, mean = self._read("stats").select("docs", "mean_idf").first()
        part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int").alias("part")
        wanted = materialize(queries.select("qid", F.explode(terms(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times")).select("*", part))
        parts = [r["part"] for r in wanted.select("part").distinct().collect()]
        heads = materialize(self._read("heads").where(F.col("part").isin(parts)).join(few(wanted.select("term").distinct(), TERMS), "term", "left_semi"))
        idf = F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
        by_term = heads.groupBy("term").agg(F.sum("size").alias("df"), F.max("top").alias("most"))
        weights = by_term.select("term", "most", F.when(idf < 0, epsilon * F.lit(mean)).otherwise(idf).alias("idf"))
        asked = wanted.join(few(weights, TERMS), "term").select("qid", "term", "most", (F.col("idf") * F.col("times")).alias("weight"))
        # a negative weight only lowers a score: at most it gives nothing
        asked = asked.withColumn("gives", F.greatest(F.lit(0.0), F.col("weight") * F.col("most")))
        weakest = Window.partitionBy("qid").orderBy("gives", "term")
        asked = asked.withColumn("upto", F.sum("gives").over(weakest)).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("gives"), "term")))
        asked = materialize(asked.withColumn("all", F.sum("gives").over(Window.partitionBy("qid"))).withColumn("least", F.min("weight").over(Window.partitionBy("qid"))))
        # what documents are known to have, from the best levels of some terms, down to k postings of each; it is a bound only
        # where no other term takes from it
        scouts = asked.where(f"place <= {SCOUTS} AND least >= 0").select("qid", "term", "weight")
        above = Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
        levels = heads.groupBy("term", "level").agg(F.sum("size").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        best = heads.join(few(materialize(levels.where(F.col("above") < k).select("term", "level")), TERMS), ["term", "level"]).select(*KEYS).join(few(scouts, TERMS), "term")
        known = ranked(self._parts_of(best, parts).where("score > 0"), k)
        bound = known.where(F.col("rank") == k - 1).select("qid", (F.col("score") - 1e-6).alias("bound"))
        return asked.join(few(materialize(bound), TERMS), "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0))), heads, parts

    def _parts_of(self, asked: DataFrame, parts: list[int], only: DataFrame | None = None) -> DataFrame:
        """(qid, doc_id, score): what the blocks (qid, weight, KEYS) that are asked for give to each document, or to those of ``only``."""
        asked = materialize(asked.select("qid", "weight", *KEYS))
        read = self._read("blocks").where(F.col("part").isin(parts)).select(*KEYS, "posts").join(few(asked.select(KEYS).distinct(), TERMS), KEYS, "left_semi")
        found = read.join(few(asked, TERMS), KEYS).select("qid", "weight", F.inline("posts"))
        if only is not None:
            found = found.join(few(only, TERMS), ["qid", "doc_id"], "left_semi")
        return found.groupBy("qid", "doc_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))

    def search(self, queries: DataFrame, k: int, epsilon: float = EPSILON) -> DataFrame:
        """(qid, doc_id, score, rank) as ``retrieval.bm25`` gives. The weakest terms of a query that even together do not reach its
        bound cannot bring up a document by themselves: candidates come from the others' blocks, and of the weak terms' only the
        blocks are read that candidates lie in. ``read`` has how many blocks were, and how many the terms have."""
        asked, heads, parts = self._asked(queries, k, epsilon)
        asked = materialize(asked.withColumn("weak", F.col("upto") < F.col("bound")))
        strong = heads.join(few(asked.where("not weak"), TERMS), "term")
        strong = materialize(strong.where(F.greatest(F.lit(0.0), F.col("weight") * F.col("top")) + F.col("all") - F.col("gives") >= F.col("bound")).select("qid", "weight", *KEYS))
        rest = asked.groupBy("qid").agg(F.coalesce(F.sum(F.when(F.col("weak"), F.col("gives"))), F.lit(0.0)).alias("rest"), F.max("bound").alias("bound"))
        first = self._parts_of(strong, parts).join(few(rest, TERMS), "qid")
        candidates = materialize(first.where("score + rest >= bound").select("qid", "doc_id", "score"))
        # a weak term's level is read whole where it has fewer blocks than the query has candidates
        levels = heads.groupBy("part", "term", "level").agg(F.max("blocks").alias("blocks"))
        sizes = candidates.groupBy("qid").agg(F.count(F.lit(1)).alias("candidates"))
        weak = materialize(asked.where("weak").select("qid", "term", "weight").join(few(sizes, TERMS), "qid").join(levels, "term"))
        whole = weak.where("candidates >= blocks").select("qid", "weight", "part", "term", "level", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("sub"))
        some = weak.where("candidates < blocks").join(candidates.select("qid", "doc_id"), "qid")
        some = some.select("qid", "weight", "part", "term", "level", _sub(F.col("blocks")).alias("sub")).distinct()
        others = materialize(whole.unionByName(some).select("qid", "weight", *KEYS))
        self.read = (strong.select(KEYS).union(others.select(KEYS)).distinct().join(heads, KEYS, "left_semi").count(), heads.count())
        more = self._parts_of(others, parts, candidates.select("qid", "doc_id"))
        total = candidates.unionByName(more).groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 9).alias("score"))
        return ranked(total.where("score > 0"), k)
