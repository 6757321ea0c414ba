"""Grouped and conditional aggregation, buckets, shares and ratios over the data model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def n_where(condition: Column) -> Column:
    """Rows for which a condition holds; null counts as no."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def percent(part: Column, whole: Column) -> Column:
    """Rounded to a hundredth, then times 100; 0 for an empty whole."""
    return F.coalesce(F.round(part / F.nullif(whole, F.lit(0)), 2) * 100, F.lit(0.0)).cast("double")


def share(part: Column, whole: Column) -> Column:
    """Unrounded percentage; 0 for an empty whole."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)) * 100, F.lit(0.0)).cast("double")


def ladder(value: Column, steps: Sequence[tuple[Column, str]], rest: str) -> Column:
    """First step whose condition holds; a null value falls through to ``rest``."""
    out = F.lit(None)
    for condition, name in reversed(steps):
        out = F.when(condition, F.lit(name)).otherwise(out if out is not None else F.lit(rest))
    return F.coalesce(out, F.lit(rest))


def at_least(value: Column, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    """Buckets by lower bounds, descending."""
    return ladder(value, [(value >= c, n) for c, n in cuts], rest)


def below(value: Column, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    """Buckets by upper bounds, ascending."""
    return ladder(value, [(value < c, n) for c, n in cuts], rest)


def funnel_totals(content: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """All stage counts in one pass over the content, one row."""
    c = F.col
    return content.agg(
        F.count(F.lit(1)).alias("total"),
        n_where(c("extraction_status") == "completed").alias("extracted"),
        n_where(c("extraction_status") == "failed").alias("extraction_failed"),
        n_where(c("extraction_status") == "pending").alias("extraction_pending"),
        n_where((c("extraction_status") == "completed") & (c("screening_status") == "dq_rejected")).alias("dq_rejected"),
        n_where((c("extraction_status") == "completed") & (c("screening_status") == "approved")).alias("approved"),
        n_where((c("extraction_status") == "completed") & (c("screening_status") == "rejected")).alias("llm_rejected"),
        n_where((c("extraction_status") == "completed") & (c("screening_status") == "approved") & (c("vectorization_status") == "completed")).alias("vectorized"),
        n_where(c("signal_processed")).alias("signal_processed"),
    )


def funnel_rates(totals: DataFrame) -> DataFrame:
    c = F.col
    passed = totals.withColumn("dq_passed", c("extracted") - c("dq_rejected"))
    return passed.select(
        "dq_passed",
        percent(c("extracted"), c("total")).alias("extraction_rate"),
        percent(c("dq_passed"), c("extracted")).alias("dq_pass_rate"),
        percent(c("approved"), c("dq_passed")).alias("acceptance_rate"),
        share(c("dq_rejected"), c("extracted")).alias("dq_rejected_share"),
        share(c("llm_rejected"), c("dq_passed")).alias("llm_rejected_share"),
    )


def funnel(totals: DataFrame) -> DataFrame:
    """The five stages in order."""
    steps = totals.withColumn("dq_passed", F.col("extracted") - F.col("dq_rejected"))
    return steps.select(F.expr("stack(5, 1, 'Downloaded', total, 2, 'Extracted', extracted, 3, 'DQ passed', dq_passed, 4, 'Approved', approved, 5, 'Vectorized', vectorized) as (ord, stage, n)"))


def flow_links(totals: DataFrame) -> DataFrame:
    """Where documents go between stages, with the share of all; an empty corpus counts as one."""
    steps = totals.withColumn("dq_passed", F.col("extracted") - F.col("dq_rejected"))
    links = steps.select("total", F.expr("""stack(7, 'Downloaded', 'Extracted', extracted, 'keep', 'Downloaded', 'Extraction failed', extraction_failed, 'drop',
        'Downloaded', 'Extraction pending', extraction_pending, 'wait', 'Extracted', 'DQ passed', dq_passed, 'keep', 'Extracted', 'DQ rejected', dq_rejected, 'drop',
        'DQ passed', 'Approved', approved, 'keep', 'DQ passed', 'LLM rejected', llm_rejected, 'drop') as (source, target, value, kind)"""))
    return links.select("source", "target", "value", "kind", (F.col("value") / F.greatest("total", F.lit(1)) * 100).alias("share"))


def by_format(content: DataFrame, *keys: str) -> DataFrame:
    """Conditional counts of each group."""
    c = F.col
    return content.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        n_where(c("screening_status") == "approved").alias("approved"),
        n_where(c("screening_status") == "rejected").alias("llm_rejected"),
        n_where(c("screening_status") == "dq_rejected").alias("dq_rejected"),
        n_where(c("extraction_status") == "failed").alias("extraction_failed"),
        F.round(F.avg("file_size_mb"), 6).alias("avg_size"),
    )


def top(df: DataFrame, keys: Sequence[str], n: int, by: str = "n", *more: Column) -> DataFrame:
    """The ``n`` largest groups; ties by their keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *more).orderBy(F.desc(by), *keys).limit(n)


def with_total_share(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Each row's percentage of the column's sum. For grouped results: the window is one task's."""
    return df.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy()) * 100)


def running_total(df: DataFrame, order: str, value: str, name: str = "running") -> DataFrame:
    """Cumulative sum by ``order``, for grouped results (one row a day)."""
    return df.withColumn(name, F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def cooccurrence(rows: DataFrame, item: str, basket: str, limit: int) -> DataFrame:
    """Pairs of items in a basket, multiplicities kept: rows are counted by (basket, item) before the self-join, whose
    pairs weigh the product of their counts. So a basket that repeats an item a thousand times joins one row."""
    counted = rows.where(F.col(item).isNotNull()).groupBy(F.col(basket).alias("b"), F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("m"))
    left = counted.select("b", F.col("item").alias("entity_a"), F.col("m").alias("ma"))
    right = counted.select("b", F.col("item").alias("entity_b"), F.col("m").alias("mb"))
    pairs = left.join(right, "b").where("entity_a < entity_b").groupBy("entity_a", "entity_b").agg(F.sum(F.col("ma") * F.col("mb")).alias("n"))
    return pairs.orderBy(F.desc("n"), "entity_a", "entity_b").limit(limit)


def tag_counts(rows: DataFrame, tags: Column, n: int) -> DataFrame:
    """(name, n) of the ``n`` most frequent tags of a column of JSON arrays; what is no JSON has no tags."""
    exploded = rows.select(F.explode(F.from_json(tags, "array<string>")).alias("name"))
    return top(exploded, ["name"], n)
