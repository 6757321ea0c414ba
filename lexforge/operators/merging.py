"""Keyed merges, migrations and incremental cursors over plain Parquet tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexforge.operators.ranking import rank_in_groups


def upsert(stored: DataFrame, incoming: DataFrame, key: str, hash_col: str, stamp: str, keep: Sequence[str] = (), on_change: Mapping[str, Column] | None = None) -> DataFrame:
    """The merged table with an ``action`` column: inserted, updated, skipped or kept (stored only).

    A row is skipped if the stored hash is the same and the stored stamp is not older. An update takes the incoming columns
    but those of ``keep``; a column of ``on_change`` gets its new value only if the hash has changed, else it stays. Of
    several incoming rows of a key the latest counts. One full outer join."""
    latest = incoming.groupBy(key).agg(F.max_by(F.struct(*[c for c in incoming.columns if c != key]), stamp).alias("n"))
    old = stored.select(F.col(key).alias("_k"), F.struct(*[c for c in stored.columns if c != key]).alias("o"))
    both = latest.join(old, F.col(key) == F.col("_k"), "full_outer")
    n, o = (lambda x: F.col(f"n.{x}")), (lambda x: F.col(f"o.{x}"))
    same = n(hash_col).eqNullSafe(o(hash_col))
    action = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "kept").when(same & (o(stamp).cast("string") >= n(stamp).cast("string")), "skipped").otherwise("updated")
    acted = both.withColumn("action", action)
    rules = dict(on_change or {})

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(key, "_k")
        mine = n(c) if c in incoming.columns else F.lit(None)
        if c in rules:
            mine = F.when(F.col("o").isNull(), mine).when(same, o(c)).otherwise(rules[c])
        elif c in keep:
            mine = F.when(F.col("o").isNull(), mine).otherwise(o(c))
        return F.when(F.col("action").isin("kept", "skipped"), o(c)).otherwise(mine)

    return acted.select(*[value(c).alias(c) for c in stored.columns], "action")


def merge_by_key(stored: DataFrame, incoming: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """The merged table with an ``action``: inserted, updated or kept (stored only). A row that is there takes all incoming
    columns but those of ``keep`` and those that do not come in; nothing is skipped. Incoming keys are distinct."""
    rest = [c for c in incoming.columns if c != key]
    news = incoming.select(F.col(key).alias("_k"), F.struct(*rest).alias("_n"))
    olds = stored.select(F.col(key).alias("_s"), F.struct(*[c for c in stored.columns if c != key]).alias("_o"))
    both = news.join(olds, F.col("_k") == F.col("_s"), "full_outer")
    new, old = F.col("_s").isNull(), F.col("_k").isNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce("_k", "_s")
        mine = F.col(f"_n.{c}") if c in rest else F.lit(None)
        stays = old if c in rest and c not in keep else ~new
        return F.when(stays, F.col(f"_o.{c}")).otherwise(mine)

    action = F.when(new, "inserted").when(old, "kept").otherwise("updated")
    return both.select(*[value(c).alias(c) for c in stored.columns], action.alias("action"))


def update_by_key(stored: DataFrame, changes: DataFrame, key: str, now: Column, fixed: Sequence[str] = ("created_at", "updated_at"), stamp: str = "updated_at") -> DataFrame:
    """Stored rows with the changed columns of their key: null means no change, columns of ``fixed`` never change, NUL
    characters go from texts, and rows that are changed get the time."""
    names = [c for c in changes.columns if c != key and c not in fixed and c in stored.columns]
    kinds = dict(stored.dtypes)
    clean = lambda c: F.replace(c, F.lit("\u0000"), F.lit("")) if kinds[c] == "string" else F.col(c)
    found = changes.select(F.col(key).alias("_k"), F.struct(*[clean(c).alias(c) for c in names]).alias("_n"))
    joined = stored.join(found, F.col(key) == F.col("_k"), "left")
    hit = F.col("_k").isNotNull()

    def value(c: str) -> Column:
        if c == stamp:
            return F.when(hit, now).otherwise(F.col(c))
        return F.coalesce(F.col(f"_n.{c}"), F.col(c)) if c in names else F.col(c)

    return joined.select(*[value(c).alias(c) for c in stored.columns])


def inserted(stored: DataFrame, incoming: DataFrame, key: str, id_col: str = "id", texts: Sequence[str] = ()) -> DataFrame:
    """Incoming rows whose key is not stored, without NUL characters in ``texts``, with gapless ids after the largest stored
    one, in the order of the key. Of several rows of a key the first of all columns' order comes in."""
    rest = [c for c in incoming.columns if c not in (key, id_col)]
    distinct = incoming.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    new = distinct.join(stored.select(key), key, "left_anti")
    for c in texts:
        new = new.withColumn(c, F.replace(c, F.lit("\u0000"), F.lit("")))
    start = stored.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    return numbered(new, start, key).select(id_col, key, *rest)


def last_writer(rows: DataFrame, keys: Sequence[str], stamp: Column) -> DataFrame:
    """The row of each key with the largest stamp, by partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), stamp).alias("r")).select(*keys, "r.*").select(rows.columns)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def migrate(rows: DataFrame, schema: StructType, renames: Mapping[str, str] | None = None, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Rename, then bring to a schema: missing columns get their default or null, the rest is cast; idempotent."""
    for old, new in (renames or {}).items():
        if old in rows.columns and new not in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    value = lambda f: F.col(f.name) if f.name in rows.columns else F.lit((defaults or {}).get(f.name))
    return rows.select([value(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def numbered(rows: DataFrame, start: int, key: str) -> DataFrame:
    """New ids after ``start``, gapless, without a window over all rows."""
    ranked = rank_in_groups(rows.withColumn("_all", F.lit(1)), "_all", F.col(key), rank="_rank")
    return ranked.withColumn("id", F.lit(start) + F.col("_rank") + 1).drop("_all", "_rank")


def page_after(rows: DataFrame, stamp: str, after: Column, size: int, tie: str | None = None, tie_after: Column | None = None) -> DataFrame:
    """The next ``size`` rows in the order of a stamp. By default rows that share the last page's stamp are skipped, as a
    strict bound on the stamp alone does; with a tiebreak column the cursor is the pair and loses nothing."""
    later = F.col(stamp) > after
    if tie:
        later = later | ((F.col(stamp) == after) & (F.col(tie) > tie_after))
    return rows.where(later).orderBy(stamp, *([tie] if tie else [])).limit(size)


def job_states(jobs: DataFrame, log: DataFrame, key: Sequence[str], attempts: int = 2) -> DataFrame:
    """(key, state) of all jobs from a log of (key, outcome): done or failed once it says so, given up after so many attempts that
    hung, else pending. A batch that is started again runs what is pending."""
    seen = log.groupBy(*key).agg(F.max(F.col("outcome") == "done").alias("_d"), F.max(F.col("outcome") == "failed").alias("_f"), F.count_if(F.col("outcome") == "hung").alias("_h"))
    state = F.when(F.col("_d"), "done").when(F.col("_f"), "failed").when(F.col("_h") >= attempts, "given up").otherwise("pending")
    return jobs.select(*key).distinct().join(seen, list(key), "left").select(*key, state.alias("state"))
