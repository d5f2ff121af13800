"""Keyed snapshots: differences, upserts, change logs.

Parquet tables have no merge statement, so each operator returns the new
snapshot (or the changes) as a DataFrame; ``streaming.feed`` writes the buckets that changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sides(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    s = source.select(*keys, F.struct(*[c for c in source.columns if c not in keys]).alias("s"))
    t = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("t"))
    return s.join(t, keys, "full_outer")


def _changed(columns: list[str]) -> Column:
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    return changed


def diff(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """``op`` of each key: created, updated, deleted or unchanged, with the columns of the new snapshot."""
    columns = [c for c in source.columns if c != key and c in target.columns]
    op = F.when(F.col("t").isNull(), "created").when(F.col("s").isNull(), "deleted").when(_changed(columns), "updated").otherwise("unchanged")
    return _sides(source, target, [key]).select(key, op.alias("op"), *[F.when(F.col("s").isNull(), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in columns])


def sync_counts(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    return diff(source, target, key).groupBy("op").agg(F.count("*").alias("n"))


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The new snapshot: what a change leaves null keeps its value; keys that the target lacks are added."""
    columns = [c for c in target.columns if c != key]
    fresh = lambda c: F.col(f"s.{c}") if c in changes.columns else F.lit(None)
    return _sides(changes, target, [key]).select(key, *[F.coalesce(fresh(c), F.col(f"t.{c}")).alias(c) for c in columns])


def last_of_each(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of one key folded in their order: of each column the last value that is not null."""
    value = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return changes.groupBy(key).agg(*[value(c).alias(c) for c in changes.columns if c not in (key, order)])


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is null stay."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def insert_missing(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return target.unionByName(rows.join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def fold_changes(log: DataFrame, base: DataFrame, key: str, order: str) -> DataFrame:
    """A change log with ``op`` create, update or delete as one change for each key.

    Updates of a created row fold into its creation; what is created and deleted
    is nothing. ``error`` names a step that its predecessor does not allow:
    creating what exists, or changing or deleting what does not.
    """
    known = base.select(F.col(key).alias("_known")).distinct()
    steps = log.join(known, F.col(key) == F.col("_known"), "left").withColumn("in_base", F.col("_known").isNotNull())
    last = F.lag("op").over(Window.partitionBy(key).orderBy(order))
    exists = F.when(last.isNull(), F.col("in_base")).otherwise(last != "delete")
    wrong = F.when((F.col("op") == "create") & exists, "exists").when((F.col("op") != "create") & ~exists, "missing")
    steps = steps.withColumn("error", wrong)
    folded = steps.groupBy(key).agg(
        F.bool_or("in_base").alias("in_base"),
        F.max_by("op", order).alias("last_op"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col(order))).alias("error"),
        F.count("*").alias("steps"),
    )
    gone = F.col("last_op") == "delete"
    op = F.when(gone & F.col("in_base"), "delete").when(gone, "none").when(F.col("in_base"), "update").otherwise("create")
    return folded.select(key, op.alias("op"), "error", "steps")


class ChangeError(ValueError):
    """Changes whose steps do not fit each other or what is stored."""


def checked(changes: DataFrame, key: str) -> DataFrame:
    """Folded changes, if none has an error; else the error names the first five."""
    wrong = changes.filter("error is not null").orderBy(key).select(key, "error").limit(5).collect()
    if wrong:
        raise ChangeError(", ".join(f"{r[0]}: {r[1]}" for r in wrong))
    return changes


def apply_changes(base: DataFrame, changes: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """The snapshot after folded changes; columns of a change that are null keep their value. A change with an ``error`` raises; if not strict, changes are applied as far as they go."""
    if strict:
        changes = checked(changes, key)
    deleted = changes.filter("op = 'delete'").select(key)
    put = changes.filter("op in ('create', 'update')").drop("op", "error", "steps")
    return upsert(base, put, key).join(deleted, key, "left_anti")


def reconcile(feed: DataFrame, store: DataFrame, site: str = "siteid", key: str = "url", order: str = "ord") -> DataFrame:
    """Feed rows with what the store knows of them: address and place, and whether it has them.

    A second feed row with one key counts as unknown: the first one took the match.
    """
    turn = F.row_number().over(Window.partitionBy(site, key).orderBy(order))
    known = store.select(F.col(site).alias("_site"), F.col(key).alias("_key"), F.col("address").alias("_address"), F.col("geoinfo").alias("_geoinfo"))
    rows = feed.drop("address", "geoinfo").withColumn("_turn", turn)
    met = rows.join(known, (F.col(site) == F.col("_site")) & (F.col(key) == F.col("_key")) & (F.col("_turn") == 1), "left")
    return met.select(*[c for c in rows.columns if c != "_turn"], F.col("_address").alias("address"), F.col("_geoinfo").alias("geoinfo"), F.col("_key").isNotNull().alias("db_flag"))


def vanished(feed: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that the feed no longer has."""
    return store.join(feed.select(*keys).distinct(), keys, "left_anti")
