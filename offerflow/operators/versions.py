"""Versioned change sets: what a table of a site held as of a version.

A change is valid from its version to the next one of its key. Reading a version is a filter on that interval,
so that no version is stored as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(changes: DataFrame, key: str = "url", site: str = "siteid", version: str = "version", order: str = "ord") -> DataFrame:
    """``site, key, columns, valid_from, valid_to``: the rows that changes with ``op`` create, update or delete make.

    Changes of a site and key go by version, those of one version by ``order``; only the last of a version shows. What an update leaves null
    keeps its value since the key was created; what it updates without a creation begins there. What a deletion says besides counts for nothing. ``valid_to`` is null while a row is valid.
    """
    columns = [c for c in changes.columns if c not in (key, site, version, order, "op")]
    of = Window.partitionBy(site, key).orderBy(version, order)
    begins = F.col("op").isin("create", "delete").cast("int")
    rows = changes.withColumns({"_life": F.sum(begins).over(of), "valid_to": F.lead(version).over(of)})
    life = Window.partitionBy(site, key, "_life").orderBy(version, order)
    values = [F.last(F.when(F.col("op") != "delete", F.col(c)), ignorenulls=True).over(life).alias(c) for c in columns]
    kept = rows.select(site, key, "op", *values, F.col(version).alias("valid_from"), "valid_to")
    shown = F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))
    return kept.filter(shown & (F.col("op") != "delete")).select(site, key, *columns, "valid_from", "valid_to")


def as_of(rows: DataFrame, version, site: str | None = None) -> DataFrame:
    """The table as a version left it, of all sites or one. ``rows`` of ``history``."""
    valid = (F.col("valid_from") <= version) & (F.col("valid_to").isNull() | (F.col("valid_to") > version))
    found = rows.filter(valid if site is None else valid & (F.col("siteid") == site))
    return found.drop("valid_from", "valid_to")


def changed_since(rows: DataFrame, version, key: str = "url", site: str = "siteid") -> DataFrame:
    """``site, key, op``: what a copy of that version has to do to be up to date."""
    before = as_of(rows, version).select(site, key).withColumn("_old", F.lit(True))
    now = rows.filter(F.col("valid_to").isNull()).select(site, key, "valid_from")
    met = before.join(now, [site, key], "full")
    op = F.when(F.col("valid_from").isNull(), "delete").when(F.col("_old").isNull(), "create").when(F.col("valid_from") > version, "update")
    return met.select(site, key, op.alias("op")).filter("op is not null")
