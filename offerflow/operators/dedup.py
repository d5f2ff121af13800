"""Deduplication, batches and caps that depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_cities(offers: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each group, its city being all cities of the group in order; one that is part of the text so far is left out.

    Only the first row for each city of a group enters the fold, so a group
    gathers as many items as there are cities, not rows.
    """
    by_city = offers.groupBy(*keys, "city").agg(F.min(order).alias("first"), F.min_by(F.struct(*offers.columns), order).alias("row"))
    fold = lambda acc, x: F.when(acc.isNull(), x["city"]).when(acc.contains(x["city"]), acc).otherwise(F.concat(acc, F.lit(","), x["city"]))
    cities = F.aggregate(F.sort_array(F.collect_list(F.struct("first", "city"))), F.lit(None).cast("string"), fold)
    grouped = by_city.groupBy(*keys).agg(F.min_by("row", "first").alias("row"), cities.alias("cities"))
    return grouped.select(*[F.col("cities").alias("city") if c == "city" else F.col(f"row.{c}").alias(c) for c in offers.columns])


def fold_onto(store: DataFrame, offers: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The same fold where a store has some groups already: its rows come first and take the cities that they lack.

    Both have the same columns; an empty city is none.
    """
    both = store.withColumn("_late", F.lit(0)).unionByName(offers.withColumn("_late", F.lit(1)))
    both = both.withColumns({"city": F.nullif("city", F.lit("")), "_at": F.struct("_late", order)})
    return fold_cities(both, keys, "_at").drop("_late", "_at")


def cap_new_rows(rows: DataFrame, flag: str, partition: str, order: str, most: int = 50) -> DataFrame:
    """Old rows (flagged) all stay; of the new ones of each partition the first ``most``."""
    turn = F.row_number().over(Window.partitionBy(partition).orderBy(order))
    new = rows.filter(~F.col(flag)).withColumn("_turn", turn).filter(F.col("_turn") <= most).drop("_turn")
    return rows.filter(F.col(flag)).unionByName(new)


def mark_attempts(rows: DataFrame, eligible: Column, partition: str, order: str, most: int = 10) -> DataFrame:
    """``attempt``: whether a row is among the first ``most`` eligible ones of its partition."""
    chosen = rows.withColumn("_can", eligible)
    turn = F.row_number().over(Window.partitionBy(partition, "_can").orderBy(order))
    return chosen.withColumn("attempt", F.col("_can") & (turn <= most)).drop("_can")


def flagged_first(rows: DataFrame, flag: str, order: str) -> DataFrame:
    return rows.orderBy(F.desc(flag), order)


def batch_urls(cities: DataFrame, base: str, param: str, size: int = 11, keys: list[str] = []) -> DataFrame:
    """One address for each ``size`` cities: ``base?param`` with the city for ``%s``, joined by ``&``. ``cities(pos, cityid)``, numbered from 0, for each of ``keys``."""
    piece = F.replace(F.lit(param), F.lit("%s"), F.col("cityid"))
    grouped = cities.groupBy(*keys, F.floor(F.col("pos") / size).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("pieces"))
    return grouped.select(*keys, "batch", F.concat(F.lit(base + "?"), F.array_join("pieces.piece", "&")).alias("url"))


def fill_rates(df: DataFrame) -> DataFrame:
    """``property, filled``: rows with a value that is neither null nor empty, for each column."""
    counts = df.agg(*[F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in df.columns])
    return counts.unpivot([], counts.columns, "property", "filled")


def cities_of(offers: DataFrame, cities: DataFrame) -> DataFrame:
    """``cityid`` by the name of the city; several names are ``multi``; an unknown one is null."""
    named = cities.select(F.trim("name").alias("_name"), F.col("cityid").alias("_cityid"))
    met = offers.drop("cityid").join(named, F.col("city") == F.col("_name"), "left")
    return met.withColumn("cityid", F.when(F.col("city").contains(","), "multi").otherwise(F.col("_cityid"))).drop("_name", "_cityid")


#: Names and texts meet by this many characters at most.
GRAM = 3


def names_within(rows: DataFrame, names: DataFrame, key: str, text: str, name: str = "name") -> DataFrame:
    """``key`` and the columns of ``names`` for each name that the text of a row holds; an empty name is in none.

    A name is filed under its first three characters (a shorter one under itself), and a text under each run of one to three of its
    characters, so that the two meet in an equal join, whichever of them is large; what met is then held against the whole name.
    """
    starts = F.sequence(F.lit(1), F.char_length(text))
    runs = F.flatten(F.transform(F.filter(starts, lambda p: F.char_length(text) > 0), lambda p: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring(text, p, n))))
    filed = names.filter(F.char_length(name) > 0).withColumn("_gram", F.substring(name, 1, GRAM))
    met = rows.select(key, text, F.explode(F.array_distinct(runs)).alias("_gram")).join(filed, "_gram")
    return met.filter(F.col(text).contains(F.col(name))).select(key, *names.columns)


def city_of_link(links: DataFrame, cities: DataFrame, key: str, text: str) -> DataFrame:
    """``key, city``: the first part of a link's text that is a city; else the smallest city that the text holds."""
    parts = links.select(key, F.posexplode(F.split(text, "/")).alias("pos", "part")).filter(F.char_length("part") >= 2)
    names = cities.select(F.trim("name").alias("name"), "cityid")
    whole = parts.join(names, F.col("part") == F.col("name")).groupBy(key).agg(F.min_by("name", "pos").alias("city"))
    rest = links.filter(F.exists(F.split(text, "/"), lambda p: F.char_length(p) >= 3)).join(whole, key, "left_anti")
    held = names_within(rest, names, key, text).groupBy(key).agg(F.min_by("name", "cityid").alias("city"))
    return whole.unionByName(held)


def known_cities(tokens: DataFrame, cities: DataFrame, key: str) -> DataFrame:
    """``key, pos, cityid``: the tokens (``key, pos, token``) that are city ids, numbered anew in their order; repeated ones stay."""
    ids = cities.select("cityid").distinct()
    held = tokens.join(ids, F.col("token") == F.col("cityid"), "left_semi")
    turn = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    return held.select(key, turn.alias("pos"), F.col("token").alias("cityid"))
