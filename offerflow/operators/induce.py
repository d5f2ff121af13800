"""Wrapper induction: which paths of a page hold price, title and picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.price import classify_prices
from ..functions.text import first_number, is_blank, number_or_zero, trim_title_prefix
from ..sources.tables import large

TAGS = ("url", "city", "title", "image", "original", "price", "discount", "saved", "items", "shop", "address", "details")
LONGEST_PRICE, LEAST_TITLE = 15, 15


def vote(templates: DataFrame) -> DataFrame:
    """The template (``map``) that most pages have; ties go to the earliest. ``templates(ord, template)``"""
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("template"))))
    counted = templates.withColumn("key", key).groupBy("key").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(1)


def stored_template(row: DataFrame) -> DataFrame:
    """Stored tag columns as a map, empty ones left out."""
    present = [c for c in TAGS if c in row.columns]
    pairs = F.map_from_arrays(F.array(*map(F.lit, present)), F.array(*[F.col(c).cast("string") for c in present]))
    return row.select(F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != "")).alias("template"))


def apply_template(nodes: DataFrame, template: dict[str, str]) -> DataFrame:
    """``page_id`` and the text at each path, of pages on which all paths resolve. ``nodes`` are node rows with ``path``."""
    paths = {p: t for t, p in template.items()}
    tag = F.create_map(*[F.lit(x) for p, t in paths.items() for x in (p, t)])[F.col("path")]
    found = nodes.filter(F.col("path").isin(*paths) & (F.col("kind") == "tag")).groupBy("page_id", tag.alias("tag")).agg(F.min_by("text", "ord").alias("text")).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "text"))).alias("info"))
    return found.filter(F.size("info") == len(paths)).select("page_id", *[F.col("info")[t].alias(t) for t in template])


def price_candidates(nodes: DataFrame, currency: str | Column, off: str) -> DataFrame:
    """Short text nodes with a number: discount candidates below 10 without the currency, price candidates without the sign of a discount.

    ``currency`` is a mark, or a condition on ``text`` that holds where there is one.
    """
    marked = currency if isinstance(currency, Column) else F.col("text").contains(currency)
    number = first_number(F.col("text"))
    short = nodes.filter((F.col("kind") == "text") & (F.char_length("text") <= LONGEST_PRICE)).withColumn("number", number).filter("number is not null")
    small = (F.col("number") < 10) & (F.char_length(F.regexp_extract("text", r"\d+(\.\d+)?", 0)) <= 4) & ~marked
    return short.select("page_id", "ord", "number", small.alias("as_discount"), (~F.col("text").contains(off) & ~small).alias("as_price"))


def price_triples(candidates: DataFrame) -> DataFrame:
    """Of pages with one discount and two prices: what the prices are."""
    one = candidates.groupBy("page_id").agg(
        F.count_if("as_discount").alias("discounts"), F.count_if("as_price").alias("prices"),
        F.max(F.when(F.col("as_discount"), F.col("number"))).alias("discount"), F.max(F.when(F.col("as_discount"), F.col("ord"))).alias("discount_ord"),
        F.min(F.when(F.col("as_price"), F.col("ord"))).alias("first_ord"), F.max(F.when(F.col("as_price"), F.col("ord"))).alias("second_ord"),
        F.min_by("number", F.when(F.col("as_price"), F.col("ord"))).alias("first"), F.max_by("number", F.when(F.col("as_price"), F.col("ord"))).alias("second"),
    )
    return one.filter("discounts = 1 and prices = 2").select("page_id", "first", "second", "discount", "first_ord", "second_ord", "discount_ord", classify_prices(F.col("first"), F.col("second"), F.col("discount")).alias("kinds"))


def without_ancestors(candidates: DataFrame, keys: list[str] = ["page_id"]) -> DataFrame:
    """Candidate tags (``keys`` and ``path``) none of whose descendants is a candidate too."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ancestors = candidates.filter(F.size(parts) > 2).select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode(above).alias("_path")).distinct()
    same = F.col("path") == F.col("_path")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return candidates.join(large(ancestors), same, "left_anti")


def looks_like_title(text: Column, currency: str) -> Column:
    return ~is_blank(text) & (F.char_length(text) >= LEAST_TITLE) & text.contains(currency)


def title_before(nodes: DataFrame, anchors: DataFrame, currency: str) -> DataFrame:
    """The last title-like text before each page's anchor. ``anchors(page_id, anchor)``"""
    texts = nodes.filter((F.col("kind") == "text") & looks_like_title(F.col("text"), currency))
    return texts.join(anchors, "page_id").filter(F.col("ord") < F.col("anchor")).groupBy("page_id").agg(F.max_by("text", "ord").alias("title"))


def choose_config(sites: DataFrame, configs: DataFrame) -> DataFrame:
    """``site, config``: of ``configs(ord, config, pattern, region)``, which are broadcast, the first whose pattern is found in a site (``site, region``); a null region fits all."""
    fits = F.regexp_like("site", F.col("pattern")) & (F.col("_region").isNull() | (F.col("region") == F.col("_region")))
    return sites.join(F.broadcast(configs.withColumnRenamed("region", "_region")), fits).groupBy("site").agg(F.min_by("config", "ord").alias("config"))


def apply_first(nodes: DataFrame, templates: list[dict[str, str]]) -> DataFrame:
    """``page_id, template, info``: the first of the templates all of whose paths resolve on a page, and the texts there by tag; pages that none fits are left out."""
    paths = sorted({p for t in templates for p in t.values()})
    found = nodes.filter(F.col("path").isin(*paths) & (F.col("kind") == "tag")).groupBy("page_id", "path").agg(F.min_by("text", "ord").alias("text")).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("at"))
    number = info = None
    for k, t in enumerate(templates):
        fits = F.forall(F.array(*map(F.lit, t.values())), lambda p: F.map_contains_key("at", p))
        texts = F.create_map(*[x for tag, p in t.items() for x in (F.lit(tag), F.col("at")[p])])
        number = F.when(fits, k) if number is None else number.when(fits, k)
        info = F.when(fits, texts) if info is None else info.when(fits, texts)
    return found.select("page_id", number.alias("template"), info.alias("info")).filter("template is not null")


def normalise(records: DataFrame, prefix: str, city: str) -> DataFrame:
    """Numbers from the texts of prices and items, titles without a trivial prefix, and a default city."""
    numbers = [c for c in ("original", "price", "discount", "saved", "items") if c in records.columns]
    rows = records.withColumns({c: number_or_zero(F.coalesce(c, F.lit(""))) for c in numbers})
    return rows.withColumns({"title": trim_title_prefix(F.col("title"), prefix), "city": F.coalesce("city", F.lit(city))})
