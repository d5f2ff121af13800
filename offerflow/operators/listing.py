"""Listing queries: filters, orders, pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_newlines

_RESTRICTION = re.compile(r"^\s*(\w+)\s*(=|==|<=|>=|!=|<|>)?\s*$")
ORDERS = {"bought": "-bought", "discount": "discount", "price": "current", "newest": "-starttime"}
PAGE = 20


def condition(text: str, value: Any, short: bool = True) -> Column:
    """``"name op"`` and a value as a predicate; values of short strings lose line feeds as stored ones do."""
    match = _RESTRICTION.match(text)
    if not match:
        raise ValueError(f"no restriction: {text!r}")
    c, op = F.col(match[1]), match[2] or "="
    v = strip_newlines(F.lit(value)) if short and isinstance(value, str) else F.lit(value)
    return {"=": c == v, "==": c == v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v, "!=": c != v}[op]


def equal_to(df: DataFrame, **values: Any) -> DataFrame:
    """The conjunction of equalities; none: all rows."""
    for name, value in values.items():
        df = df.filter(condition(name, value))
    return df


def order_columns(orders: list[str]) -> list[Column]:
    """A leading minus is descending; null sorts lowest."""
    return [F.desc_nulls_last(o[1:]) if o.startswith("-") else F.asc_nulls_first(o) for o in orders]


@dataclass(frozen=True)
class OfferQuery:
    """A query over an entity table. The same ``"name op"`` given again replaces the former one."""

    key: str
    filters: dict = field(default_factory=dict)
    orders: tuple = ()

    def filter(self, restriction: str, value: Any) -> "OfferQuery":
        condition(restriction, value)
        return replace(self, filters=self.filters | {restriction: value})

    def order(self, *names: str) -> "OfferQuery":
        return replace(self, orders=self.orders + names)

    def plan(self, df: DataFrame) -> DataFrame:
        for restriction, value in self.filters.items():
            df = df.filter(condition(restriction, value))
        return df

    def fetch(self, df: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
        """A slice; the key breaks ties. Limit 0: all."""
        df = self.plan(df).orderBy(*order_columns([*self.orders, self.key]))
        df = df.offset(offset) if offset > 0 else df
        return df.limit(limit) if limit > 0 else df

    def get(self, df: DataFrame) -> DataFrame:
        return self.fetch(df, 1)

    def count(self, df: DataFrame) -> DataFrame:
        return self.plan(df).agg(F.count("*").alias("n"))

    def signature(self, table: str, version: int = 0) -> str:
        """A cache key: equal for equal questions, whatever the order of the filters."""
        return repr((table, version, sorted(self.filters.items()), self.orders))


def list_offers(offers: DataFrame, cityid: str, order: str, start: int = 0, to: int = 0) -> DataFrame:
    """A page of a city's offers. ``to`` is exclusive; where it does not exceed ``start`` a page has 20 rows."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {sorted(ORDERS)}")
    start = max(0, start)
    size = to - start if to > start else PAGE
    return OfferQuery("url").filter("cityid =", cityid).order(ORDERS[order]).fetch(offers, size, start)


def listing_text(offers: DataFrame) -> Column:
    """Six lines for a row."""
    return F.concat_ws("\n", "url", "title", F.date_format("starttime", "yyyy-MM-dd HH:mm:ss"), "city", F.col("bought").cast("string"), F.concat_ws(",", *[F.floor(F.col(c) * 100).cast("string") for c in ("original", "discount", "current")]))


def html_row(df: DataFrame, whitelist: list[str]) -> Column:
    """A table row of the whitelisted columns that ``df`` has; the address is a link."""
    shown = [c for c in whitelist if c in df.columns]
    cell = lambda c: F.concat(F.lit('<td><a href="'), F.col(c), F.lit('">'), F.col(c), F.lit("</a></td>")) if c == "url" else F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>"))
    return F.concat(F.lit("<tr>"), *map(cell, shown), F.lit("</tr>"))


def multi_get(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows in the order of ``keys(pos, key)``; null columns for keys that are missing."""
    found = keys.select(F.col("pos"), F.col("key").alias("_key")).join(df, F.col("_key") == F.col(key), "left")
    return found.orderBy("pos").select("pos", F.col("_key").alias("asked"), *df.columns)
