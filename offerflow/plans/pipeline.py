"""Declared pipelines: a list of stages, each from a DataFrame to a DataFrame, folded over the feed.

All sites run in one job: ``siteid`` is a column, not a loop.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import dedup, merge
from ..schemas import OFFERS, coerce
from ..sources import feeds, markup
from ..sources.tables import cut, large

Stage = Callable[..., DataFrame]
STAGES: dict[str, Stage] = {}


def stage(f: Stage) -> Stage:
    STAGES[f.__name__] = f
    return f


def need(df: DataFrame, *columns: str) -> None:
    if missing := set(columns) - set(df.columns):
        raise ValueError(f"the stage needs {sorted(missing)}")


@stage
def city_addresses(df, env, cityurl, url, param, batchquery="0", anchor="shenzhen", samples=("beijing", "shanghai", "shenzhen", "hangzhou")):
    """``siteid, batch, url``: the feeds of the cities that a site's page of cities lists, eleven at a time with ``batchquery`` 1, else one.

    ``cityurl`` may hold the site as ``%s``; ``pages(url, html)`` are the pages that could be read. A site whose page is missing, or names fewer than three of the samples, has no feeds.
    """
    need(df, "siteid")
    sites = df.select("siteid").distinct().withColumn("_page", F.replace(F.lit(cityurl), F.lit("%s"), F.col("siteid")))
    pages = sites.join(env["pages"], F.col("_page") == F.col("url")).select("siteid", "html")
    nodes = markup.html_nodes(pages, "siteid", wanted=markup.Wanted(text=re.escape(anchor)))
    listed = dedup.known_cities(markup.city_list(nodes, anchor, list(samples), key="siteid"), env["cities"], "siteid")
    return dedup.batch_urls(listed, url, param, 11 if str(batchquery) == "1" else 1, ["siteid"])


@stage
def read_feeds(df, env):
    """The records of the feeds at ``url``, with the site; ``feeds(url, xml)`` are those that could be read. ``ord`` numbers a site's records by address and place in the feed."""
    need(df, "siteid", "url")
    met = df.select("siteid", "url").join(env["feeds"], "url").select(F.struct("siteid", "url").alias("feed"), "xml")
    found = feeds.parse_feeds(met.withColumn("feed_id", F.to_json("feed")), "feed_id", "xml")
    of = F.from_json("feed_id", "siteid string, url string")
    place = F.row_number().over(Window.partitionBy("siteid").orderBy("_from", "item"))
    return found.withColumns({"siteid": of["siteid"], "_from": of["url"]}).withColumn("ord", place).drop("feed_id", "_from", "item")


@stage
def remove_duplicates(df, env):
    need(df, "siteid", "title", "city", "ord")
    return dedup.fold_cities(df, ["siteid", "title"])


@stage
def remove_tail(df, env, tail):
    need(df, "url")
    return df.withColumn("url", text.strip_suffix(F.col("url"), tail))


@stage
def reconcile(df, env):
    return merge.reconcile(df.withColumns({c: F.lit(None).cast("string") for c in ("address", "geoinfo") if c not in df.columns}), env["store"])


@stage
def enrich_from_pages(df, env, most=50, **fields):
    """New rows, at most ``most`` of a site, get the fields of their pages; rows whose page is missing go."""
    need(df, "url", "siteid", "db_flag", "ord")
    capped = dedup.cap_new_rows(df, "db_flag", "siteid", "ord", most)
    old, new = capped.filter("db_flag"), capped.filter("not db_flag")
    pages = new.select("url").distinct().join(env["pages"], "url")
    found = markup.extract_fields(pages, fields, "url")
    rows = new.join(pages.select("url"), "url", "left_semi").drop(*fields).join(found, "url", "left").withColumn("html_flag", F.lit(True))
    return rows.unionByName(old.withColumn("html_flag", F.lit(False)), allowMissingColumns=True)


def _in_markup(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """``_url, _address, _place`` found in a column of markup, by url."""
    nodes = markup.html_nodes(df.filter(F.col(column).isNotNull()).dropDuplicates(["url"]), "url", column, texts=False).select("url", "ord", "kind", "name", "attrs", "text")
    nodes = cut(nodes) if words else nodes
    address = markup.find_address(nodes, words, key="url") if words else nodes.select("url", F.lit(None).cast("string").alias("address")).limit(0)
    both = address.join(large(markup.map_markers(nodes, "url")), "url", "full")
    return both.select(F.col("url").alias("_url"), F.col("address").alias("_address"), F.col("geoinfo").alias("_place"))


@stage
def enrich_address(df, env, words=()):
    """Of rows whose page was read (``html_flag``; all rows without that column): shop and address without markup, city id,
    the address that ``addrdetails`` names by these words and its point, else that of ``mapimg``, and the grid cell of the first point."""
    need(df, "url", "city")
    blank = [c for c in ("address", "geoinfo", "geogrid", "cityid") if c not in df.columns]
    rows = df.withColumns({c: F.lit(None).cast("long" if c == "geogrid" else "string") for c in blank})
    old = rows.filter("not html_flag").drop("html_flag", "addrdetails", "mapimg") if "html_flag" in df.columns else None
    rows = rows.filter("html_flag").drop("html_flag") if old is not None else rows
    rows = dedup.cities_of(rows.drop("cityid"), env["cities"])
    rows = rows.withColumns({c: text.strip_tags(F.col(c)) for c in ("shop", "address") if c in rows.columns})
    if "addrdetails" in rows.columns:
        rows = rows.join(_in_markup(rows, "addrdetails", list(words)), F.col("url") == F.col("_url"), "left")
        rows = rows.withColumns({"address": F.coalesce("_address", "address"), "geoinfo": F.coalesce("_place", "geoinfo")}).drop("_url", "_address", "_place", "addrdetails")
    if "mapimg" in rows.columns:
        rows = rows.join(_in_markup(rows, "mapimg", []), F.col("url") == F.col("_url"), "left")
        rows = rows.withColumn("geoinfo", F.coalesce("geoinfo", "_place")).drop("_url", "_address", "_place", "mapimg")
    point = geo.parse_point(F.substring_index(F.coalesce(F.col("geoinfo"), F.lit("")), ";", 1))
    rows = rows.withColumn("geogrid", F.when(point.isNotNull(), geo.cell_id(point["lat"], point["lon"])).otherwise(F.col("geogrid")))
    return rows if old is None else rows.unionByName(old, allowMissingColumns=True)


@stage
def geocode(df, env, most=10):
    """Rows with an address and no place, at most ``most`` of a site, look it up in the gazetteer ``(address, geoinfo)``."""
    can = F.coalesce(F.col("geoinfo"), F.lit("")).eqNullSafe("") & (F.coalesce(F.col("address"), F.lit("")) != "")
    marked = dedup.mark_attempts(df, can, "siteid", "ord", most)
    places = env["gazetteer"].select(F.col("address").alias("_address"), F.col("geoinfo").alias("_found"))
    met = marked.join(places, F.col("attempt") & (F.col("address") == F.col("_address")), "left")
    value = F.when(F.col("attempt"), F.coalesce("_found", F.lit(geo.NOWHERE))).otherwise(F.col("geoinfo"))
    return met.withColumn("geoinfo", value).drop("_address", "_found", "attempt")


@stage
def merge_typed(df, env):
    """The new snapshot of the store."""
    fields = [f.name for f in OFFERS if f.name in df.columns]
    typed = coerce(df.select(*fields, "ord"), OFFERS)
    return merge.upsert(env["store"], merge.last_of_each(typed, "url", "ord"), "url")


def run(spec: list[tuple[str, dict]], feed: DataFrame, **env: DataFrame) -> DataFrame:
    unknown = [name for name, _ in spec if name not in STAGES]
    if unknown:
        raise ValueError(f"no stage {unknown}")
    return reduce(lambda df, s: STAGES[s[0]](df, env, **s[1]), spec, feed)


def run_sites(specs: dict[str, list[tuple[str, dict]]], feed: DataFrame, names: dict[str, str] | None = None, **env: DataFrame) -> DataFrame:
    """Every site by its own pipeline, as a configuration gives them (``sources.feeds.pipeline_spec``).

    ``*`` is the pipeline of the sites that have none of their own; without it their records are left out. ``names``
    tells which stage a configured module is. Sites with equal pipelines run together, and a table of the
    environment that has a ``siteid`` is that of these sites. Columns that only some results have are null in the others.
    """
    groups: dict[str, list[str]] = {}
    for site, spec in specs.items():
        if site != "*":
            groups.setdefault(repr(spec), []).append(site)
    parts = [(specs[sites[0]], F.col("siteid").isin(*sites)) for sites in groups.values()]
    if "*" in specs:
        parts.append((specs["*"], ~F.col("siteid").isin(*(s for s in specs if s != "*"))))
    found = []
    for spec, of in parts:
        mine = {k: t.filter(of) if "siteid" in t.columns else t for k, t in env.items()}
        found.append(run([((names or {}).get(m, m), p) for m, p in spec], feed.filter(of), **mine))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
