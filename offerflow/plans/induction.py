"""Templates of whole sites: which paths hold price, title and picture on the pages of a site.

A few seed pages of each site are analysed and vote. The stored templates and the winner are tried on all
pages; only what none of them fits is analysed itself, and the templates found there are tried on these pages
in turn, those that most pages have first. Sites are a column, so that all of them go at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..operators.analysis import analyse
from ..sources.tables import cut, large

SEEDS, SPARE = 16, 5
TEMPLATE = "site string, rank long, template map<string,string>, votes long, source string"


def template_key(template: str = "template") -> Column:
    """Equal for templates with the same path of each tag, in any order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(template))))


def seed_pages(pages: DataFrame, size: int = SEEDS, spare: int = SPARE, order: Column | None = None) -> DataFrame:
    """``size`` pages of each site, the first by a hash of their id or by ``order``; of a site with fewer than ``spare`` more the last ones.

    ``pages(page_id, site)``. Tasks keep their first pages of a site before they meet.
    """
    by = Window.partitionBy("site")
    ranked = lambda by_what, name: pages.select("page_id", "site", F.row_number().over(by.orderBy(*by_what)).alias(name)).filter(F.col(name) <= size)
    few = pages.groupBy("site").agg(F.count("*").alias("n")).select("site", (F.col("n") < size + spare).alias("few"))
    at_random = ranked([order if order is not None else F.xxhash64("page_id"), "page_id"], "place").join(few.filter("not few"), "site")
    last = ranked([F.desc("page_id")], "place").join(few.filter("few"), "site")
    return at_random.unionByName(last).select("page_id", "site")


def vote_by_site(found: DataFrame) -> DataFrame:
    """``site, place, template, votes``: the distinct templates of a site, that of most pages first, then that of the first page. ``found(page_id, site, template)``"""
    counted = found.withColumn("_key", template_key()).groupBy("site", "_key").agg(F.count("*").alias("votes"), F.min("page_id").alias("first"), F.min_by("template", "page_id").alias("template"))
    return counted.select("site", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("votes"), "first")).alias("place"), "template", "votes")


def tag_paths(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'tag'").select("page_id", "path").join(large(pages.select("page_id", "site")), "page_id").distinct()


def resolving(paths: DataFrame, templates: DataFrame) -> DataFrame:
    """``page_id, site, rank``: of the templates of its site all of whose paths a page has, the first by ``rank``.

    ``paths(page_id, site, path)``. A template meets the pages that have the path of it that is the rarest in the site, and
    is then held against all their paths, so that a path that all pages have brings nothing together.
    """
    steps = cut(templates.select("site", "rank", F.explode(F.array_distinct(F.map_values("template"))).alias("path")))
    present = cut(paths.join(steps.select("site", "path").distinct(), ["site", "path"], "left_semi"))
    spread = present.groupBy("site", "path").agg(F.count("*").alias("n"))
    rarest = steps.join(spread, ["site", "path"], "left").groupBy("site", "rank").agg(F.min_by("path", F.struct(F.coalesce("n", F.lit(0)), "path")).alias("path"), F.count("*").alias("size"))
    candidates = present.join(rarest, ["site", "path"]).select("page_id", "site", "rank", "size")
    met = candidates.join(steps, ["site", "rank"]).join(large(present), ["site", "page_id", "path"]).groupBy("page_id", "site", "rank").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return met.filter("n = size").groupBy("page_id", "site").agg(F.min("rank").alias("rank"))


def texts_at(nodes: DataFrame, chosen: DataFrame, templates: DataFrame) -> DataFrame:
    """``page_id, info``: what a page says at the paths of its template, by tag; of a picture its address. ``chosen(page_id, site, rank)``; ``nodes`` of ``html_nodes(texts=False)``."""
    steps = chosen.join(templates.select("site", "rank", F.explode("template").alias("tag", "path")), ["site", "rank"]).select("page_id", "tag", "path")
    tags = nodes.filter("kind = 'tag'").select("page_id", "path", "name", "attrs", "said_from", "said_to", "ord")
    whole = nodes.filter("said is not null").select("page_id", "said")
    met = steps.join(large(tags), ["page_id", "path"]).join(large(whole), "page_id")
    picture = F.coalesce(F.col("attrs")["src"], F.col("attrs")["lazysrc"])
    said = F.when(F.col("name") == "img", picture).otherwise(F.substring(F.col("said"), F.col("said_from") + 1, F.col("said_to") - F.col("said_from")))
    first = met.withColumn("said", said).groupBy("page_id", "tag").agg(F.min_by("said", "ord").alias("said"))
    return first.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "said")))).alias("info"))


@dataclass
class Induced:
    """``results(page_id, site, rank, source, error, info)`` of every page; ``templates`` that serve a page, to be stored; ``counters`` of the run."""

    results: DataFrame
    templates: DataFrame
    counters: dict[str, int]


def induce(pages: DataFrame, nodes: DataFrame, stored: DataFrame, configs: DataFrame, keywords: DataFrame, pictures: DataFrame, off: str, sign: str, seeds: int = SEEDS, order: Column | None = None) -> Induced:
    """Templates for ``pages(page_id, site)``, whose ``nodes`` are those of ``html_nodes(texts=False)``.

    ``stored(site, ord, template)`` are tried first, in their order, then the winner of the seed pages, then what the pages that
    none of them fits gave by analysis. A page's ``source`` tells which of the three; a page that no template fits has the
    ``error`` of its own analysis. A stored template without paths fits nothing. Counters are gathered in the pass that writes the results.
    """
    nodes, pages = cut(nodes), cut(pages.select("page_id", "site").dropDuplicates(["page_id"]))
    study = lambda some: analyse(some, configs, keywords, pictures, nodes.join(large(some.select("page_id")), "page_id", "left_semi"), off, sign)
    good = lambda found: found.filter("error is null").select("page_id", F.col("paths").alias("template")).join(large(pages), "page_id")
    known = stored.filter(F.size("template") > 0).select("site", F.row_number().over(Window.partitionBy("site").orderBy("ord")).cast("long").alias("rank"), "template", F.lit(None).cast("long").alias("votes"), F.lit("stored").alias("source"))
    winners = vote_by_site(good(study(cut(seed_pages(pages, seeds, order=order))))).filter("place = 1")
    new = winners.withColumn("_key", template_key()).join(known.select("site", template_key().alias("_key")), ["site", "_key"], "left_anti")
    most = known.groupBy("site").agg(F.max("rank").alias("most"))
    after = new.join(most, "site", "left").select("site", (F.coalesce("most", F.lit(0)) + 1).alias("rank"), "template", "votes", F.lit("probe").alias("source"))
    tried = cut(known.unionByName(after))

    paths = cut(tag_paths(nodes, pages))
    fitted = cut(resolving(paths, tried))
    rest = cut(pages.join(large(fitted), "page_id", "left_anti"))
    own = cut(study(rest))
    last = tried.groupBy("site").agg(F.max("rank").alias("most"))
    found = vote_by_site(good(own)).join(last, "site", "left").select("site", (F.coalesce("most", F.lit(0)) + F.col("place")).alias("rank"), "template", "votes", F.lit("page").alias("source"))
    found = cut(found)
    more = resolving(paths.join(large(rest.select("page_id")), "page_id", "left_semi"), found)

    every = tried.unionByName(found)
    chosen = cut(fitted.unionByName(more))
    errors = own.select("page_id", "error")
    said = texts_at(nodes, chosen, every)
    met = pages.join(large(chosen.select("page_id", "rank")), "page_id", "left").join(every.select("site", "rank", "source"), ["site", "rank"], "left")
    met = met.join(large(errors), "page_id", "left").join(large(said), "page_id", "left")
    results = met.select("page_id", "site", "rank", "source", F.when(F.col("rank").isNull(), F.col("error")).alias("error"), "info")
    seen = Observation()
    counted = results.observe(seen, F.count(F.lit(1)).alias("pages"), F.count("rank").alias("resolved"), *[F.count_if(F.col("source") == s).alias(s) for s in ("stored", "probe", "page")], F.count("error").alias("failed"))
    results = cut(counted)
    used = every.join(results.filter("rank is not null").groupBy("site", "rank").agg(F.count("*").alias("pages")), ["site", "rank"])
    return Induced(results, used, {k: int(v) for k, v in seen.get.items()})
