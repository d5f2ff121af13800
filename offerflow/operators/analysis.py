"""Analysis of offer pages: the region that keywords name, its prices, and the title, items sold and picture around them.

All steps are joins and groups over node rows (``sources.markup.html_nodes``), keyed by ``page_id``; without the texts of tags
(``texts=False``) what a page says is stored once, and a tag's text is cut from it where it is tested. A text has the
path of the tag around it. Keywords are rows ``config, ord, attribute, keywords`` as ``feeds.keyword_map`` reads them, a few
for each kind of site. They and the configurations come from the driver and are broadcast: Spark knows no size of such a
table, and would send the pages to all tasks instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.price import is_product_image
from ..functions.text import drop_parents, first_number, is_blank, join_url
from ..sources.tables import cut, large
from .induce import looks_like_title, price_candidates, price_triples, without_ancestors

PRICE_KEYS = ("currency", "original", "saved", "discount")
#: Of these a price table names at least two; a text is the first that fits.
TABLE_KEYS = ("discount", "original", "saved")
#: A longer tag ends the search for the number of items sold.
LONGEST_AROUND = 500


def _inside(path: str, top: str) -> Column:
    return F.concat(path, F.lit("/")).startswith(F.concat(top, F.lit("/")))


def _up_to(path: str, n) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), F.lit(1), n), "/")


def around(nodes: DataFrame) -> DataFrame:
    """``top, depth`` beside the columns of text nodes: each tag around them, by its path."""
    steps = F.explode(F.sequence(F.lit(2), F.size(F.split("path", "/"))))
    return nodes.filter(F.size(F.split("path", "/")) > 1).withColumn("depth", steps).withColumn("top", _up_to("path", F.col("depth")))


def regions(nodes: DataFrame, keywords: DataFrame, of: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """``page_id, config, ord, path``: the smallest tags that hold a keyword of every attribute of a configuration.

    ``of(page_id, config)`` names what to try on which page. A text that matches the first attribute's keywords
    starts a climb, at whose first tag all other attributes have been met, somewhere else than at the start of a
    tag's text; of nested finds the inner ones stay. ``within(page_id, config, path)`` limits the climb to the
    inside of tags. A configuration of one attribute finds the tag around the text.
    """
    place = F.row_number().over(Window.partitionBy("config").orderBy("ord"))
    placed = keywords.withColumn("place", place)
    first = placed.filter("place = 1").select("config", F.explode("keywords").alias("word"))
    others = placed.filter("place > 1").select("config", "attribute", "keywords")
    seeds = nodes.filter("kind <> 'tag'").select("page_id", F.col("ord").alias("seed"), "path", "text")
    # A text meets the keywords of the configurations that its page tries, no others.
    seeds = seeds.join(large(of.select("page_id", "config").distinct()), "page_id").join(F.broadcast(first), "config").filter(F.regexp_like("text", F.col("word"))).select("page_id", "config", "seed", "path").distinct()
    climbs = around(seeds)
    if within is not None:
        limits = within.select("page_id", "config", F.col("path").alias("limit"))
        climbs = climbs.join(large(limits), ["page_id", "config"]).filter(_inside("top", "limit")).drop("limit")
    tags = nodes.filter("kind = 'tag'").select("page_id", F.col("path").alias("top"), "text", "said_from", "said_to", F.col("ord").alias("at"))
    whole = nodes.filter("said is not null").select("page_id", "said")
    part = F.substring(F.col("said"), F.col("said_from") + 1, F.col("said_to") - F.col("said_from"))
    met = climbs.join(large(tags), ["page_id", "top"]).join(large(whole), "page_id", "left").withColumn("text", F.coalesce("text", part)).drop("said").join(F.broadcast(others), "config", "left")
    hit = F.col("attribute").isNull() | F.exists("keywords", lambda w: F.instr(F.col("text"), w) > 1)
    deepest = met.select("page_id", "config", "seed", "path", "attribute", F.when(hit, F.col("depth")).alias("depth")).groupBy("page_id", "config", "seed", "path", "attribute").agg(F.max("depth").alias("depth"))
    found = deepest.groupBy("page_id", "config", "seed", "path").agg(F.min("depth").alias("depth"), F.count_if(F.col("depth").isNull()).alias("missing")).filter("missing = 0")
    found = found.select("page_id", "config", _up_to("path", F.col("depth")).alias("path")).distinct()
    inner = without_ancestors(found, ["page_id", "config"])
    return inner.join(large(tags.select("page_id", F.col("top").alias("path"), F.col("at").alias("ord"))), ["page_id", "path"]).select("page_id", "config", "ord", "path")


def price_table(texts: DataFrame) -> DataFrame:
    """``page_id, attribute, number, ord`` from the texts of a table that names its prices.

    ``texts(page_id, ord, text, discount_words, original_words, saved_words)``. Names in a row with numbers in
    another belong together by place, an unknown name taking one; where a number comes right after the first name,
    each number belongs to the name before it. Pages that do not name two prices are left out.
    """
    named = F.coalesce(*[F.when(F.exists(f"{a}_words", lambda w: F.instr(F.col("text"), w) > 0), F.lit(a)) for a in TABLE_KEYS])
    rows = texts.filter(~is_blank(F.col("text"))).withColumn("named", named).withColumn("number", F.when(F.col("named").isNull(), first_number(F.col("text"))))
    so_far = Window.partitionBy("page_id").orderBy("ord")
    rows = rows.withColumn("names", F.count("named").over(so_far)).filter("names > 0")
    cell = F.struct("ord", "named", "number")
    ordered = lambda keep: F.array_sort(F.collect_list(F.when(keep, cell)))
    is_name, is_number = F.col("named").isNotNull(), F.col("number").isNotNull()
    tables = rows.groupBy("page_id").agg(F.count("named").alias("names"), ordered(~is_number).alias("tags"), ordered(is_number).alias("numbers"), ordered(is_name | is_number).alias("cells")).filter("names > 1")
    pair = lambda t, n: F.struct(t["named"].alias("attribute"), n["number"].alias("number"), n["ord"].alias("ord"))
    by_place = F.zip_with("tags", "numbers", pair)
    by_turn = F.zip_with(F.expr("slice(cells, 1, size(cells) - 1)"), F.expr("slice(cells, 2, size(cells))"), pair)
    pairs = tables.select("page_id", F.explode(F.when(F.col("cells")[1]["number"].isNull(), by_place).otherwise(by_turn)).alias("p")).select("page_id", "p.*")
    last = pairs.filter("attribute is not null and number is not null").groupBy("page_id", "attribute").agg(F.max_by(F.struct("number", "ord"), "ord").alias("last"))
    return last.select("page_id", "attribute", "last.number", "last.ord")


def prices(texts: DataFrame, off: str) -> DataFrame:
    """``page_id, attribute, number, ord``: by the algebra of a discount, else by a table. ``texts`` also have ``currency_words``."""
    currency = F.exists(F.coalesce("currency_words", F.array().cast("array<string>")), lambda w: F.instr(F.col("text"), w) > 0)
    triples = price_triples(price_candidates(texts, currency, off)).filter("kinds is not null")
    kinds = F.split("kinds", ",")
    cells = F.array(*[F.struct(kind.alias("attribute"), F.col(n).alias("number"), F.col(f"{n}_ord").alias("ord")) for kind, n in ((kinds[0], "first"), (kinds[1], "second"), (F.lit("discount"), "discount"))])
    found = triples.select("page_id", F.explode(cells).alias("c")).select("page_id", "c.*")
    return found.unionByName(price_table(texts).join(large(triples.select("page_id")), "page_id", "left_anti"))


def items_sold(nodes: DataFrame, titles: DataFrame, words: DataFrame) -> DataFrame:
    """``page_id, ord, text``: the text with the number sold, near a keyword that lies around the title.

    ``titles(page_id, ord)`` are title texts, ``words(page_id, place, word)`` the keywords. From the tag around the title upwards,
    the first tag with a keyword decides, and in it the first keyword's first text, unless a tag of more than 500
    characters comes before; the number is in that text or the last one before it that is not blank.
    """
    at = nodes.join(large(titles.select("page_id", "ord")), ["page_id", "ord"]).select("page_id", "path")
    ups = around(at).drop("path")
    tags = nodes.filter("kind = 'tag'").select("page_id", F.col("path").alias("top"), (F.col("said_to") - F.col("said_from")).alias("size"))
    ups = ups.join(large(tags), ["page_id", "top"])
    ups = ups.withColumn("long", F.max(F.when(F.col("size") > LONGEST_AROUND, F.col("depth"))).over(Window.partitionBy("page_id")))
    texts = nodes.filter("kind <> 'tag'").select("page_id", "ord", "path", "text")
    keys = texts.join(large(words), "page_id").filter(F.instr(F.col("text"), F.col("word")) > 0).select("page_id", "ord", "path", "place")
    near = keys.join(large(ups), "page_id").filter(_inside("path", "top"))
    near = near.groupBy("page_id").agg(F.min(F.struct((-F.col("depth")).alias("up"), "place", "ord")).alias("key"), F.max("long").alias("long"))
    near = near.filter("long is null or -key.up >= long").select("page_id", F.col("key.ord").alias("ord"))
    before = Window.partitionBy("page_id").orderBy("ord")
    said = texts.filter(~is_blank(F.col("text"))).withColumn("here", F.struct("ord", "text")).withColumn("before", F.lag("here").over(before))
    has = lambda c: F.when(F.col(f"{c}.text").rlike(r"\d+"), F.col(c))
    found = said.join(large(near), ["page_id", "ord"]).select("page_id", F.coalesce(has("here"), has("before")).alias("found")).filter("found is not null")
    return found.select("page_id", "found.ord", "found.text")


def product_picture(nodes: DataFrame, anchors: DataFrame, sites: DataFrame, pictures: DataFrame) -> DataFrame:
    """``page_id, ord, url``: of product pictures that share a tag with the anchor, the first of those that share the innermost.

    ``anchors(page_id, ord)`` are texts, ``sites(page_id, site)`` hosts and ``pictures(url, size, width, height, kind)`` what is known of pictures.
    """
    source = F.coalesce(F.col("attrs")["src"], F.col("attrs")["lazysrc"])
    images = nodes.filter("kind = 'tag' and name = 'img'").select("page_id", "ord", "path", source.alias("src")).filter("src <> ''").join(large(sites), "page_id")
    images = images.withColumn("url", join_url(F.concat(F.lit("http://"), F.col("site")), drop_parents(F.col("src"))))
    product = is_product_image(F.col("size"), F.col("width"), F.col("height"), F.col("kind"))
    images = images.join(large(pictures.filter(product).select("url").distinct()), "url")
    ups = around(nodes.join(large(anchors.select("page_id", "ord")), ["page_id", "ord"]).select("page_id", "path")).drop("path")
    shared = images.join(large(ups), "page_id").filter(_inside("path", "top"))
    best = shared.groupBy("page_id").agg(F.min(F.struct((-F.col("depth")).alias("up"), "ord", "url")).alias("best"))
    return best.select("page_id", "best.ord", "best.url")


def analyse(pages: DataFrame, configs: DataFrame, keywords: DataFrame, pictures: DataFrame, nodes: DataFrame, off: str, sign: str) -> DataFrame:
    """``page_id, config, error, info, paths`` of every page: prices, title, items sold and picture, up to the first error.

    ``pages(page_id, site)``; of ``configs(ord, config, pattern)`` the first that fits the site and has a region on the
    page counts. ``off`` is the sign of a discount, ``sign`` what a title holds. Items sold may be missing. Errors:
    ``region``, ``prices``, ``original``, ``current``, ``title``, ``picture``; null is none. A page without markup has no region.
    """
    nodes = cut(nodes)
    sites = pages.select("page_id", "site")
    fits = sites.join(F.broadcast(configs), F.regexp_like("site", F.col("pattern"))).select("page_id", "config", F.col("ord").alias("config_ord"))
    outer = regions(nodes, keywords, fits).join(large(fits), ["page_id", "config"])
    outer = outer.groupBy("page_id").agg(F.min_by(F.struct("config", "path"), F.struct("config_ord", "ord")).alias("r")).select("page_id", "r.config", "r.path")
    outer = cut(outer)
    inner = regions(nodes, keywords.filter(F.col("attribute").isin(*PRICE_KEYS)), outer, outer)
    inner = inner.groupBy("page_id", "config").agg(F.min_by("path", "ord").alias("region"))
    words = keywords.groupBy("config").agg(*[F.max(F.when(F.col("attribute") == a, F.col("keywords"))).alias(f"{a}_words") for a in PRICE_KEYS])
    texts = nodes.filter("kind <> 'tag'").join(large(inner), "page_id").filter(_inside("path", "region")).join(F.broadcast(words), "config")
    cells = cut(prices(texts, off))
    original = F.max(F.when(F.col("attribute") == "original", F.col("ord")))
    wide = cells.groupBy("page_id").agg(original.alias("anchor"), F.bool_or(F.col("attribute").isin("saved", "discount", "price")).alias("current"))
    anchors = wide.filter("current and anchor is not null").select("page_id", F.col("anchor").alias("ord"))
    likely = nodes.filter((F.col("kind") != "tag") & looks_like_title(F.col("text"), sign)).select("page_id", F.col("ord").alias("title_ord"), "text")
    titled = likely.join(large(anchors), "page_id").filter("title_ord < ord").groupBy("page_id").agg(F.max(F.struct("title_ord", "text")).alias("t"))
    titled = titled.select("page_id", F.col("t.title_ord").alias("ord"), "t.text")
    sold = outer.join(F.broadcast(keywords.filter("attribute = 'items'")), "config").select("page_id", F.posexplode("keywords").alias("place", "word"))
    items = items_sold(nodes, titled, sold)
    picture = product_picture(nodes, anchors.join(large(titled.select("page_id")), "page_id", "left_semi"), sites, pictures)

    parts = [cells.select("page_id", "attribute", F.col("number").cast("string").alias("said"), "ord")]
    parts += [df.select("page_id", F.lit(name).alias("attribute"), F.col(column).alias("said"), "ord") for df, name, column in ((titled, "title", "text"), (items, "items", "text"), (picture, "image", "url"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    every = every.join(large(nodes.select("page_id", "ord", "path")), ["page_id", "ord"]).dropDuplicates(["page_id", "attribute"])
    maps = every.groupBy("page_id").agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", c)))).alias(n) for c, n in (("said", "info"), ("path", "paths"))])
    all_of = sites.select("page_id").join(large(outer.select("page_id", "config")), "page_id", "left").join(large(wide.select("page_id", "anchor", "current")), "page_id", "left").join(large(maps), "page_id", "left")
    has = lambda name: F.map_contains_key("info", F.lit(name))
    error = F.when(F.col("config").isNull(), "region").when(F.col("info").isNull(), "prices").when(F.col("anchor").isNull(), "original").when(~F.col("current"), "current")
    return all_of.select("page_id", "config", error.when(~has("title"), "title").when(~has("image"), "picture").alias("error"), "info", "paths")
