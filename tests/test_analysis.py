"""Page analysis: regions, price tables, items sold, pictures, and the errors that stop it."""

import pytest
from pyspark.sql import functions as F

from offerflow.operators import analysis
from offerflow.sources.markup import html_nodes

WORDS = [("items", ["bought", "sold"]), ("original", ["was", "list"]), ("currency", ["$"]), ("saved", ["saved"])]


def pages_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


def keywords_of(spark, words=WORDS, config="c"):
    return spark.createDataFrame([(config, k, a, w) for k, (a, w) in enumerate(words)], "config string, ord int, attribute string, keywords array<string>")


def regions_of(spark, *texts, words=WORDS):
    pages = pages_of(spark, *texts)
    found = analysis.regions(html_nodes(pages), keywords_of(spark, words), pages.select("page_id", F.lit("c").alias("config")))
    return sorted((r.page_id, r.path) for r in found.collect())


def test_regions_are_the_smallest_that_hold_all(spark):
    deal = "<b>3 bought</b><i>it was $ 5</i><u>you saved</u>"
    assert regions_of(
        spark,
        f"<html><div><p>sold</p>{deal}</div></html>",  # two seeds, one region
        f"<html><p>sold</p><div>{deal}</div><div>{deal}</div></html>",  # the seed outside leads to what holds the others
        f"<html><div><b>bought</b></div><div>was $ 5</div></html>",  # an attribute is missing
        "<html></html>",
        None,
    ) == [(0, "/html/div"), (1, "/html/div"), (1, "/html/div[2]")]


def test_a_keyword_at_the_start_of_a_tag_is_not_found_there(spark):
    assert regions_of(spark, "<html><q>x</q><p>was 5 bought</p></html>", words=[("items", ["bought"]), ("original", ["was"])]) == [(0, "/html")]


def test_one_attribute_is_enough(spark):
    assert regions_of(spark, "<html><p><b>bought</b></p></html>", words=[("items", ["bought"])]) == [(0, "/html/p/b")]


def table_of(spark, *cells):
    rows = [(1, k, c) for k, c in enumerate(cells)]
    texts = spark.createDataFrame(rows, "page_id long, ord int, text string")
    words = {"discount": ["off"], "original": ["was", "list"], "saved": None}
    texts = texts.withColumns({f"{a}_words": F.lit(w) if w else F.lit(None).cast("array<string>") for a, w in words.items()})
    return {r.attribute: (r.number, r.ord) for r in analysis.price_table(texts).collect()}


@pytest.mark.parametrize(
    "cells,expected",
    [
        (["9", "was", "off", " ", "$100", "40%"], {"original": (100.0, 4), "discount": (40.0, 5)}),  # a row of names, one of numbers
        (["was", "less", "off", "$100", "$60", "40%"], {"original": (100.0, 3), "discount": (40.0, 5)}),  # a name that is not known
        (["was", "off", "$100"], {"original": (100.0, 2)}),  # fewer numbers than names
        (["was", "$100", "each", "off", "40%", "7"], {"original": (100.0, 1), "discount": (40.0, 4)}),  # in turn
        (["was", "$100", "40%", "list", "$90"], {"original": (90.0, 4)}),  # the last of a name counts
        (["was", "100"], {}),  # one name only
        (["was", "off"], {}),
        ([], {}),
    ],
)
def test_price_tables(spark, cells, expected):
    assert table_of(spark, *cells) == expected


def sold_of(spark, *texts):
    pages = pages_of(spark, *texts)
    nodes = html_nodes(pages)
    titles = nodes.filter("kind = 'text' and text like '%TITLE%'").select("page_id", "ord", "text")
    words = pages.select("page_id", F.posexplode(F.array(F.lit("bought"), F.lit("sold"))).alias("place", "word"))
    return {r.page_id: r.text for r in analysis.items_sold(nodes, titles, words).collect()}


def test_items_sold(spark):
    long = "x" * 600
    assert sold_of(
        spark,
        "<html><div><h1>TITLE</h1><b>5</b> <i>sold</i></div><p>9 bought</p></html>",  # the nearest tag, and the text before
        "<html><div><h1>TITLE</h1><i>7 sold</i><i>8 bought</i></div></html>",  # the first keyword
        f"<html><div><h1>TITLE</h1>{long}</div><p>9 bought</p></html>",  # too long before
        f"<html><div><h1>TITLE</h1>{long}<i>4 sold</i></div></html>",  # long, but it has the keyword
        "<html><b>5</b><b>none</b><h1>TITLE</h1><i>sold</i></html>",  # no number in two texts
        "<html><h1>TITLE</h1></html>",
    ) == {0: "5", 1: "8 bought", 3: "4 sold"}


def test_pictures_that_share_the_innermost_tag(spark):
    pages = pages_of(spark, '<html><img src="a.jpg"><div><img src="b.jpg"><p>PRICE</p><img lazysrc="/../c.jpg"></div></html>', '<html><img src="a.jpg"><p>PRICE</p></html>', "<html><p>PRICE</p></html>")
    nodes = html_nodes(pages)
    anchors = nodes.filter("text = 'PRICE' and kind = 'text'").select("page_id", "ord")
    known = spark.createDataFrame([("http://s/a.jpg", 200000, -1, -1, None), ("http://s/b.jpg", 100, 900, 900, "png"), ("http://s/c.jpg", None, 300, 300, "png")], "url string, size int, width int, height int, kind string")
    found = analysis.product_picture(nodes, anchors, pages.select("page_id", F.lit("s").alias("site")), known)
    assert {r.page_id: r.url for r in found.collect()} == {0: "http://s/c.jpg", 1: "http://s/a.jpg"}


def test_errors_in_turn(spark):
    head = "<html><h1>A title that costs $ 50 in all</h1><b>2 bought</b>"
    prices = "<div><q>so</q><p>was</p><i>$ 100</i><p>saved</p><i>$ 50</i></div>"
    texts = [
        "<html></html>",
        head + "<div><q>so</q><p>it was and saved $</p></div></html>",
        head + "<div><q>so</q><p>saved</p><p>$ 50</p><p>saved</p><p>$ 60</p><p>it was</p></div></html>",
        head + "<div><q>so</q><p>was</p><p>$ 50</p><p>was</p><p>$ 60</p><p>you saved</p></div></html>",
        f"<html><h1>short $</h1><b>2 bought</b>{prices}</html>",
        head + prices + "</html>",
        head + prices + '<img src="/a.jpg"></html>',
    ]
    pages = pages_of(spark, *texts).withColumn("site", F.lit("s"))
    configs = spark.createDataFrame([(0, "other", "^t"), (1, "c", ".")], "ord int, config string, pattern string")
    keywords = keywords_of(spark).unionByName(keywords_of(spark, config="other"))
    known = spark.createDataFrame([("http://s/a.jpg", 200000, -1, -1, None)], "url string, size int, width int, height int, kind string")
    found = {r.page_id: r for r in analysis.analyse(pages, configs, keywords, known, html_nodes(pages), "off", "$").collect()}
    assert [found[k].error for k in range(7)] == ["region", "prices", "original", "current", "title", "picture", None]
    assert [found[k].config for k in range(7)] == [None] + ["c"] * 6
    assert found[6].info == {"original": "100.0", "saved": "50.0", "title": "A title that costs $ 50 in all", "items": "2 bought", "image": "http://s/a.jpg"}
    assert found[6].paths == {"original": "/html/div/i", "saved": "/html/div/i[2]", "title": "/html/h1", "items": "/html/b", "image": "/html/img"}
