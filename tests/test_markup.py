"""The tolerant parser, node rows, feeds and configurations."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offerflow.functions.images import dimensions, image_kind, image_size
from offerflow.sources import feeds, markup


def tags(text, **options):
    return [(r["path"], r["text"]) for r in markup.parse(text, **options) if r["kind"] == "tag"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("<p>one<p>two", [("/p", "one"), ("/p[2]", "two")]),  # a paragraph does not nest
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", [("/ul", "abc"), ("/ul/li", "a"), ("/ul/li[2]", "bc"), ("/ul/li[2]/ul", "c"), ("/ul/li[2]/ul/li", "c")]),
        ("<div>a<div>b</div>c</div>", [("/div", "abc"), ("/div/div", "b")]),
        ("<b>x<br>y", [("/b", "xy"), ("/b/br", "")]),  # void elements have no content
        ("<i>a<b>c</i>d", [("/i", "ac"), ("/i/b", "c")]),  # an end tag closes what is open within
        ("a</b>c<i>d</i>", [("/i", "d")]),  # an end tag without a start is ignored
        ("<table><tr><td>1<td>2<tr><td>3</table>", [("/table", "123"), ("/table/tr", "12"), ("/table/tr/td", "1"), ("/table/tr/td[2]", "2"), ("/table/tr[2]", "3"), ("/table/tr[2]/td", "3")]),
        ("<table><tr><td><table><tr><td>in</table>out</table>", [("/table", "inout"), ("/table/tr", "inout"), ("/table/tr/td", "inout"), ("/table/tr/td/table", "in"), ("/table/tr/td/table/tr", "in"), ("/table/tr/td/table/tr/td", "in")]),
        ("<script>if (a<b) x='<p>'</script><p>t", [("/script", "if (a<b) x='<p>'"), ("/p", "t")]),
        ("", []),
    ],
)
def test_tree(text, expected):
    assert tags(text) == expected


def test_xml_has_no_rules_of_html():
    assert tags("<p>one<p>two</p></p>", xml=True) == [("/p", "onetwo"), ("/p/p", "two")]


def test_kinds_and_space():
    rows = markup.parse("<!DOCTYPE html><!-- c --><?php x ?><p>  \n </p><p>   </p><pre>  </pre>&amp;&#65;")
    assert [(r["kind"], r["text"]) for r in rows if r["kind"] != "tag"] == [("decl", "DOCTYPE html"), ("comment", " c "), ("pi", "php x ?"), ("text", "\n"), ("text", " "), ("text", "  "), ("text", "&amp;&#65;")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<b>", "</i>", "<br>", "<td>", "<table>", "text", " ", "<!--x-->", "<", "&", "<a href='x'>"]), max_size=25))
def test_any_markup_gives_a_tree(parts):
    rows = markup.parse("".join(parts))
    paths = [r["path"] for r in rows if r["kind"] == "tag"]
    assert len(set(paths)) == len(paths)  # a path leads to one tag
    for r in rows:
        assert r["parent"] < r["ord"] and r["depth"] == (0 if r["parent"] < 0 else rows[r["parent"]]["depth"] + 1)


PAGE = """<html><head><title> Deal </title></head><body><div class="l info">first</div><div class="l">second</div>
<a href="/a">A</a><a href="">none</a><a>no</a><p>x：地址 路 号 街 here</p>
<img src="http://maps.google.com/m?size=1&markers=1.5,2.5|3.25,4.75"><img lazysrc="http://maps.google.com/m?markers=9.5,9.5"></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>plain")], "page_id long, html string")


@pytest.fixture(scope="module")
def nodes(pages):
    return markup.html_nodes(pages).cache()


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("<p>é🙂<p>two</p>x", ["<p>é🙂", "<p>two</p>"]),
        ("<div>a\n<b>c</div >d", ["<div>a\n<b>c</div >", "<b>c"]),
        ("<ul><li>a<li>b</ul>", ["<ul><li>a<li>b</ul>", "<li>a", "<li>b"]),
        ("<i>x<br/>y<img src='>'>", ["<i>x<br/>y<img src='>'>", "<br/>", "<img src='>'>"]),
        ("<table><tr><td>1<tr><td>2", ["<table><tr><td>1<tr><td>2", "<tr><td>1", "<td>1", "<tr><td>2", "<td>2"]),
    ],
)
def test_places_in_the_markup(text, expected):
    assert [text[r["begin"] : r["end"]] for r in markup.parse(text) if r["kind"] == "tag"] == expected


def test_texts_lie_at_their_places():
    text = "a<b>c &amp; d</b><!-- note -->\n<p>e"
    rows = [(r["kind"], text[r["begin"] : r["end"]]) for r in markup.parse(text) if r["kind"] != "tag"]
    assert rows == [("text", "a"), ("text", "c &amp; d"), ("comment", "<!-- note -->"), ("text", "\n"), ("text", "e")]


def test_node_queries(nodes, pages):
    assert [r.text for r in markup.find_all(nodes, "div", {"class": "l"}).collect()] == ["second"]
    assert [r.text for r in markup.get_node(nodes, "/html[1]/body/div[2]").collect()] == ["second"]
    assert [(r.href, r.text) for r in markup.links(nodes).collect()] == [("/a", "A")]
    assert [tuple(r) for r in markup.titles(nodes).collect()] == [(1, "Deal")]
    assert [tuple(r) for r in markup.map_markers(nodes).collect()] == [(1, "1.5,2.5;3.25,4.75")]
    assert [tuple(r) for r in markup.find_address(nodes, ["路", "号", "街"]).collect()] == [(1, "地址 路 号 街 here")]
    found = {r.page_id: r for r in markup.extract_fields(pages, {"info": "class:l info", "head": "path:/html/head/title", "none": "path:/x"}).collect()}
    assert (found[1].info, found[1]["head"], found[1].none, found[3].info) == ('<div class="l info">first</div>', "<title> Deal </title>", None, None) and 2 not in found
    assert {(r.parent, r.n) for r in markup.children_count(nodes).filter("page_id = 3").collect()} == {(-1, 1), (0, 1)}
    ring = {r.ord: (r.previous, r.next) for r in markup.siblings(nodes).filter("page_id = 1 and parent = 0").collect()}
    assert list(ring.values()) == [(None, list(ring)[1]), (list(ring)[0], None)]


def test_ways_to_find_tags(nodes):
    found = lambda *a, **k: [r.text for r in markup.find_all(nodes, *a, **k).orderBy("page_id", "ord").collect()]
    assert found("div", "l") == ["first", "second"] and found("div", "info") == ["first"] and found("div", "inf") == []
    assert found(["title", "p"]) == ["Deal", "x：地址 路 号 街 here", "plain"] and found(re.compile("^t")) == ["Deal"]
    assert found("a", {"href": True}) == ["A", "none"] and found("a", {"href": None}) == ["no"] and found("a", {"href": ["/a", "/b"]}) == ["A"]
    assert found("a", {"href": re.compile("^/")}) == ["A"] and found("a", limit=2) == ["A", "none"]
    assert found("title", below=markup.find_all(nodes, "head")) == ["Deal"] and found("title", below=markup.find_all(nodes, "body")) == []
    chain = [(r.before, r.ord, r.after) for r in markup.in_order(nodes).filter("page_id = 3").orderBy("ord").collect()]
    assert chain == [(None, 0, 1), (0, 1, None)]


def test_charsets(spark):
    texts = {"ascii": "plain", "utf-8-sig": "é漢", "utf-16": "é漢", "gb2312": "汉字", "gb18030": "汉字€\U0001F600"}
    rows = [(k, t.encode(k)) for k, t in texts.items()] + [("declared", b'<meta charset="iso-8859-1">\xe9'), ("xml", b'<?xml version="1.0" encoding="utf-8"?>' + "é".encode()), ("null", None)]
    found = dict(spark.createDataFrame(rows, "k string, data binary").select("k", markup.decode_markup("data")).collect())
    assert found == texts | {"declared": '<meta charset="iso-8859-1">é', "xml": '<?xml version="1.0" encoding="utf-8"?>é', "null": None}


def test_feeds(spark):
    broken = "<urlset><url><loc>http://a</loc><data><title>One</title><title>Two</title><price>1,200</price></data></url><url><loc>http://b</loc><title>T"
    df = spark.createDataFrame([("f", broken), ("none", None)], "feed_id string, xml string")
    found = feeds.parse_feeds(df).orderBy("url").collect()
    assert [(r.url, r.title, r.current) for r in found] == [("http://a", "Two", "1,200"), ("http://b", "T", None)]


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<urlset><url><loc>http://a</loc><rebate>5.5</rebate></url><url><loc>http://b</loc></url></urlset>")
    assert sorted((r.url, r.discount) for r in feeds.read_feed_files(spark, f"file://{tmp_path}").collect()) == [("http://a", "5.5"), ("http://b", None)]


def test_configurations(spark):
    assert [tuple(r) for r in feeds.dimension(spark, '<c><city id="x">X </city><city>Y</city></c>', "city").collect()] == [("x", "X", 0), ("Y", "Y", 1)]
    words = feeds.keyword_map(spark, '<k><site id="s"><price>a</price><price>b</price><price>a</price><title/></site></k>').collect()
    assert [tuple(r) for r in words] == [("s", "price", ["a", "b"], 0)]
    assert feeds.pipeline_spec('<sites><site id="s"><processor module="remove_tail"><tail>?x</tail></processor><processor module="reconcile"/></site></sites>') == {"s": [("remove_tail", {"tail": "?x"}), ("reconcile", {})]}
    policy = feeds.crawl_policy('<?xml version="1.0" encoding="utf-8"?><site id="x"><starturls><url>http://a</url></starturls><domains><s>a</s><p>b.*</p><s> </s></domains><patterns><p>/d</p></patterns><maxdepth>3</maxdepth></site>')
    assert policy == {"site": "x", "starturls": ["http://a"], "domains": ["a"], "domain_patterns": ["b.*"], "path_patterns": ["/d"], "maximum_depth": 3, "maximum_pages": 0}


PNG = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
BMP = b"BM" + bytes(16) + (320).to_bytes(4, "little") + (200).to_bytes(4, "little")
JPG = b"\xff\xd8\xff\xe0\x00\x04\0\0\xff\xc4\x00\x03\0\xff\xc0\x00\x11\x08" + (90).to_bytes(2, "big") + (120).to_bytes(2, "big") + bytes(12)


def test_images(spark):
    assert [dimensions(x) for x in (PNG, BMP, JPG, b"", b"GIF8", JPG[:9])] == [(640, 480), (320, 200), (120, 90), (-1, -1), (-1, -1), (-1, -1)]
    assert dimensions(b"BM" + bytes(16) + (5).to_bytes(4, "little") + (-7).to_bytes(4, "little", signed=True)) == (5, -7)
    df = spark.createDataFrame([(0, PNG), (1, BMP), (2, JPG), (3, b"GIF"), (4, None)], "k int, data binary")
    found = df.select("k", image_kind(F.col("data")).alias("kind"), image_size("data").alias("size")).orderBy("k").collect()
    assert [(r.kind, tuple(r["size"])) for r in found] == [("png", (640, 480)), ("bmp", (320, 200)), ("jpeg", (120, 90)), (None, (-1, -1)), (None, (-1, -1))]
