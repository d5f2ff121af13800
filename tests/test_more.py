"""Links, city lists, dashboards, templates, jobs."""

import datetime
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from offerflow.functions.text import join_url
from offerflow.operators import control, dedup, induce
from offerflow.sources import markup

BASES = ["http://a.com/b/c/d.html?q=1#f", "http://a.com", "http://a.com/", "https://a.com:80/x/y/"]
LINKS = ["http://o.com/x", "//n.com/p", "/r/s?t", "?k=v", "#g", "e.html", "./e", "../e?x#y", "../../../e", "e/./f/../g", ".", "..", "", "mailto:x@y.z"]


@pytest.mark.parametrize("base", BASES)
def test_links_are_joined_as_the_standard_library_does(spark, base):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(LINKS)], "k int, link string")
    found = dict(df.select("k", join_url(F.lit(base), F.col("link"))).collect())
    assert found == {k: urljoin(base, x) for k, x in enumerate(LINKS)}


def test_city_urls(spark):
    page = "<p>only shenzhen here</p><script>var c = ['beijing','shanghai','shenzhen','wuhan','beijing','mars'];</script>"
    nodes = markup.html_nodes(spark.createDataFrame([(1, page), (2, "<p>shenzhen")], "page_id long, html string"))
    tokens = markup.city_list(nodes, "shenzhen", ["beijing", "shanghai", "wuhan", "tianjin"])
    cities = spark.createDataFrame([(c,) for c in ("beijing", "shanghai", "shenzhen", "wuhan")], "cityid string")
    known = dedup.known_cities(tokens, cities, "page_id")
    assert [(r.page_id, r.pos, r.cityid) for r in known.orderBy("pos").collect()] == [(1, k, c) for k, c in enumerate(["beijing", "shanghai", "shenzhen", "wuhan", "beijing"])]
    assert [r.url for r in dedup.batch_urls(known, "http://x", "c=%s", 3).orderBy("batch").collect()] == ["http://x?c=beijing&c=shanghai&c=shenzhen", "http://x?c=wuhan&c=beijing"]


def test_dashboards_and_walks(spark):
    page = "<table><tr><td>CPU Time</td><td> </td><td>12%</td></tr><tr><td>Other</td><td>5%</td></tr><tr><td>Stored Data</td><td>n/a</td></tr></table>"
    nodes = markup.html_nodes(spark.createDataFrame([(1, page)], "page_id long, html string"))
    assert [(r.label, r.value) for r in markup.quota_cells(nodes, {"cpu": "^CPU", "data": "Data"}).collect()] == [("cpu", 12.0)]
    cell = markup.find_text(nodes, "^12")
    assert [r.name for r in markup.ancestors(nodes, cell).orderBy(F.desc("depth")).collect()] == ["td", "tr", "table"]
    second = markup.get_node(nodes, "/table/tr[2]")
    assert [r.name for r in markup.ancestors(nodes, second).collect()] == ["table"]


def test_first_template_that_fits(spark):
    pages = spark.createDataFrame([(1, "<h1>T</h1><b>5</b>"), (2, "<h1>U</h1>"), (3, "<p>x")], "page_id long, html string")
    found = induce.apply_first(markup.html_nodes(pages), [{"title": "/h1", "price": "/b"}, {"title": "/h1"}])
    assert {r.page_id: (r.template, r.info) for r in found.collect()} == {1: (0, {"title": "T", "price": "5"}), 2: (1, {"title": "U"})}
    configs = spark.createDataFrame([(1, "b", "x", None), (0, "a", "x$", "r")], "ord int, config string, pattern string, region string")
    sites = spark.createDataFrame([("ax", "r"), ("bx", "q"), ("c", "r")], "site string, region string")
    assert dict(induce.choose_config(sites, configs).collect()) == {"ax": "a", "bx": "b"}
    records = spark.createDataFrame([("ab:T", "$5.5 now", None, None)], "title string, price string, items string, city string")
    assert tuple(induce.normalise(records, ":", "X").first()) == ("T", 5.5, 0.0, "X")


def test_jobs(spark):
    now, then = datetime.datetime(2024, 1, 2), datetime.datetime(2024, 1, 1)
    sites = spark.createDataFrame([(k, None, then, "old") for k in "abc"], "siteid string, enqueuetime timestamp, lastupdate timestamp, error string")
    results = spark.createDataFrame([("a", None), ("b", "late")], "siteid string, error string")
    after = {r.siteid: (r.lastupdate, r.error) for r in control.complete(sites, results, F.lit(now)).collect()}
    assert after == {"a": (now, None), "b": (then, "late"), "c": (then, "old")}
    assert {r.enqueuetime for r in control.enqueue(sites, F.lit(now)).collect()} == {now}


def test_names_within_texts_equal_a_plain_search(spark):
    names = ["a", "ab", "abc", "abcd", "bcd", "京", "北京", "x/y", "", None, "dd", "abc"]
    texts = ["", None, "a", "zabcdz", "ABC", "在北京买", "x/y/z", "ddd", "ab ab ab", "q" * 3000 + "bcd", "zz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    listed = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    found = sorted(tuple(r) for r in dedup.names_within(rows, listed, "k", "t").collect())
    assert found == sorted((k, i, n) for k, t in enumerate(texts) if t for i, n in enumerate(names) if n and n in t)
    assert dedup.names_within(rows.limit(0), listed, "k", "t").count() == dedup.names_within(rows, listed.limit(0), "k", "t").count() == 0


def test_names_and_texts_meet_in_an_equal_join(spark, capsys):
    rows = spark.range(5).select(F.col("id").alias("k"), F.lit("to abc").alias("t"))
    dedup.names_within(rows, spark.createDataFrame([("abc",)], "name string"), "k", "t").explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_status_reports_of_servers_with_and_without_sites(spark):
    servers = spark.createDataFrame([("s1", "user", 1.0, None), ("s2", "extractor", 2.0, 3.0)], "address string, servertype string, cpu_usage double, datastore double")
    servers = servers.withColumns({"outgoing_bandwidth": F.lit(0.5), "incomming_bandwidth": F.lit(0.25)})
    sites = spark.createDataFrame([("s1", "a", "x"), ("s1", "b", None), ("s9", "c", None)], "address string, siteid string, error string")
    found = control.status_report(servers, sites)
    assert found.columns == ["address", "servertype", "cpu_usage", "outgoing_bandwidth", "incomming_bandwidth", "datastore", "siteid", "error"]
    rows = sorted(((r.address, r.servertype, r.datastore, r.siteid or "", r.error) for r in found.collect()), key=str)
    assert rows == [("s1", "user", 0.0, "a", "x"), ("s1", "user", 0.0, "b", None), ("s2", "extractor", 3.0, "", None)]


def test_malformed_tags_are_read_as_what_they_are_without_the_fault():
    tags = lambda text, xml=False: [(r["kind"], r["name"], r["attrs"], r["text"], r["parent"]) for r in markup.parse(text, xml)]
    for wrong, right in (("<p><a href=x/>t</p>", "<p><a href='x' />t</p>"), ("<br/>t", "<br />t"), ("<a b=1 c=2/><i>t</i>", "<a b=1 c=2 /><i>t</i>"), ("<! DOCTYPE html>t", "<!DOCTYPE html>t"), ("<! \n--c-->t", "<!--c-->t")):
        assert tags(wrong) == tags(right)
    assert tags("<a href=x/><b>t</b></a>", True) == tags("<a href='x' /><b>t</b></a>", True)
    assert tags('<a href="x/">t</a>')[0][2] == {"href": "x/"}  # a slash within quotation marks is part of the value
    assert tags("<!-- c -->")[0][3] == " c " and tags("<!---->")[0][3] == "" and tags("<! >")[0][0] == "comment"
    assert tags("<script>if (a <b c=d/> e) f</script>")[1][3] == "if (a <b c=d/> e) f"
