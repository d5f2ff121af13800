"""Plans that stay whole on large tables: what is broadcast, how many tasks parse, and entities as pages write them."""

import pytest
from pyspark.sql import functions as F

from offerflow import catalog, web_catalog
from offerflow.operators import analysis, crawl, induce, structure, updates
from offerflow.plans import induction, pipeline
from offerflow.sources import feeds, markup
from offerflow.sources.tables import cut

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("markup_text, text", [("a&am", "a&am"), ("&am;", "&am;"), ("x&amp y", "x&amp y"), ("&#65 b", "&#65 b"), ("&#65;b", "&#65;b"), ("&&amp;&amp", "&&amp;&amp")])
def test_entities_stay_as_written(markup_text, text):
    rows = markup.parse(f"<title>\n{markup_text}</title>")
    assert rows[0]["text"] == text and rows[1]["text"] == "\n" + text


@pytest.mark.parametrize("limit", [1, 3, 10_000])
def test_node_rows_do_not_depend_on_how_pages_leave_together(spark, monkeypatch, limit):
    monkeypatch.setattr(markup, "MOST_ROWS", limit)
    pages = spark.createDataFrame([(k, None if k % 7 == 0 else "<p>a" * (k % 5) + f"<b id={k}>") for k in range(50)], "page_id long, html string")
    found = sorted((r.page_id, r.ord, r.name, r.attrs.get("id")) for r in markup.html_nodes(pages).collect())
    expected = sorted((p.page_id, r["ord"], r["name"], r["attrs"].get("id")) for p in pages.collect() for r in markup.parse(p.html or ""))
    assert found == expected


def test_pages_of_one_file_are_parsed_by_many_tasks(spark):
    pages = cut(spark.range(4000).coalesce(1).select(F.col("id").alias("page_id"), F.lit("<p>a</p>").alias("html")))
    assert pages.rdd.getNumPartitions() == 1
    rows = markup.html_nodes(pages).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) < 2 * 8000 / 8
    assert markup.extract_fields(pages, {"p": "path:/p"}).count() == 4000


def joins(df):
    """The lines of the first plan of ``df`` that tell how it joins."""
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]


def test_crawls_send_few_pages_to_all_tasks(spark, monkeypatch):
    seen = []
    before = crawl.large
    monkeypatch.setattr(crawl, "FEW", 4)
    monkeypatch.setattr(crawl, "large", lambda df: seen.append(df.columns) or before(df))
    edges = spark.range(1, 100).select(F.col("id").alias("src"), F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("dst"), F.lit("t").alias("text"))
    found = crawl.reachable(spark.createDataFrame([(1,)], "url long"), edges)
    assert found.count() == 199 and found.filter("url = 198 and depth = 7").count() == 1
    # From the round of four pages on, the pages known are sorted, and from that of eight on the newest ones too.
    assert seen.count(["_known"]) >= 4 and sum("depth" in c for c in seen) >= 4


def test_policies_are_sent_to_tasks_and_links_are_not(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(crawl, "cut", lambda df: plans.append(joins(df)) or cut(df))
    policy = '<site id="s"><starturls><url>http://a/</url></starturls><maxdepth>0</maxdepth></site>'
    links = cut(spark.createDataFrame([("s", "http://a/", "http://a/b", "t")], "site string, src string, dst string, text string"))
    found = crawl.crawl_sites(feeds.crawl_policies(spark, policy), links)
    assert sorted(r.url for r in found.collect()) == ["http://a/", "http://a/b"]
    assert len(plans[0]) == 1 and "BuildRight" in plans[0][0] and "BroadcastHashJoin" in plans[0][0]


def test_analysis_broadcasts_configurations_only(spark, monkeypatch):
    plans = []
    keep = lambda df: plans.extend(joins(df)) or cut(df)
    for module in (analysis, induction):
        monkeypatch.setattr(module, "cut", keep)
    size = F.col("p_size") % 4
    part = spark.read.parquet(f"{SF}/part.parquet")
    pages, pictures, configs, keywords = catalog.part_pages(spark, part, F.when(size == 0, 0).when(size == 3, 3).otherwise(1))
    nodes = markup.html_nodes(pages, texts=False)
    plans.extend(joins(analysis.analyse(pages, configs, keywords, pictures, nodes, "off", "$")))
    assert plans and not [p for p in plans if "BroadcastHashJoin [page_id" in p or "BroadcastHashJoin [url" in p or "BroadcastNestedLoopJoin BuildLeft" in p]
    plans.clear()
    stored = spark.createDataFrame([], "site string, ord int, template map<string,string>")
    induction.induce(pages, nodes, stored, configs, keywords, pictures, "off", "$", order=F.col("page_id"))
    assert plans and not [p for p in plans if "BroadcastHashJoin [page_id" in p or "BroadcastHashJoin [url" in p or "BroadcastNestedLoopJoin BuildLeft" in p]


def test_a_configuration_is_chosen_without_sending_sites_to_tasks(spark):
    configs = spark.createDataFrame([(0, "a", "1$", None), (1, "b", ".", None)], "ord int, config string, pattern string, region string")
    sites = cut(spark.range(20).select(F.col("id").cast("string").alias("site"), F.lit("r").alias("region")))
    chosen = induce.choose_config(sites, configs)
    assert "BuildRight" in joins(chosen)[0]
    assert {r.site for r in chosen.filter("config = 'a'").collect()} == {"1", "11"}


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 1, 2], [7, 7, 7, 9], [-(10**12), 0, 1, 2, 10**12], list(range(0, 9000, 3)), [1, None, 4, 9]])
def test_halfway_is_the_discrete_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "ord long")
    assert updates.halfway(df) == df.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ord)")).first()[0]


def test_halfway_of_nothing(spark):
    assert updates.halfway(spark.createDataFrame([], "ord long")) is None


@pytest.fixture
def parsed(spark, monkeypatch):
    """How many pages tasks have parsed."""
    n, parse = spark.sparkContext.accumulator(0), markup.parse

    def counting(*args):
        n.add(1)
        return parse(*args)

    monkeypatch.setattr(markup, "parse", counting)
    return n


def test_structural_joins_parse_a_page_once(spark, parsed):
    found = web_catalog.structural_joins(spark, SF)
    assert not [line for line in joins(found) if "Broadcast" in line]
    assert found.count() > 0 and parsed.value == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_titles_and_links_are_parsed_once(spark, parsed):
    assert catalog.crawl_parameter_collapse(spark, SF).collect()
    assert parsed.value == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_feeds_are_parsed_once(spark, parsed):
    rows = [(f"f{k}", f"<urlset><url><loc>http://{k}</loc><title>T</title></url></urlset>") for k in range(20)]
    found = feeds.parse_feeds(spark.createDataFrame(rows, "feed_id string, xml string"))
    assert sorted(r.url for r in found.collect()) == sorted(f"http://{k}" for k in range(20)) and parsed.value == 20


def test_addresses_and_markers_are_parsed_once(spark, parsed):
    rows = [(f"u{k}", f'<p>At：{k} street, road, lane</p><img src="http://maps.google.com/?markers=1.5,2.5">') for k in range(20)]
    found = pipeline._in_markup(spark.createDataFrame(rows, "url string, html string"), "html", ["street", "road", "lane"])
    assert sorted((r._url, r._address, r._place is not None) for r in found.collect()) == sorted((f"u{k}", f"{k} street, road, lane", True) for k in range(20))
    assert parsed.value == 20


@pytest.mark.parametrize("way", [structure.following, structure.preceding])
def test_columns_come_with_what_is_before_and_after(spark, way):
    nodes = spark.createDataFrame([(1, 0, "a"), (1, 3, None), (1, 5, "c"), (2, 4, "d")], "page_id long, ord int, href string")
    found = {(r.page_id, r.ord, r.place): (r.found, r.href) for r in way(nodes, nodes, 2, carry=("href",)).collect()}
    if way is structure.following:
        assert found == {(1, 0, 1): (3, None), (1, 0, 2): (5, "c"), (1, 3, 1): (5, "c")}
    else:
        assert found == {(1, 3, 1): (0, "a"), (1, 5, 1): (3, None), (1, 5, 2): (0, "a")}
