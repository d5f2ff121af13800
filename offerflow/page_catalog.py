"""Queries of pages and what is read from them, each with its SQL; the pages are made of the tables' rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .catalog import query
from .functions import geo, images, text
from .operators import crawl, dedup, induce, listing, merge
from .plans import pipeline, views
from .plans.views import OFFERS, SERVERS, SITES, read
from .sources import feeds, markup

_HREF = r"regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1)"
_TITLE = "trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's'))"


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'bmp' WHEN 2 THEN 'jpeg' END AS kind,
  CASE WHEN p_partkey % 4 = 3 THEN -1 ELSE 200 + p_size * 3 END::BIGINT AS width, CASE p_partkey % 4 WHEN 3 THEN -1 WHEN 1 THEN -p_size ELSE p_size * 9 END::BIGINT AS height FROM part""")
def image_headers(spark, d):
    """Pictures of three kinds, a bitmap with its rows from the top, and one of no kind."""
    width, height = F.col("p_size") * 3 + 200, F.col("p_size") * 9
    big = lambda c, n: F.lpad(F.hex(c), n, "0")
    little = lambda c: F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)])
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(width, 8), big(height, 8))
    bmp = F.concat(F.lit("424D" + "00" * 16), little(width), little(-F.col("p_size")))
    jpeg = F.concat(F.lit("FFD8FFE0000600000000FFC0001108"), big(height, 4), big(width, 4), F.lit("03"))
    kind = F.col("p_partkey") % 4
    data = F.unhex(F.when(kind == 0, png).when(kind == 1, bmp).when(kind == 2, jpeg).otherwise("474946"))
    found = read(spark, d, "part").select("p_partkey", data.alias("data")).withColumn("size", images.image_size("data"))
    return found.select("p_partkey", images.image_kind(F.col("data")).alias("kind"), "size.width", "size.height")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN p_name END AS decoded FROM part")
def decoded_markup(spark, d):
    """Texts with the mark of an encoding, and without."""
    kind = F.col("p_partkey") % 4
    plain = F.encode("p_name", "UTF-8")
    data = F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), plain)).when(kind == 1, F.encode("p_name", "UTF-16")).when(kind == 2, plain)
    return read(spark, d, "part").select("p_partkey", markup.decode_markup(data).alias("decoded"))


@query("""WITH t AS (SELECT p_partkey // 100 AS page_id, list_prepend('list', regexp_extract_all(string_agg(p_name, ' ' ORDER BY p_partkey), '[a-zA-Z]+')) AS words FROM part GROUP BY 1),
c AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS city FROM part),
u AS (SELECT page_id, unnest(words) AS city, generate_subscripts(words, 1) AS place FROM t WHERE list_contains(words, 'cold') AND list_contains(words, 'small') AND list_contains(words, 'large')),
k AS (SELECT page_id, city, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS pos FROM u WHERE city IN (SELECT city FROM c))
SELECT page_id, pos // 11 AS batch, 'http://x?' || string_agg('c=' || city, '&' ORDER BY pos) AS url FROM k GROUP BY 1, 2""")
def city_urls(spark, d):
    """Lists of cities in scripts, a hundred parts each: the known ones as addresses of eleven."""
    part = read(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("page_id"), "p_partkey", "p_name")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " ")
    pages = part.groupBy("page_id").agg(names.alias("names")).select("page_id", F.format_string("<html><p>towns</p><script>list %s</script></html>", "names").alias("html"))
    tokens = markup.city_list(markup.html_nodes(pages), "list", ["cold", "small", "large"])
    cities = read(spark, d, "part").select(F.substring_index("p_name", " ", 1).alias("cityid")).distinct()
    return dedup.batch_urls(dedup.known_cities(tokens, cities, "page_id"), "http://x", "c=%s", keys=["page_id"])


_GRID = f"(500::BIGINT << 48) + (CAST(floor((lat + 90) / ({geo.LAT_STEP * 500!r}::DOUBLE)) AS BIGINT) << 24) + CAST(floor((lon + 180) / ({geo.LON_STEP * 500!r}::DOUBLE)) AS BIGINT)"


@query(f"""WITH c AS (SELECT *, 10.5::DOUBLE + c_nationkey AS lat, 20.25::DOUBLE + c_custkey % 100 AS lon, c_custkey % 3 AS kind FROM customer)
SELECT c_name AS url, CASE WHEN kind = 0 THEN 'known' ELSE 'No. ' || c_custkey || ' street district road' END AS address,
  CASE WHEN kind = 2 THEN '1.5,2.5' ELSE (CAST(lat AS VARCHAR) || ',' || CAST(lon AS VARCHAR)) END AS geoinfo, CASE WHEN c_custkey % 5 = 0 THEN 'multi' ELSE 'nation_' || c_nationkey END AS cityid,
  CASE WHEN kind = 2 THEN (500::BIGINT << 48) + (CAST(floor(91.5 / ({geo.LAT_STEP * 500!r}::DOUBLE)) AS BIGINT) << 24) + CAST(floor(182.5 / ({geo.LON_STEP * 500!r}::DOUBLE)) AS BIGINT) ELSE {_GRID} END AS geogrid FROM c""")
def address_enrichment(spark, d):
    """Customers as offers: addresses in details that hold enough of the words, points of map pictures in the details or beside them."""
    kind = F.col("c_custkey") % 3
    point = F.concat_ws(",", (F.col("c_nationkey") + F.lit(10.5)).cast("string"), (F.col("c_custkey") % 100 + F.lit(20.25)).cast("string"))
    image = F.concat(F.lit('<img src="http://maps.google.com/m?size=9&amp;markers='), point, F.lit('">'))
    # The words that are no address: three of them before a colon, with two after it.
    said = F.format_string("<p>call us</p><p>street district road：street road only</p><p>Address：No. %d street district road</p>", "c_custkey")
    details = F.when(kind == 0, F.lit("<p>street and road only</p>")).when(kind == 1, F.concat(said, image)).otherwise(F.concat(said, F.lit('<img src="http://maps.google.com/m?markers=1.5,2.5">')))
    city = F.when(F.col("c_custkey") % 5 == 0, F.lit("NATION_1,NATION_2")).otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    rows = read(spark, d, "customer").select(F.col("c_name").alias("url"), city.alias("city"), F.lit("<b>known</b>").alias("address"), details.alias("addrdetails"), image.alias("mapimg"), F.lit(True).alias("html_flag"))
    found = pipeline.run([("enrich_address", {"words": ("street", "district", "road", "lane")})], rows, cities=views.cities(spark, d))
    return found.select("url", "address", "geoinfo", "cityid", "geogrid")


@query(f"""WITH c AS (SELECT *, c_custkey % 4 <> 0 AND c_custkey % 7 <> 0 AS can FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, can ORDER BY c_custkey) AS turn FROM c)
SELECT c_name AS url, CASE WHEN can AND turn <= 10 THEN CASE WHEN c_nationkey < 20 THEN c_nationkey || '.5,1.5' ELSE '{geo.NOWHERE}' END WHEN c_custkey % 7 = 0 THEN '3.5,4.5' END AS geoinfo FROM n""")
def geocode_attempts(spark, d):
    """At most ten of a site's rows with an address and no place look it up; what the gazetteer lacks gets the sentinel."""
    key = F.col("c_custkey")
    rows = read(spark, d, "customer").select(
        F.col("c_name").alias("url"), F.col("c_mktsegment").alias("siteid"), key.alias("ord"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("street "), F.col("c_nationkey").cast("string"))).alias("address"), F.when(key % 7 == 0, "3.5,4.5").alias("geoinfo"),
    )
    nations = read(spark, d, "nation").filter("n_nationkey < 20")
    gazetteer = nations.select(F.format_string("street %d", "n_nationkey").alias("address"), F.format_string("%d.5,1.5", "n_nationkey").alias("geoinfo"))
    return pipeline.run([("geocode", {})], rows, gazetteer=gazetteer).select("url", "geoinfo")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS url, CAST(o_custkey AS VARCHAR) AS depth, o_orderpriority AS linktext FROM orders")
def frontier_restored(spark, d):
    """Orders as a frontier, written as text and read back."""
    frontier = read(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_custkey").alias("depth"), F.col("o_orderpriority").alias("linktext"))
    return crawl.parse_frontier(crawl.frontier_text(frontier), frontier.columns)


@query("""SELECT (SELECT count(*) FROM region) AS few, (SELECT sum(r_regionkey) FROM region)::BIGINT AS few_sum, 16::BIGINT AS many, 0::BIGINT AS strange""")
def seed_samples(spark, d):
    """All of five regions; sixteen different ones of all parts."""
    few = crawl.seed_sample(read(spark, d, "region"), "r_regionkey").agg(F.count("*").alias("few"), F.sum("r_regionkey").cast("long").alias("few_sum"))
    part = read(spark, d, "part").select("p_partkey")
    many = crawl.seed_sample(part, "p_partkey")
    strange = many.join(part, "p_partkey", "left_anti").agg(F.count("*").alias("strange"))
    return few.crossJoin(many.agg(F.countDistinct("p_partkey").alias("many"))).crossJoin(strange)  # a row each


@query("SELECT c_nationkey, string_agg(c_mktsegment, ';' ORDER BY c_mktsegment) AS list, count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY 1 UNION ALL SELECT -1, '', 0")
def lists_of_segments(spark, d):
    """Lists as text, and the length of what is read back; an empty text is an empty list."""
    lists = read(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("segments"))
    none = spark.createDataFrame([(-1, [])], "c_nationkey int, segments array<string>")
    said = lists.withColumn("c_nationkey", F.col("c_nationkey").cast("int")).unionByName(none).select("c_nationkey", text.encode_list(F.col("segments")).alias("list"))
    return said.withColumn("n", F.size(text.decode_list(F.col("list"))).cast("long"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal BETWEEN -90 AND 90 AND c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 3 = 1 THEN c_nationkey::DOUBLE END AS lat,
  CASE WHEN c_acctbal BETWEEN -90 AND 90 AND c_custkey % 3 = 0 THEN c_nationkey::DOUBLE WHEN c_custkey % 3 = 1 THEN -c_nationkey::DOUBLE END AS lon FROM customer""")
def parsed_points(spark, d):
    """Points as text: out of range, with a third piece, and malformed."""
    kind = F.col("c_custkey") % 3
    said = F.when(kind == 0, F.concat_ws(",", F.col("c_acctbal").cast("string"), F.col("c_nationkey").cast("string")))
    said = said.when(kind == 1, F.format_string("%d,-%d,9", "c_nationkey", "c_nationkey")).otherwise(F.col("c_name"))
    return read(spark, d, "customer").withColumn("point", geo.parse_point(said)).select("c_custkey", "point.lat", "point.lon")


_POLICY = """<?xml version="1.0" encoding="utf-8"?>
<site id="brands"><starturls><url>http://brand11.example.com/</url></starturls><domains><s>brand33.example.com</s><p>brand1[12][.]</p></domains>
<patterns><p>/deal/[0-9]*7[.]html</p></patterns><maxdepth>3</maxdepth><maxpages>0</maxpages></site>"""


@query(f"{OFFERS} SELECT ord, 3::INT AS depth, regexp_matches(url, '^http://(brand1[12]|brand33)[.]example[.]com/deal/[0-9]*7[.]html') AS admitted FROM offers")
def policy_admission(spark, d):
    policy = feeds.crawl_policy(_POLICY)
    admitted = crawl.admitted(F.col("url"), policy["domains"], policy["domain_patterns"], policy["path_patterns"])
    return views.offers(spark, d).select("ord", F.lit(policy["maximum_depth"]).alias("depth"), admitted.alias("admitted"))


@query("SELECT p_partkey AS url, CASE WHEN p_partkey = 1 THEN 0 WHEN p_partkey < 4 THEN 1 ELSE 2 END AS depth FROM part WHERE p_partkey BETWEEN 1 AND 7")
def crawl_to_a_depth(spark, d):
    """Parts as pages that link to the two of twice their number, three levels deep."""
    edges = read(spark, d, "part").select(F.col("p_partkey").alias("src"), F.explode(F.array(F.col("p_partkey") * 2, F.col("p_partkey") * 2 + 1)).alias("dst"), F.col("p_brand").alias("text"))
    return crawl.reachable(spark.createDataFrame([(1,)], "url long"), edges, most_depth=3).select("url", "depth")


@query(f"SELECT page_id, {_TITLE} AS title FROM pages WHERE {_TITLE} <> ''")
def template_application(spark, d):
    return induce.apply_template(markup.html_nodes(read(spark, d, "pages"), wanted=markup.Wanted(path="/html/head/title")), {"title": "/html/head/title"}).filter("title <> ''")


@query(f"SELECT page_id, unnest({_HREF}[1:2]) AS href FROM pages")
def first_links(spark, d):
    """The first two links of a page that begin with a slash or a scheme."""
    found = markup.find_all(markup.html_nodes(read(spark, d, "pages"), wanted=markup.Wanted(name="a")), "a", {"href": re.compile(".")}, limit=2)
    return found.select("page_id", F.col("attrs")["href"].alias("href"))


@query("SELECT s_suppkey, 'cpu' AS label, (s_suppkey % 100)::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'data', (s_nationkey + 0.5)::DOUBLE FROM supplier")
def dashboard_quotas(spark, d):
    """Suppliers as servers whose dashboards say what they used."""
    page = F.format_string("<table><tr><td>CPU Time</td><td>%d%%</td></tr><tr><td>Stored Data</td> <td>%s%%</td></tr><tr><td>Other</td><td>9%%</td></tr></table>", F.col("s_suppkey") % 100, (F.col("s_nationkey") + F.lit(0.5)).cast("string"))
    nodes = markup.html_nodes(read(spark, d, "supplier").select("s_suppkey", page.alias("html")), "s_suppkey")
    return markup.quota_cells(nodes, {"cpu": "^CPU", "data": "Data$"}, "s_suppkey").select("s_suppkey", "label", "value")


@query(f"{SITES} SELECT siteid, updateserver, lastupdate FROM sites WHERE siteid <> 'NATION_3'")
def restart_of_a_site_sites(spark, d):
    """The site table after a restart: the site is gone, to be added anew."""
    return merge.delete_where(views.site_times(spark, d), F.col("siteid") == "NATION_3").select("siteid", "updateserver", "lastupdate")


@query(f"{OFFERS} SELECT siteid, count(*) AS n FROM offers WHERE siteid <> 'Brand#11' GROUP BY 1")
def restart_of_a_site_offers(spark, d):
    """The offers after it: those of the site are deleted."""
    return merge.delete_where(views.offers(spark, d), listing.condition("siteid =", "Brand#11")).groupBy("siteid").agg(F.count("*").alias("n"))


@query(f"{SERVERS}, s AS (SELECT address, servertype, sites FROM loaded) SELECT 'server' AS kind, '<tr><td>' || address || '</td><td>' || servertype || '</td><td>' || sites || '</td></tr>' AS line FROM s UNION ALL SELECT 'site', '<tr><td>' || n_name || '</td></tr>' FROM nation")
def status_page(spark, d):
    """The rows of the servers' and the sites' tables."""
    servers = views.servers(spark, d).select(F.lit("server").alias("kind"), listing.html_row(views.servers(spark, d), ["address", "servertype", "sites"]).alias("line"))
    sites = read(spark, d, "nation").select(F.col("n_name").alias("siteid"))
    return servers.unionByName(sites.select(F.lit("site").alias("kind"), listing.html_row(sites, ["siteid"]).alias("line")))
