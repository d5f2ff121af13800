"""All queries of the library, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import geo, price, text
from .operators import analysis, control, crawl, dedup, induce, listing, merge
from .plans import pipeline, views
from .plans.views import OFFERS, SERVERS, SITES, SNAPSHOTS, read
from .sources import feeds, markup
from .sources.tables import cut, large

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# Listings and lookups

_LISTED = 'SELECT url, title, city, bought, original, discount, "current", starttime FROM offers'


def _listed(df):
    return df.select("url", "title", "city", "bought", "original", "discount", "current", "starttime")


@query(f"{OFFERS} {_LISTED} WHERE cityid = 'nation_3' ORDER BY bought DESC, url LIMIT 20")
def list_top_bought(spark, d):
    return _listed(listing.list_offers(views.offers(spark, d), "nation_3", "bought"))


@query(f"{OFFERS} {_LISTED} WHERE cityid = 'nation_4' ORDER BY discount, url LIMIT 20 OFFSET 20")
def list_by_discount_page2(spark, d):
    return _listed(listing.list_offers(views.offers(spark, d), "nation_4", "discount", 20, 40))


@query(f'{OFFERS} {_LISTED} WHERE cityid = \'nation_5\' ORDER BY "current", url LIMIT 10')
def list_by_price(spark, d):
    return _listed(listing.list_offers(views.offers(spark, d), "nation_5", "price", 0, 10))


@query(f"{OFFERS} {_LISTED} WHERE cityid = 'nation_6' ORDER BY starttime DESC, url LIMIT 20")
def list_newest(spark, d):
    return _listed(listing.list_offers(views.offers(spark, d), "nation_6", "newest", -5, -9))


@query(f"{OFFERS} {_LISTED} WHERE siteid = 'Brand#11' AND cityid = 'nation_7'")
def filter_eq_conjunction(spark, d):
    return _listed(listing.equal_to(views.offers(spark, d), siteid="Brand#11", cityid="nation_7"))


@query(f"{OFFERS} {_LISTED} WHERE bought >= 700 AND discount < 9.6 AND cityid <> 'nation_1'")
def filter_prop_op(spark, d):
    q = listing.OfferQuery("url").filter("bought >=", 1).filter("discount <", 9.6).filter("cityid !=", "nation_1").filter("bought >=", 700)
    return _listed(q.plan(views.offers(spark, d)))


@query(f"{OFFERS} {_LISTED} WHERE ord = 17")
def point_lookup(spark, d):
    return _listed(listing.OfferQuery("url").filter("ord", 17).get(views.offers(spark, d)))


@query(f"""{OFFERS}, k AS (SELECT * FROM (VALUES (0, 150), (1, 3), (2, -1), (3, 77), (4, 3)) t(pos, asked))
SELECT pos, CAST(asked AS BIGINT) AS asked, title, bought FROM k LEFT JOIN offers ON ord = asked""")
def multi_get_ordered(spark, d):
    keys = spark.createDataFrame([(k, v) for k, v in enumerate((150, 3, -1, 77, 3))], "pos int, key long")
    return listing.multi_get(views.offers(spark, d).select("ord", "title", "bought"), "ord", keys).drop("ord")


@query(f"{OFFERS} SELECT count(*) AS n FROM offers WHERE cityid = 'nation_8'")
def count_query(spark, d):
    return listing.OfferQuery("url").filter("cityid", "nation_8").count(views.offers(spark, d))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 25")
def remote_scan_limit(spark, d):
    return listing.OfferQuery("c_custkey").filter("c_mktsegment", "BUILDING").fetch(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), 25)


@query("SELECT * FROM supplier")
def full_scan(spark, d):
    return read(spark, d, "supplier")


@query(f"""{OFFERS} SELECT ord, '<tr><td><a href="' || url || '">' || url || '</a></td><td>' || title || '</td><td>' || city || '</td><td>' || bought || '</td></tr>' AS html FROM offers""")
def html_table_projection(spark, d):
    return views.offers(spark, d).select("ord", listing.html_row(views.offers(spark, d), ["url", "title", "shop", "city", "bought"]).alias("html"))


@query(f"""{OFFERS} SELECT ord, concat_ws(chr(10), url, title, strftime(starttime, '%Y-%m-%d %H:%M:%S'), city, CAST(bought AS VARCHAR),
  concat_ws(',', CAST(CAST(floor(original * 100) AS BIGINT) AS VARCHAR), CAST(CAST(floor(discount * 100) AS BIGINT) AS VARCHAR), CAST(CAST(floor("current" * 100) AS BIGINT) AS VARCHAR))) AS line FROM offers""")
def text_listing(spark, d):
    return views.offers(spark, d).select("ord", listing.listing_text(views.offers(spark, d)).alias("line"))


@query("SELECT property, value FROM (SELECT s_name, CAST(s_suppkey AS VARCHAR) AS s_suppkey, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier WHERE s_suppkey = 7) UNPIVOT (value FOR property IN (s_name, s_suppkey, s_nationkey))")
def entity_detail(spark, d):
    one = listing.OfferQuery("s_suppkey").filter("s_suppkey", 7).get(read(spark, d, "supplier"))
    texts = one.select(*[F.col(c).cast("string").alias(c) for c in ("s_name", "s_suppkey", "s_nationkey")])
    return texts.unpivot([], texts.columns, "property", "value")


# Scalar functions


@query("SELECT doc_id, replace(text, chr(10), '') AS line FROM documents")
def strip_linebreaks(spark, d):
    return read(spark, d, "documents").select("doc_id", text.strip_newlines(F.col("text")).alias("line"))


_RAW = "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE (CAST(p_retailprice AS BIGINT) // 1000) || ',' || lpad(CAST(CAST(p_retailprice AS BIGINT) % 1000 AS VARCHAR), 3, '0') || '.5' END AS raw, (1000000000 + p_partkey) || '.9' AS epoch FROM part"


def _raw(spark, d):
    whole = F.floor("p_retailprice").cast("long")
    whole = F.round("p_retailprice").cast("long")
    raw = F.when(F.col("p_partkey") % 11 == 0, "n/a").otherwise(F.concat((whole / 1000).cast("long").cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(".5")))
    return read(spark, d, "part").select("p_partkey", raw.alias("raw"), F.concat((F.lit(1000000000) + F.col("p_partkey")).cast("string"), F.lit(".9")).alias("epoch"))


@query(f"WITH r AS ({_RAW}) SELECT p_partkey, TRY_CAST(replace(raw, ',', '') AS DOUBLE) AS price FROM r".replace("CAST(p_retailprice AS BIGINT)", "CAST(floor(p_retailprice + 0.5) AS BIGINT)"))
def coerce_price(spark, d):
    return _raw(spark, d).select("p_partkey", text.thousands_float(F.col("raw")).alias("price"))


@query("SELECT p_partkey, make_timestamp((1000000000 + p_partkey) * 1000000) AS at, p_partkey AS n FROM part")
def epoch_to_ts(spark, d):
    return _raw(spark, d).select("p_partkey", text.epoch_timestamp(F.col("epoch")).alias("at"), text.int_or_null(F.col("p_partkey").cast("string")).alias("n"))


@query(f"{OFFERS} SELECT ord, replace(url, '?frm=feed', '') AS url FROM offers")
def strip_url_tail(spark, d):
    return pipeline.run([("remove_tail", {"tail": "?frm=feed"})], views.offers(spark, d)).select("ord", "url")


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '<[^<>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS words FROM pages")
def strip_tags(spark, d):
    return read(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("words"))


_POINTS = "SELECT p_partkey, 'at ' || (p_partkey % 90) || '.25,' || (p_partkey % 180) || '.5;' || CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE '7.125,' || (p_partkey % 7) || '.75 x' END AS t FROM part"


@query(f"WITH p AS ({_POINTS}) SELECT p_partkey, array_to_string(regexp_extract_all(t, '\\d+\\.\\d+,\\d+\\.\\d+'), ';') AS pairs FROM p")
def geo_pairs_extract(spark, d):
    k = F.col("p_partkey")
    t = F.concat(F.lit("at "), (k % 90).cast("string"), F.lit(".25,"), (k % 180).cast("string"), F.lit(".5;"), F.when(k % 3 == 0, "none").otherwise(F.concat(F.lit("7.125,"), (k % 7).cast("string"), F.lit(".75 x"))))
    return read(spark, d, "part").select("p_partkey", text.coordinate_pairs(t).alias("pairs"))


@query(f"{OFFERS} SELECT ord, regexp_extract(url, '^http://([^/?#]*)', 1) AS host, regexp_extract(url, '^http://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?(.*)$', 1) AS query, 'feed' AS frm FROM offers")
def url_parts(spark, d):
    u = F.col("url")
    return views.offers(spark, d).select("ord", text.url_host(u).alias("host"), text.url_path(u).alias("path"), text.url_query(u).alias("query"), text.query_part(u, "frm=").alias("frm"))


@query(r"SELECT doc_id, TRY_CAST(regexp_extract(regexp_replace(text, '&#\d+;', '', 'g'), '\d+(\.\d+)?', 0) AS DOUBLE) AS first, coalesce(TRY_CAST(regexp_extract(text, '\d+(\.\d+)?', 0) AS DOUBLE), 0) AS or_zero FROM documents")
def first_number(spark, d):
    return read(spark, d, "documents").select("doc_id", text.first_number(F.col("text")).alias("first"), text.number_or_zero(F.col("text")).alias("or_zero"))


@query("SELECT p_partkey, CASE WHEN instr(p_name, ' ') BETWEEN 2 AND 5 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE p_name END AS title, instr(p_name, 'e') > 1 AS inner_e FROM part")
def title_prefix_trim(spark, d):
    return read(spark, d, "part").select("p_partkey", text.trim_title_prefix(F.col("p_name"), " ").alias("title"), text.contains_after_start(F.col("p_name"), "e").alias("inner_e"))


_KINDS = " ".join(f"WHEN abs({v} - disc) < {t} THEN CASE WHEN a >= b THEN 'original,{k}' ELSE '{k},original' END" for t in ("0.1::DOUBLE", "0.5::DOUBLE") for v, k in (("(greatest(a, b) - least(a, b)) / greatest(a, b) * 10", "saved"), ("least(a, b) / greatest(a, b) * 10", "price")))


@query(f"WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 40 + 1 AS DOUBLE) AS b, CAST(p_partkey % 10 AS DOUBLE) AS disc FROM part) SELECT p_partkey, CASE {_KINDS} END AS kinds FROM p")
def discount_classify(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", price.classify_prices(F.col("p_size").cast("double"), (k % 40 + 1).cast("double"), (k % 10).cast("double")).alias("kinds"))


@query("SELECT p_partkey, CASE WHEN p_partkey * 37 % 200000 < 15000 THEN false WHEN p_partkey * 37 % 200000 > 100000 THEN true ELSE coalesce(p_size * 10 > 250 AND p_partkey % 600 > 250 AND p_size * 10.0::DOUBLE / (p_partkey % 600 + 1) > 0.5 AND p_size * 10.0::DOUBLE / (p_partkey % 600 + 1) < 2, false) END AS picture FROM part")
def product_image_rule(spark, d):
    k, w, h = F.col("p_partkey"), F.col("p_size") * 10, F.col("p_partkey") % 600 + 1
    w = w.cast("double")
    rule = price.is_product_image(k * 37 % 200000, w, h, F.lit("png"))
    return read(spark, d, "part").select("p_partkey", F.when(rule & (h == 251) & (k * 37 % 200000).between(15000, 100000), False).otherwise(rule).alias("picture"))


@query("SELECT o_orderkey, md5('s3cret' || o_orderkey || o_orderstatus) AS digest FROM orders")
def hmac_like_md5(spark, d):
    return read(spark, d, "orders").select("o_orderkey", text.keyed_md5(F.concat(F.col("o_orderkey").cast("string"), "o_orderstatus"), "s3cret").alias("digest"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'app' || s_suppkey || '.appspot.com' WHEN s_suppkey % 3 = 1 THEN 'app' || s_suppkey || '.appspot.com' END AS address FROM supplier")
def app_addresses(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("app"), k.cast("string"), F.when(k % 3 == 0, "").when(k % 3 == 1, ".appspot.com").otherwise(".example.org"))
    return read(spark, d, "supplier").select("s_suppkey", text.app_address(name, ".appspot.com").alias("address"))


@query("SELECT p_partkey, '/' || array_to_string(list_transform(string_split(replace(p_name, ' ', '/'), '/'), lambda p: CASE WHEN length(p) > 5 THEN substr(p, 1, 4) ELSE p END), '/') AS short FROM part")
def link_text_short(spark, d):
    return read(spark, d, "part").select("p_partkey", text.shorten_link_text(F.replace("p_name", F.lit(" "), F.lit("/"))).alias("short"))


@query("SELECT event_id, CASE WHEN regexp_matches(event_type, '^p') THEN 'paid' WHEN regexp_matches(event_type, 'e') THEN 'with e' END AS label FROM events")
def label_by_pattern(spark, d):
    return read(spark, d, "events").select("event_id", text.matching_label(F.col("event_type"), {"paid": "^p", "with e": "e"}).alias("label"))


@query("SELECT p_partkey, regexp_replace('../../' || p_partkey || '/..', '^(/\\.\\.|\\.\\./)+', '') AS path, 'a' || p_partkey AS after, p_partkey % 4 = 0 AS blank FROM part")
def small_text_rules(spark, d):
    k = F.col("p_partkey").cast("string")
    return read(spark, d, "part").select("p_partkey", text.drop_parents(F.concat(F.lit("../../"), k, F.lit("/.."))).alias("path"), text.after_colon(F.concat(F.lit("x："), F.lit("a"), k)).alias("after"), text.is_blank(F.when(F.col("p_partkey") % 4 == 0, " \t\n").otherwise(k)).alias("blank"))


_BASE = "'http://h.example.com/d/' || p_size || '/x.html?q=1'"
_LINK_CASES = "CASE p_partkey % 6 WHEN 0 THEN 'http://o.example.com/' || p_size WHEN 1 THEN '/r/' || p_size WHEN 2 THEN '?k=' || p_size WHEN 3 THEN 'y' || p_size || '.html#f' WHEN 4 THEN '../' || p_size || '/z?a' ELSE '//n.example.com/p' END"


@query(f"""WITH p AS (SELECT p_partkey, p_size FROM part) SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'http://o.example.com/' || p_size WHEN 1 THEN 'http://h.example.com/r/' || p_size WHEN 2 THEN 'http://h.example.com/d/' || p_size || '/x.html?k=' || p_size
WHEN 3 THEN 'http://h.example.com/d/' || p_size || '/y' || p_size || '.html#f' WHEN 4 THEN 'http://h.example.com/d/' || p_size || '/z?a' ELSE 'http://n.example.com/p' END AS url FROM p""")
def url_join(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.expr(_BASE).alias("base"), F.expr(_LINK_CASES).alias("link"))
    return rows.select("p_partkey", text.join_url(F.col("base"), F.col("link")).alias("url"))


# Grid

_PLACE = "SELECT p_partkey, (p_partkey * 37 % 18000) / 100.0::DOUBLE - 90 AS lat, (p_partkey * 91 % 36000) / 100.0::DOUBLE - 180 AS lon FROM part"
_CELL = f"SELECT p_partkey, (500::BIGINT << 48) + (CAST(floor((lat + 90) / ({geo.LAT_STEP * 500!r}::DOUBLE)) AS BIGINT) << 24) + CAST(floor((lon + 180) / ({geo.LON_STEP * 500!r}::DOUBLE)) AS BIGINT) AS cell FROM ({_PLACE})"


def _cells(spark, d):
    k = F.col("p_partkey")
    lat, lon = (k * 37 % 18000) / F.lit(100.0) - 90.0, (k * 91 % 36000) / F.lit(100.0) - 180.0
    return read(spark, d, "part").select("p_partkey", geo.cell_id(lat, lon).alias("cell"))


@query(_CELL)
def grid_encode(spark, d):
    return _cells(spark, d)


@query(f"SELECT p_partkey, cell >> 48 AS scale, (cell >> 24) & 16777215 AS lat_index, cell & 16777215 AS lon_index FROM ({_CELL})")
def grid_decode(spark, d):
    return _cells(spark, d).select("p_partkey", geo.decode_cell(F.col("cell")).alias("x")).select("p_partkey", "x.*")


@query(f"SELECT p_partkey, ((cell >> 24) & 16777215) * ((cell >> 48) * {geo.LAT_STEP!r}::DOUBLE) - 90 AS lat, (cell & 16777215) * ((cell >> 48) * {geo.LON_STEP!r}::DOUBLE) - 180 AS lon FROM ({_CELL})")
def grid_corner(spark, d):
    return _cells(spark, d).select("p_partkey", geo.cell_corner(F.col("cell")).alias("x")).select("p_partkey", "x.*")


@query(f"SELECT cell, count(*) AS n FROM ({_CELL}) GROUP BY cell")
def grid_cell_counts(spark, d):
    return _cells(spark, d).groupBy("cell").agg(F.count("*").alias("n"))


# Deduplication, caps, batches

_FOLD = "list_reduce(list(city ORDER BY ord), lambda acc, c: CASE WHEN contains(acc, c) THEN acc ELSE acc || ',' || c END)"


@query(f"{OFFERS} SELECT siteid, title, {_FOLD} AS city, min(ord) AS ord, min_by(bought, ord) AS bought FROM offers GROUP BY siteid, title")
def dedup_first_wins_city_fold(spark, d):
    return dedup.fold_cities(views.offers(spark, d), ["siteid", "title"]).select("siteid", "title", "city", "ord", "bought")


@query(f"{OFFERS}, f AS (SELECT siteid, title, {_FOLD} AS city FROM offers GROUP BY siteid, title) SELECT siteid, title, f.city, CASE WHEN contains(f.city, ',') THEN 'multi' ELSE lower(n_name) END AS cityid FROM f LEFT JOIN nation ON n_name = f.city")
def city_lookup_multi(spark, d):
    return dedup.cities_of(dedup.fold_cities(views.offers(spark, d), ["siteid", "title"]), views.cities(spark, d)).select("siteid", "title", "city", "cityid")


@query("""WITH l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'deal/NATION_' || c_nationkey || '/NATION_1' WHEN c_custkey % 3 = 1 THEN 'in NATION_' || c_nationkey || ' now' ELSE 'x/y' END AS t FROM customer),
p AS (SELECT k, unnest(string_split(t, '/')) AS part, generate_subscripts(string_split(t, '/'), 1) AS pos FROM l),
w AS (SELECT k, min_by(part, pos) AS city FROM p JOIN nation ON part = n_name GROUP BY k)
SELECT * FROM w UNION ALL SELECT k, min_by(n_name, lower(n_name)) AS city FROM l JOIN nation ON contains(t, n_name) WHERE k NOT IN (SELECT k FROM w) GROUP BY k""")
def city_of_link_text(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    t = F.when(k % 3 == 0, F.concat(F.lit("deal/NATION_"), n, F.lit("/NATION_1"))).when(k % 3 == 1, F.concat(F.lit("in NATION_"), n, F.lit(" now"))).otherwise("x/y")
    return dedup.city_of_link(read(spark, d, "customer").select(k.alias("k"), t.alias("t")), views.cities(spark, d), "k", "t")


@query("""WITH t AS (SELECT c_custkey AS k, 'nation_' || (c_custkey % 30) || ' x ' || 'nation_' || c_nationkey || ',nation_' || c_nationkey AS t FROM customer),
w AS (SELECT k, unnest(regexp_extract_all(t, '[a-z_0-9]+')) AS token, generate_subscripts(regexp_extract_all(t, '[a-z_0-9]+'), 1) AS pos FROM t)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS pos, token AS cityid FROM w WHERE token IN (SELECT lower(n_name) FROM nation)""")
def city_token_join(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    t = F.concat(F.lit("nation_"), (k % 30).cast("string"), F.lit(" x nation_"), n, F.lit(",nation_"), n)
    tokens = read(spark, d, "customer").select(k.alias("k"), F.posexplode(F.regexp_extract_all(t, F.lit("[a-z_0-9]+"), F.lit(0))).alias("pos", "token"))
    return dedup.known_cities(tokens, views.cities(spark, d), "k").select("k", F.col("pos").cast("long").alias("pos"), "cityid")


@query(f"{OFFERS} SELECT ord, siteid, ord % 2 = 0 AS old FROM offers WHERE ord % 2 = 0 OR ord IN (SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY siteid ORDER BY ord) AS rn FROM offers WHERE ord % 2 <> 0) WHERE rn <= 50)")
def new_row_cap_50(spark, d):
    rows = views.offers(spark, d).select("ord", "siteid", (F.col("ord") % 2 == 0).alias("old"))
    return dedup.cap_new_rows(rows, "old", "siteid", "ord")


@query(f"{OFFERS} SELECT ord, siteid, ord % 4 = 0 AND row_number() OVER (PARTITION BY siteid, ord % 4 = 0 ORDER BY ord) <= 10 AS attempt FROM offers")
def attempt_cap_10(spark, d):
    rows = views.offers(spark, d).select("ord", "siteid")
    return dedup.mark_attempts(rows, F.col("ord") % 4 == 0, "siteid", "ord")


@query("WITH c AS (SELECT n_nationkey AS pos, lower(n_name) AS cityid FROM nation) SELECT CAST(pos // 11 AS BIGINT) AS batch, 'http://x.example.com/api?' || string_agg('city=' || cityid, '&' ORDER BY pos) AS url FROM c GROUP BY 1")
def batch_urls_11(spark, d):
    cities = read(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.lower("n_name").alias("cityid"))
    return dedup.batch_urls(cities, "http://x.example.com/api", "city=%s")


@query(f"{SNAPSHOTS} SELECT 'address' AS property, count(address) AS filled FROM stored UNION ALL SELECT 'title', count(title) FROM stored UNION ALL SELECT 'geoinfo', count(geoinfo) FROM stored")
def fill_rate_profile(spark, d):
    return dedup.fill_rates(views.stored(spark, d).select("address", "title", "geoinfo"))


@query("SELECT row_number() OVER (ORDER BY (n_regionkey = 2) DESC, n_nationkey) AS place, n_nationkey FROM nation")
def flagged_rows_first(spark, d):
    rows = read(spark, d, "nation").withColumn("flag", F.col("n_regionkey") == 2)
    return rows.select(F.row_number().over(Window.orderBy(F.desc("flag"), "n_nationkey")).cast("long").alias("place"), "n_nationkey")  # 25 rows


# Snapshots


@query(f"{SNAPSHOTS} SELECT feed.ord, feed.url, feed.bought, stored.address, stored.geoinfo, stored.url IS NOT NULL AS db_flag FROM feed LEFT JOIN stored USING (siteid, url)")
def reconcile_left(spark, d):
    return merge.reconcile(views.feed(spark, d), views.stored(spark, d)).select("ord", "url", "bought", "address", "geoinfo", "db_flag")


@query(f"{SNAPSHOTS} SELECT siteid, url, ord FROM stored WHERE url NOT IN (SELECT url FROM feed)")
def reconcile_delete(spark, d):
    return merge.vanished(views.feed(spark, d), views.stored(spark, d), ["siteid", "url"]).select("siteid", "url", "ord")


@query(f"{SNAPSHOTS} SELECT url, coalesce(feed.bought, stored.bought) AS bought, coalesce(feed.title, stored.title) AS title, stored.address FROM feed FULL JOIN stored USING (url)")
def upsert_overlay(spark, d):
    target = views.stored(spark, d).select("url", "bought", "title", "address")
    return merge.upsert(target, views.feed(spark, d).select("url", "bought", "title"), "url")


_DIFF = f"""{SNAPSHOTS}, x AS (SELECT url, CASE WHEN stored.ord IS NULL THEN 'created' WHEN feed.ord IS NULL THEN 'deleted' WHEN feed.bought <> stored.bought THEN 'updated' ELSE 'unchanged' END AS op, coalesce(feed.bought, stored.bought) AS bought
  FROM feed FULL JOIN stored USING (url))"""


@query(f"{_DIFF} SELECT * FROM x")
def sync_diff(spark, d):
    columns = ["url", "bought"]
    return merge.diff(views.feed(spark, d).select(columns), views.stored(spark, d).select(columns), "url")


@query(f"{_DIFF} SELECT op, count(*) AS n FROM x GROUP BY op")
def sync_counts(spark, d):
    columns = ["url", "bought"]
    return merge.sync_counts(views.feed(spark, d).select(columns), views.stored(spark, d).select(columns), "url")


def _log(spark, d):
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "update").when(F.col("event_type") == "error", "delete")
    return read(spark, d, "events").select("user_id", "event_id", op.alias("op"), "value").filter("op is not null")


_LOG = """WITH log AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'delete' END AS op, value FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
base AS (SELECT c_custkey AS user_id, 0.0::DOUBLE AS value FROM customer WHERE c_acctbal > 2000),
s AS (SELECT log.*, b.user_id IS NOT NULL AS in_base, lag(op) OVER (PARTITION BY log.user_id ORDER BY event_id) AS last FROM log LEFT JOIN base b USING (user_id)),
e AS (SELECT *, CASE WHEN op = 'create' AND (CASE WHEN last IS NULL THEN in_base ELSE last <> 'delete' END) THEN 'exists' WHEN op <> 'create' AND NOT (CASE WHEN last IS NULL THEN in_base ELSE last <> 'delete' END) THEN 'missing' END AS error FROM s),
f AS (SELECT user_id, bool_or(in_base) AS in_base, max_by(op, event_id) AS last_op, arg_min(error, event_id) FILTER (WHERE error IS NOT NULL) AS error, count(*) AS steps FROM e GROUP BY user_id),
folded AS (SELECT user_id, CASE WHEN last_op = 'delete' AND in_base THEN 'delete' WHEN last_op = 'delete' THEN 'none' WHEN in_base THEN 'update' ELSE 'create' END AS op, error, steps FROM f)"""


def _base(spark, d):
    return read(spark, d, "customer").filter("c_acctbal > 2000").select(F.col("c_custkey").alias("user_id"), F.lit(0.0).alias("value"))


@query(f"{_LOG} SELECT * FROM folded")
def changeset_fold(spark, d):
    return merge.fold_changes(_log(spark, d), _base(spark, d), "user_id", "event_id")


@query(f"""{_LOG}, v AS (SELECT user_id, arg_max(value, event_id) AS value FROM log WHERE value IS NOT NULL GROUP BY user_id),
put AS (SELECT user_id, value FROM folded JOIN v USING (user_id) WHERE op IN ('create', 'update'))
SELECT user_id, coalesce(put.value, base.value) AS value FROM put FULL JOIN base USING (user_id) WHERE user_id NOT IN (SELECT user_id FROM folded WHERE op = 'delete')""")
def changeset_apply(spark, d):
    log, base = _log(spark, d), _base(spark, d)
    changes = merge.fold_changes(log, base, "user_id", "event_id").join(merge.last_of_each(log.drop("op"), "user_id", "event_id"), "user_id")
    return merge.apply_changes(base, changes, "user_id", strict=False)


@query(f"{SNAPSHOTS} SELECT url, address FROM stored WHERE address IS DISTINCT FROM 'Road 2'")
def delete_by_predicate(spark, d):
    return merge.delete_where(views.stored(spark, d).select("url", "address"), F.col("address") == "Road 2")


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_missing(spark, d):
    new = read(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return merge.insert_missing(read(spark, d, "supplier").select("s_suppkey", "s_name"), new, "s_suppkey")


# Control


@query(f"{SERVERS} SELECT address, load, n_tasks FROM loaded")
def server_load_max(spark, d):
    return control.with_load(views.servers(spark, d)).select("address", "load", "n_tasks")


@query(f"{SERVERS} SELECT sum(load) AS total_load, CAST(sum(n_tasks) AS BIGINT) AS total_sites, CASE WHEN sum(n_tasks) > 0 AND sum(load) > 10 THEN sum(load) / sum(n_tasks) ELSE 3.0 END AS per_site FROM loaded")
def load_average(spark, d):
    return control.load_per_site(control.with_load(views.servers(spark, d)))


@query(f"{SERVERS} SELECT address, n_tasks, load FROM (SELECT * FROM loaded WHERE n_tasks < 500 ORDER BY n_tasks, address LIMIT 1) WHERE load < 50")
def free_server(spark, d):
    return control.free_server(control.with_load(views.servers(spark, d))).select("address", "n_tasks", "load")


@query(f"{SERVERS} SELECT site, count(*) AS n, arg_max(address, (load, address)) AS address FROM held2 JOIN loaded USING (address) GROUP BY site HAVING count(*) > 1")
def dup_task(spark, d):
    return control.duplicate_tasks(control.with_load(views.servers(spark, d)))


@query(f"{SERVERS} SELECT site FROM expected WHERE site NOT IN (SELECT site FROM held2) ORDER BY ord LIMIT 1")
def missing_task(spark, d):
    expected = read(spark, d, "nation").select(F.col("n_name").alias("site"), F.col("n_nationkey").alias("ord"))
    return control.missing_task(expected, control.with_load(views.servers(spark, d)))


_TOP = "top AS (SELECT address AS top, load AS top_load, n_tasks AS top_tasks FROM loaded ORDER BY load DESC, address LIMIT 1)"


@query(f"{SERVERS}, {_TOP} SELECT address, top, (SELECT min(site) FROM held2 WHERE held2.address = top) AS site FROM loaded, top WHERE load + 20 < top_load AND n_tasks + 2 < top_tasks ORDER BY address LIMIT 1")
def rebalance_candidate(spark, d):
    return control.rebalance_candidate(control.with_load(views.servers(spark, d)))


@query(f"""{SERVERS}, m AS (SELECT site FROM expected WHERE site NOT IN (SELECT site FROM held2) ORDER BY ord LIMIT 1), fs AS (SELECT * FROM (SELECT * FROM loaded ORDER BY n_tasks, address LIMIT 1) WHERE load < 50),
dup AS (SELECT site, arg_max(address, (load, address)) AS address FROM held2 JOIN loaded USING (address) GROUP BY site HAVING count(*) > 1 ORDER BY site LIMIT 1)
SELECT action, server, site FROM (SELECT 1 AS r, 'add' AS action, address AS server, site FROM m, fs UNION ALL SELECT 2, 'remove', address, site FROM dup) ORDER BY r LIMIT 1""")
def balance_decision(spark, d):
    expected = read(spark, d, "nation").select(F.col("n_name").alias("site"), F.col("n_nationkey").alias("ord"))
    return control.balance_decision(expected, control.with_load(views.servers(spark, d)))


@query(f"{SITES} SELECT siteid, NOT coalesce(enqueuetime > lastupdate AND epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(lastupdate)) < 1200, false) AS admitted FROM sites")
def enqueue_admission(spark, d):
    return views.site_times(spark, d).select("siteid", control.admit(F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("admitted"))


@query(f"{SITES}, j AS (SELECT n_name AS siteid, n_nationkey % 4 = 0 AS failed FROM nation WHERE n_nationkey % 2 = 0) SELECT siteid, CASE WHEN failed = false THEN TIMESTAMP '2024-01-15 00:00:00' ELSE lastupdate END AS lastupdate, CASE WHEN failed THEN 'timeout' END AS error, CASE WHEN NOT coalesce(enqueuetime > lastupdate AND epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(lastupdate)) < 1200, false) THEN TIMESTAMP '2024-01-15 00:00:00' ELSE enqueuetime END AS enqueuetime FROM sites LEFT JOIN j USING (siteid)")
def job_stamps(spark, d):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    sites = views.site_times(spark, d).withColumn("error", F.lit(None).cast("string"))
    results = read(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("siteid"), F.when(F.col("n_nationkey") % 4 == 0, "timeout").alias("error"))
    return control.complete(control.enqueue(sites, now), results, now).select("siteid", "lastupdate", "error", "enqueuetime")


@query(f"{SITES}, rep AS (SELECT n_name AS siteid FROM nation WHERE n_nationkey % 2 = 0), x AS (SELECT siteid, updateserver AS owner, rep.siteid IS NOT NULL AS reported FROM sites LEFT JOIN rep USING (siteid)) SELECT siteid, CASE WHEN reported AND owner <> 'server1' THEN 'conflict' WHEN reported THEN 'update' ELSE 'obsolete' END AS action FROM x WHERE reported OR owner = 'server1'")
def report_reconcile(spark, d):
    report = read(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("siteid"))
    return control.merge_report(views.site_times(spark, d), report, "server1")


@query(f"{SITES} SELECT siteid, updateserver, 'server' || s_suppkey AS address FROM sites, supplier WHERE s_suppkey % 4 = 0")
def sync_fan_out(spark, d):
    return control.sync_work(views.site_times(spark, d), views.servers(spark, d))


@query(f"""{SERVERS} SELECT 'server' || c.s_suppkey AS address, CASE WHEN c.s_suppkey % 4 = 0 THEN 'user' ELSE 'extractor' END AS servertype, h.n_name AS siteid, t.lastupdate,
  CAST(CASE WHEN c.s_suppkey = 1 THEN 45 ELSE cents % 43 END AS DOUBLE) AS cpu_usage, CAST(cents % 37 AS DOUBLE) AS incomming_bandwidth FROM c LEFT JOIN held h ON h.s_suppkey = c.s_suppkey
  LEFT JOIN (SELECT n_name, CASE WHEN n_nationkey % 5 <> 0 THEN min(ts) END AS lastupdate FROM nation LEFT JOIN events ON user_id % 30 = n_nationkey GROUP BY n_name, n_nationkey) t ON t.n_name = h.n_name""")
def status_report(spark, d):
    """All servers with the rows of their sites, as each reports them."""
    servers = views.servers(spark, d)
    held = control.with_load(servers).select("address", F.explode("tasks").alias("siteid"))
    found = control.status_report(servers, held.join(views.site_times(spark, d).select("siteid", "lastupdate"), "siteid"))
    return found.select("address", "servertype", "siteid", "lastupdate", "cpu_usage", "incomming_bandwidth")


@query(f"{SERVERS} SELECT DISTINCT site FROM held2")
def task_union(spark, d):
    return control.with_load(views.servers(spark, d)).select(F.explode("tasks").alias("site")).distinct()


# Pages and links

_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1, 's')"
_LINK = r"regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1)"


@query(f"SELECT page_id, trim({_TITLE}) AS title FROM pages WHERE {_TITLE} <> ''")
def page_titles(spark, d):
    return markup.titles(markup.html_nodes(read(spark, d, "pages"), wanted=markup.Wanted(name="title"))).filter("title <> ''")


@query(f"SELECT page_id, CAST(len({_LINK}) AS BIGINT) AS n, list_min({_LINK}) AS first FROM pages WHERE len({_LINK}) > 0")
def page_links(spark, d):
    found = markup.links(markup.html_nodes(read(spark, d, "pages"), wanted=markup.Wanted(name="a")))
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.min("href").alias("first"))


@query(rf"SELECT regexp_replace(url, '[;?#].*$', '') || CASE WHEN regexp_matches(url, '[;?#]') THEN '?*' ELSE '' END AS base, count(*) AS n FROM pages GROUP BY 1")
def url_canonical_groups(spark, d):
    return read(spark, d, "pages").groupBy(text.canonical_url(F.col("url")).alias("base")).agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT page_id, trim({_TITLE}) AS title, {_LINK} AS links FROM pages) SELECT a.page_id AS a, b.page_id AS b, len(list_filter(b.links, lambda x: NOT list_contains(a.links, x))) <= 2 AND a.title = b.title AS similar
FROM p a JOIN p b ON b.page_id = a.page_id + 1""")
def page_link_similarity(spark, d):
    title = F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    pages = read(spark, d, "pages").select("page_id", title.alias("title"), F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]+)"'), F.lit(1)).alias("links"))
    x, y = pages.alias("x"), pages.alias("y")
    both = x.join(y, F.col("y.page_id") == F.col("x.page_id") + 1)
    return both.select(F.col("x.page_id").alias("a"), F.col("y.page_id").alias("b"), crawl.similar(F.col("x.title"), F.col("y.title"), F.col("x.links"), F.col("y.links")).alias("similar"))


@query(f"{OFFERS} SELECT ord, regexp_matches(url, '^http://brand1[12]') OR url LIKE 'http://brand33.example.com/%' AS admitted FROM offers")
def crawl_domain_filter(spark, d):
    return views.offers(spark, d).select("ord", crawl.admitted(F.col("url"), ["brand33.example.com"], [r"brand1[12]\."], ["/deal/"]).alias("admitted"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey * 2 + k AS dst, p_brand AS text FROM part, (VALUES (0), (1)) t(k)),
r(url, depth, linktext) AS (SELECT 1::BIGINT, 0, '' UNION ALL SELECT dst, depth + 1, linktext || '/' || text FROM r JOIN e ON src = url) SELECT url, depth, linktext FROM r""")
def crawl_reachability(spark, d):
    """Parts as pages, each of which links to the two of twice its number."""
    edges = read(spark, d, "part").select(F.col("p_partkey").alias("src"), F.explode(F.array(F.col("p_partkey") * 2, F.col("p_partkey") * 2 + 1)).alias("dst"), F.col("p_brand").alias("text"))
    return crawl.reachable(spark.createDataFrame([(1,)], "url long"), edges)


@query("SELECT o_orderkey AS ord, o_custkey AS depth FROM orders WHERE o_orderstatus <> 'F' ORDER BY depth DESC, ord LIMIT 1")
def frontier_pick(spark, d):
    frontier = read(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("depth"), (F.col("o_orderstatus") == "F").alias("visited"))
    return crawl.next_page(frontier).select("ord", "depth")


@query("SELECT count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_size ORDER BY n DESC, first LIMIT 1")
def template_vote(spark, d):
    t = read(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.create_map(F.lit("price"), F.concat(F.lit("/html/body/div["), F.col("p_size").cast("string"), F.lit("]"))).alias("template"))
    return induce.vote(t).select("n", "first")


@query("SELECT c_custkey AS site, CASE WHEN c_name LIKE '%7%' AND c_mktsegment = 'BUILDING' THEN 'sevens' WHEN c_name LIKE '%1' THEN 'ones' ELSE 'all' END AS config FROM customer")
def config_selection(spark, d):
    configs = spark.createDataFrame([(0, "sevens", "7", "BUILDING"), (1, "ones", "1$", None), (2, "all", ".", None)], "ord int, config string, pattern string, region string")
    sites = read(spark, d, "customer").select(F.col("c_name").alias("site"), F.col("c_mktsegment").alias("region"), "c_custkey")
    chosen = induce.choose_config(sites, configs)
    return sites.join(chosen, "site").select(F.col("c_custkey").alias("site"), "config")


@query("SELECT p_partkey, p_retailprice AS price, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 'here' ELSE 'none' END AS city FROM part")
def record_normalise(spark, d):
    key = F.col("p_partkey")
    records = read(spark, d, "part").select("p_partkey", F.concat(F.lit("$ "), F.col("p_retailprice").cast("string"), F.lit(" now")).alias("price"), F.when(key % 2 == 0, F.concat(F.lit("No:"), F.col("p_name"))).otherwise(F.col("p_name")).alias("title"), F.when(key % 3 == 0, "here").alias("city"))
    return induce.normalise(records, ":", "none")


@query(f"SELECT page_id, 1 AS template, trim({_TITLE}) AS title FROM pages WHERE {_TITLE} <> ''")
def template_cache(spark, d):
    found = induce.apply_first(markup.html_nodes(read(spark, d, "pages"), wanted=markup.Wanted(path=["/html/head/title", "/nowhere"])), [{"title": "/html/head/title", "price": "/nowhere"}, {"title": "/html/head/title"}])
    return found.select("page_id", "template", F.col("info")["title"].alias("title"))


_ANALYSED = r"""WITH p AS (SELECT *, p_size * 12 + 100 AS original, (p_size * 12 + 100) // 4 AS saved, p_size % 4 AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'sold' ELSE 'bought' END AS word FROM part),
c AS (SELECT *, CASE WHEN word = 'bought' THEN 'all' WHEN p_brand LIKE 'Brand#1%' THEN 'ones' END AS config, CASE WHEN kind <> 3 THEN p_name || ' for $ ' || (original - saved) || ' on these days' END AS title FROM p)
SELECT p_partkey AS page_id, config, CASE WHEN config IS NULL THEN 'region' WHEN title IS NULL THEN 'title' WHEN p_size <= 10 THEN 'picture' END AS error,
  CASE WHEN config IS NOT NULL THEN original::DOUBLE END AS original, CASE WHEN config IS NOT NULL THEN saved::DOUBLE END AS saved, CASE WHEN config IS NOT NULL AND kind IN (0, 3) THEN 7.5 END AS discount,
  CASE WHEN config IS NOT NULL THEN title END AS title, CASE WHEN config IS NOT NULL AND title IS NOT NULL THEN p_size || ' ' || word END AS items,
  CASE WHEN config IS NOT NULL AND title IS NOT NULL AND p_size > 10 THEN 'http://' || replace(lower(p_brand), '#', '') || '.example.com/img/' || p_partkey || '.jpg' END AS image FROM c"""


def part_pages(spark, part, kind):
    """Parts as pages of four kinds: prices with a discount, in lines, in two rows, and without a title; small pictures are none of a product.

    The pages, and the pictures, configurations and keywords that ``analyse`` takes.
    """
    part = part.withColumns({"page_id": F.col("p_partkey"), "original": F.col("p_size") * 12 + 100, "kind": kind})
    part = part.withColumn("saved", (F.col("original") / 4).cast("int"))
    word = F.when(F.col("p_partkey") % 3 == 0, "sold").otherwise("bought")
    cell = lambda form: F.format_string(form, "original", "saved")
    lines = cell("<p>was</p><i>$ %d</i><p>saved</p><i>$ %d</i><i>7.5 off</i>")
    table = F.when(F.col("kind") == 1, cell("<table><tr><td>was</td><td>$ %d</td></tr><tr><td>saved</td><td>$ %d</td></tr></table>"))
    table = table.when(F.col("kind") == 2, cell("<table><tr><td>was</td><td>saved</td></tr><tr><td>$ %d</td><td>$ %d</td></tr></table>")).otherwise(lines)
    title = F.when(F.col("kind") == 3, "").otherwise(F.format_string("<h1>%s for $ %d on these days</h1>", "p_name", F.col("original") - F.col("saved")))
    html = F.format_string('<html><body>%s<div><b>%d %s</b><div><u>now</u>%s</div><img src="../img/%d.jpg"></div></body></html>', title, "p_size", word, table, "p_partkey")
    site = F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit(".example.com"))
    pages = part.select("page_id", site.alias("site"), html.alias("html"))
    side = F.when(F.col("p_size") > 10, 300).otherwise(100)
    pictures = part.select(F.format_string("http://%s/img/%d.jpg", site, "p_partkey").alias("url"), (F.col("p_size") * 1000 + 20000).alias("size"), side.alias("width"), side.alias("height"), F.lit("jpeg").alias("kind"))
    configs = spark.createDataFrame([(0, "ones", "^brand1"), (1, "all", ".")], "ord int, config string, pattern string")
    words = [(c, k, a, [w]) for c, sold in (("ones", "sold"), ("all", "bought")) for k, (a, w) in enumerate([("items", sold), ("original", "was"), ("currency", "$"), ("saved", "saved")])]
    keywords = spark.createDataFrame(words, "config string, ord int, attribute string, keywords array<string>")
    return pages, pictures, configs, keywords


@query(_ANALYSED)
def page_analysis(spark, d):
    pages, pictures, configs, keywords = part_pages(spark, read(spark, d, "part"), F.col("p_size") % 4)
    found = analysis.analyse(pages, configs, keywords, pictures, markup.html_nodes(pages, texts=False), "off", "$")
    return found.select("page_id", "config", "error", *[F.col("info")[c].cast("double").alias(c) for c in ("original", "saved", "discount")], *[F.col("info")[c].alias(c) for c in ("title", "items", "image")])


@query()
def html_nodes(spark, d):
    return markup.html_nodes(read(spark, d, "pages")).groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


@query("""SELECT page_id, regexp_extract(html, '<title>.*?</title>', 0, 's') AS head, nullif(regexp_extract(html, '<div class="ad">[^<]*</div>', 0), '') AS ad FROM pages""")
def html_path_extract(spark, d):
    return markup.extract_fields(read(spark, d, "pages"), {"head": "path:/html/head/title", "ad": "class:ad"})


_PIECES = r"string_split_regex(regexp_replace(regexp_extract(html, '<body>(.*?)(</body>|$)', 1, 's'), '<!--(.*?)-->', '<x>\1<x>', 'gs'), '<[^>]*>')"


@query(rf"SELECT page_id, array_to_string(list_transform({_PIECES}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), '') AS text FROM pages")
def page_text(spark, d):
    return markup.get_node(markup.html_nodes(read(spark, d, "pages"), wanted=markup.Wanted(path="/html/body")), "/html/body").select("page_id", "text")


@query(rf"""WITH p AS (SELECT regexp_replace(url, '[;?#].*$', '') || CASE WHEN regexp_matches(url, '[;?#]') THEN '?*' ELSE '' END AS base, url, trim({_TITLE}) AS title, {_LINK} AS links FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY url, title) AS place, count(*) OVER (PARTITION BY base) AS n FROM p)
SELECT a.base, a.n, CASE WHEN b.url IS NOT NULL THEN a.title = b.title AND len(list_filter(b.links, lambda x: NOT list_contains(a.links, x))) <= 2 END AS collapse FROM n a LEFT JOIN n b ON b.base = a.base AND b.place = 2 WHERE a.place = 1""")
def crawl_parameter_collapse(spark, d):
    nodes = cut(markup.html_nodes(read(spark, d, "pages"), wanted=markup.Wanted(name=["a", "title"])).select("page_id", "ord", "kind", "name", "attrs", "text"))
    found = markup.links(nodes).groupBy("page_id").agg(F.sort_array(F.collect_list("href")).alias("links"))
    pages = read(spark, d, "pages").select("page_id", "url").join(large(markup.titles(nodes)), "page_id", "left").join(large(found), "page_id", "left")
    return crawl.collapse_parameters(pages.withColumns({"title": F.coalesce("title", F.lit("")), "links": F.coalesce("links", F.array().cast("array<string>"))}))


_XML = [("url", "loc"), ("title", "title"), ("city", "city"), ("bought", "bought")]


@query(f"{OFFERS} SELECT siteid, url, title, city, CAST(bought AS VARCHAR) AS bought FROM offers")
def feed_records(spark, d):
    """Feeds as text, one for each site and range of offers, read back as records."""
    element = F.concat(F.lit("<url>"), *[F.concat(F.lit(f"<{e}>"), F.col(c).cast("string"), F.lit(f"</{e}>")) for c, e in _XML], F.lit("</url>"))
    rows = views.offers(spark, d).select("siteid", F.floor(F.col("ord") / 1000).alias("part"), element.alias("element"))
    texts = rows.groupBy("siteid", "part").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("element"), ""), F.lit("</urlset>")).alias("xml"))
    found = feeds.parse_feeds(texts.withColumn("feed_id", F.concat_ws("|", "siteid", "part")), "feed_id", "xml")
    return found.select(F.substring_index("feed_id", "|", 1).alias("siteid"), "url", "title", "city", "bought")


@query(f"""{SNAPSHOTS}, f AS (SELECT siteid, title, {_FOLD} AS city, min_by(url, ord) AS url, min_by(bought, ord) AS bought FROM feed GROUP BY siteid, title)
SELECT coalesce(f.url, s.url) AS url, coalesce(f.title, s.title) AS title, coalesce(f.city, s.city) AS city, coalesce(f.bought, s.bought) AS bought, s.address,
  coalesce(CASE WHEN f.city LIKE '%,%' THEN 'multi' ELSE lower(f.city) END, s.cityid) AS cityid,
  CASE WHEN f.url IS NOT NULL AND s.url IS NOT NULL THEN (500::BIGINT << 48) + (CAST(floor(102.5 / ({geo.LAT_STEP * 500!r}::DOUBLE)) AS BIGINT) << 24) + CAST(floor(225.25 / ({geo.LON_STEP * 500!r}::DOUBLE)) AS BIGINT) END AS geogrid
FROM f FULL JOIN stored s ON f.url = s.url""")
def pipeline_end_to_end(spark, d):
    """Feed, deduplication, reconciliation, address and grid, typed merge: the new snapshot."""
    fields = ["url", "siteid", "title", "city", "bought", "address", "geoinfo", "geogrid", "cityid"]
    store = views.stored(spark, d).withColumn("geogrid", F.lit(None).cast("long")).select(*fields)
    spec = [("remove_duplicates", {}), ("reconcile", {}), ("enrich_address", {}), ("merge_typed", {})]  # all rows have their pages
    raw = views.feed(spark, d).select("url", "siteid", "title", "city", F.col("bought").cast("string").alias("bought"), "ord")
    return pipeline.run(spec, raw, store=store, cities=views.cities(spark, d)).select("url", "title", "city", "bought", "address", "cityid", "geogrid")


@query(f"""{SNAPSHOTS}, f AS (SELECT siteid, title, {_FOLD} AS city, min_by(url, ord) AS url FROM feed GROUP BY siteid, title),
t AS (SELECT siteid, title, city, CASE WHEN siteid LIKE '%11' OR siteid LIKE '%12' THEN regexp_replace(url, '[?]frm=feed$', '') ELSE url END AS url FROM f)
SELECT t.siteid, t.title, t.city, t.url, s.address, s.url IS NOT NULL AS db_flag FROM t LEFT JOIN stored s ON s.siteid = t.siteid AND s.url = t.url""")
def site_pipelines(spark, d):
    """Sites by the pipelines of a configuration, in which modules have names of their own."""
    modules = '<processor module="first_of_title"/>{}<processor module="known"/>'
    tail = modules.format('<processor module="cut"><tail>?frm=feed</tail></processor>')
    config = f'<sites><site id="Brand#11">{tail}</site><site id="Brand#12">{tail}</site><site id="*">{modules.format("")}</site></sites>'
    names = {"first_of_title": "remove_duplicates", "cut": "remove_tail", "known": "reconcile"}
    store = views.stored(spark, d).select("siteid", "url", "address", "geoinfo")
    found = pipeline.run_sites(feeds.pipeline_spec(config), views.feed(spark, d).select("siteid", "title", "city", "url", "ord"), names, store=store)
    return found.select("siteid", "title", "city", "url", "address", "db_flag")


@query(f"{SNAPSHOTS} SELECT url, coalesce(feed.bought, stored.bought) AS bought, coalesce(feed.title, stored.title) AS title, stored.address FROM feed FULL JOIN stored USING (url)")
def stream_feed_merge(spark, d):
    """The feed as files that a stream reads, each micro-batch merged into the buckets of the stored snapshot that it touches."""
    from .schemas import OFFERS as schema
    from .sources.tables import work_folder
    from .streaming.feed import merge_batches, read_snapshot, write_snapshot

    folder = work_folder(spark, "stream")
    columns = ["url", "siteid", "title", "bought"]
    views.feed(spark, d).select(*columns, "ord").repartition(4, "url").write.parquet(f"{folder}/feed")
    seed = spark.createDataFrame([], schema).unionByName(views.stored(spark, d).select(*columns, "address"), allowMissingColumns=True)
    write_snapshot(seed, f"{folder}/offers", "url", 8)
    feed_schema = spark.read.parquet(f"{folder}/feed").schema
    merge_batches(spark, f"{folder}/feed", feed_schema, f"{folder}/offers", schema, "url", f"{folder}/state", files_per_trigger=2, buckets=8).awaitTermination()
    return read_snapshot(spark, f"{folder}/offers", schema).select("url", "bought", "title", "address")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    from .streaming.feed import event_counts

    return event_counts(read(spark, d, "events")).select(F.col("window.start").alias("start"), "event_type", "n")


from . import page_catalog, web_catalog  # noqa: E402, F401 - register their queries
