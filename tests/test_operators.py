"""Merges, listings, deduplication, control, crawl, induction, pipelines and streams on small tables."""

import datetime
import shutil
import random

import pytest
from pyspark.sql import functions as F

from offerflow import schemas
from offerflow.functions import geo, price, text
from offerflow.operators import control, crawl, dedup, induce, listing, merge
from offerflow.plans import pipeline
from offerflow.streaming.feed import event_counts, merge_batches, merge_into, read_snapshot, write_snapshot


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=lambda r: [(v is not None, v) for v in r])


# Text, prices, grid


@pytest.mark.parametrize(
    ("make", "value", "expected"),
    [
        (text.thousands_float, "1,234.5", 1234.5), (text.thousands_float, "n/a", None), (text.thousands_float, None, None),
        (text.strip_newlines, "a\r\nb\n", "a\rb"), (text.int_or_null, "12", 12), (text.int_or_null, "x", None),
        (text.strip_tags, " <b>a</b> <i>c < d \t", "a c < d"), (text.coordinate_pairs, "1.5,2.5 x 3,4 5.0,6.0", "1.5,2.5;5.0,6.0"),
        (text.url_host, "http://a.b:80/c?d", "a.b:80"), (text.url_path, "http://a/c/d?e#f", "/c/d"), (text.url_query, "http://a/c?d=1&e#f", "d=1&e"),
        (text.canonical_url, "http://a/b;c?d", "http://a/b?*"), (text.canonical_url, "http://a/b", "http://a/b"),
        (text.drop_parents, "/../../a/../b", "/a/../b"), (text.after_colon, "a：b：c", "b：c"), (text.after_colon, "abc", "abc"),
        (text.first_number, "&#123; 45.5 and 6", 45.5), (text.first_number, "none", None), (text.number_or_zero, "none", 0.0),
        (text.is_blank, " \t\n", True), (text.is_blank, "a", False), (text.shorten_link_text, "abcdef/abcde", "/abcd/abcde"),
        (text.decode_list, "", []), (text.decode_list, "a;b", ["a", "b"]),
        (lambda c: text.strip_suffix(c, "?x"), "a?x?x", "a?x"), (lambda c: text.strip_suffix(c, "?x"), "a?xb", "a?xb"),
        (lambda c: text.trim_title_prefix(c, "-"), "ab-cd", "cd"), (lambda c: text.trim_title_prefix(c, "-"), "-cd", "-cd"), (lambda c: text.trim_title_prefix(c, "-"), "abcdef-g", "abcdef-g"),
        (lambda c: text.contains_after_start(c, "a"), "ab", False), (lambda c: text.contains_after_start(c, "a"), "ba", True),
        (lambda c: text.app_address(c, ".h.com"), "app", "app.h.com"), (lambda c: text.app_address(c, ".h.com"), "app.h.com", "app.h.com"), (lambda c: text.app_address(c, ".h.com"), "app.x", None),
        (lambda c: text.query_part(c, "m="), "http://a?x=1&m=2&m=3", "2"), (lambda c: text.query_part(c, "m="), "http://a?x=1", None),
        (lambda c: text.matching_label(c, {"one": "^a", "two": "b"}), "ab", "one"), (lambda c: text.matching_label(c, {"one": "^a"}), "b", None),
    ],
)
def test_text(spark, make, value, expected):
    assert one(spark, make(F.lit(value).cast("string"))) == expected


def test_epochs_lose_their_fraction(spark):
    assert one(spark, text.epoch_timestamp(F.lit("1300000000.9"))) == one(spark, F.timestamp_seconds(F.lit(1300000000)))


@pytest.mark.parametrize(
    ("a", "b", "discount", "expected"),
    [(100, 30, 3.0, "original,price"), (30, 100, 3.0, "price,original"), (100, 30, 7.0, "original,saved"), (100, 50, 5.0, "original,saved"), (100, 33, 3.0, "original,price"), (100, 10, 5.0, None), (0, 0, 5.0, None)],
)
def test_prices(spark, a, b, discount, expected):
    assert one(spark, price.classify_prices(F.lit(float(a)), F.lit(float(b)), F.lit(discount))) == expected


@pytest.mark.parametrize(("size", "w", "h", "expected"), [(14_999, 900, 900, False), (100_001, 1, 1, True), (50_000, 300, 300, True), (50_000, 250, 300, False), (50_000, 700, 300, False)])
def test_pictures(spark, size, w, h, expected):
    assert one(spark, price.is_product_image(F.lit(size), F.lit(float(w)), F.lit(float(h)), F.lit("png"))) is expected
    assert one(spark, price.is_product_image(F.lit(50_000), F.lit(300.0), F.lit(300.0), F.lit(None).cast("string"))) is False


def test_grid_round_trip(spark):
    assert one(spark, geo.cell_id(F.lit(39.9), F.lit(116.4))) == 140737536841487516
    rng = random.Random(3)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180), k) for k in range(500)]
    for scale in (1, 500, 32767):
        cells = spark.createDataFrame(points, "lat double, lon double, k int").select("*", geo.cell_id(F.col("lat"), F.col("lon"), scale).alias("cell"))
        for r in cells.select("*", geo.decode_cell(F.col("cell")).alias("d"), geo.cell_corner(F.col("cell")).alias("c")).collect():
            assert r.d.scale == scale
            assert -1e-9 <= r.lat - r.c.lat < geo.LAT_STEP * scale + 1e-9 and -1e-9 <= r.lon - r.c.lon < geo.LON_STEP * scale + 1e-9
    with pytest.raises(ValueError):
        geo.cell_id(F.lit(0.0), F.lit(0.0), 40_000)


@pytest.mark.parametrize(("value", "expected"), [("1.5,2.5", (1.5, 2.5)), ("0,0,9", (0, 0)), ("91,0", None), ("1", None), ("x,y", None), ("", None)])
def test_points(spark, value, expected):
    found = one(spark, geo.parse_point(F.lit(value)))
    assert (tuple(found) if found else None) == expected


# The store


def test_store_scenario(spark):
    """Create, look up by key and by other columns, update in part, delete all."""
    pages = spark.createDataFrame([("www.google.com", "google", "us", False), ("www.google.com.hk", "google", "hk", False), ("www.baidu.com", "baidu", "<html>", True), ("www.bing.com", "bing", None, None)], "url string, siteid string, data string, infopage boolean")
    q = listing.OfferQuery("url")
    assert rows(q.filter("url", "www.google.com").get(pages)) == [("www.google.com", "google", "us", False)]
    assert listing.equal_to(pages, siteid="google").count() == 2 and listing.equal_to(pages).count() == 4
    change = spark.createDataFrame([("www.bing.com", "ms", True)], "url string, data string, infopage boolean")
    updated = merge.upsert(pages, change, "url")
    assert updated.count() == 4 and rows(listing.equal_to(updated, url="www.bing.com")) == [("www.bing.com", "bing", "ms", True)]
    assert merge.delete_where(updated, F.lit(True)).count() == 0


def test_queries(spark):
    df = spark.createDataFrame([(k, k % 3, None if k == 4 else 10 - k) for k in range(10)], "k int, g int, v int")
    q = listing.OfferQuery("k").filter("g =", 1).filter("g =", 0)  # the same restriction again replaces
    assert [r.k for r in q.order("-v").fetch(df, 2, 1).collect()] == [3, 6]
    assert [r.k for r in listing.OfferQuery("k").order("v").fetch(df, 2).collect()] == [4, 9]  # null sorts lowest
    assert [r.k for r in listing.OfferQuery("k").order("-v").fetch(df).collect()][-1] == 4
    assert q.fetch(df, 5, 99).count() == 0 and q.count(df).first().n == 4
    assert q.signature("t") == listing.OfferQuery("k").filter("g =", 0).signature("t") != q.signature("t", 1)
    with pytest.raises(ValueError):
        q.filter("g ~", 1)
    with pytest.raises(ValueError):
        listing.list_offers(df, "x", "name")
    assert listing.equal_to(spark.createDataFrame([("ab",)], "s string"), s="a\nb").count() == 1  # restrictions are stored form


def test_sync_is_idempotent(spark):
    rng = random.Random(1)
    make = lambda ks: spark.createDataFrame([(k, rng.choice([None, 1, 2])) for k in ks], "url int, v int")
    source, target = make(range(0, 60)), make(range(30, 90))
    ops = {r.url: (r.op, r.v) for r in merge.diff(source, target, "url").collect()}
    old, new = dict(target.collect()), dict(source.collect())
    for k in range(90):
        expected = "created" if k not in old else "deleted" if k not in new else "updated" if old[k] != new[k] else "unchanged"
        assert ops[k] == (expected, new.get(k, old.get(k)))
    assert rows(merge.sync_counts(source, source, "url")) == [("unchanged", 60)]


def test_change_logs(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    log = spark.createDataFrame(
        [(1, 1, "update", "x"), (1, 2, "update", None), (2, 3, "delete", None), (3, 4, "create", "y"), (4, 5, "create", "n"), (4, 6, "update", "m"), (5, 7, "create", "z"), (5, 8, "delete", None), (6, 9, "update", "q"), (2, 10, "create", "again")],
        "k int, at int, op string, v string",
    )
    folded = merge.fold_changes(log, base, "k", "at")
    assert {r.k: (r.op, r.error) for r in folded.collect()} == {1: ("update", None), 2: ("update", None), 3: ("update", "exists"), 4: ("create", None), 5: ("none", None), 6: ("create", "missing")}
    changes = folded.filter("error is null").join(merge.last_of_each(log.drop("op"), "k", "at"), "k")
    assert rows(merge.apply_changes(base, changes, "k")) == [(1, "x"), (2, "again"), (3, "c"), (4, "m")]


def test_reconcile_takes_a_match_once(spark):
    feed = spark.createDataFrame([("s", "u", 2, 5), ("s", "u", 1, 4), ("t", "u", 3, 6)], "siteid string, url string, ord int, bought int")
    store = spark.createDataFrame([("s", "u", "A", "1.0,2.0"), ("s", "gone", "B", None)], "siteid string, url string, address string, geoinfo string")
    assert rows(merge.reconcile(feed, store), "ord", "address", "db_flag") == [(1, "A", True), (2, None, False), (3, None, False)]
    assert rows(merge.vanished(feed, store, ["siteid", "url"]), "url") == [("gone",)]


def test_types(spark):
    df = spark.createDataFrame([("a\nb", "a\nb", "1,200.5", "7", "1300000000.9", "kept")], "title string, city string, original string, bought string, starttime string, other string")
    r = schemas.coerce(df, schemas.OFFERS).first()
    assert (r.title, r.city, r.original, r.bought, r.other) == ("ab", "a\nb", 1200.5, 7, "kept") and isinstance(r.starttime, datetime.datetime)
    filled = schemas.with_type_defaults(spark.createDataFrame([(None, None, None)], "title string, bought long, starttime timestamp"), schemas.OFFERS).first()
    assert tuple(filled) == ("", 0, None)


# Order and groups


def test_city_fold_is_that_of_a_loop(spark):
    rng = random.Random(2)
    data = [(k, f"t{rng.randrange(6)}", f"c{rng.choice([1, 2, 3, 10, 12, 23])}") for k in range(200)]
    expected = {}
    for k, t, c in data:
        if t not in expected:
            expected[t] = [k, c]
        elif c not in expected[t][1]:
            expected[t][1] += f",{c}"
    df = spark.createDataFrame(data, "ord int, title string, city string").repartition(5)
    assert {r.title: [r.ord, r.city] for r in dedup.fold_cities(df, ["title"]).collect()} == expected


def test_caps(spark):
    df = spark.createDataFrame([(k, "s", k % 2 == 0) for k in range(20)], "ord int, siteid string, old boolean")
    kept = {r.ord for r in dedup.cap_new_rows(df, "old", "siteid", "ord", 3).collect()}
    assert kept == {*range(0, 20, 2), 1, 3, 5}
    assert [r.ord for r in dedup.flagged_first(df, "old", "ord").collect()] == [*range(0, 20, 2), *range(1, 20, 2)]
    tried = {r.ord for r in dedup.mark_attempts(df, ~F.col("old"), "siteid", "ord", 2).filter("attempt").collect()}
    assert tried == {1, 3}


def test_batches_of_eleven(spark):
    cities = spark.createDataFrame([(k, f"c{k}") for k in range(23)], "pos int, cityid string")
    urls = [r.url for r in dedup.batch_urls(cities, "http://x", "q=%s").orderBy("batch").collect()]
    assert [u.count("q=") for u in urls] == [11, 11, 1] and urls[2] == "http://x?q=c22"


def test_fill_rates(spark):
    df = spark.createDataFrame([("a", None, 0), ("", "b", None)], "x string, y string, z int")
    assert dict(dedup.fill_rates(df).collect()) == {"x": 1, "y": 1, "z": 1}


def test_cities_of_links(spark):
    cities = spark.createDataFrame([("bj", "Beijing "), ("sh", "Shanghai")], "cityid string, name string")
    links = spark.createDataFrame([(1, "deal/Shanghai/Beijing"), (2, "in Beijing and Shanghai"), (3, "a/b"), (4, "x/Beijing")], "k int, t string")
    assert dict(dedup.city_of_link(links, cities, "k", "t").collect()) == {1: "Shanghai", 2: "Beijing", 4: "Beijing"}
    offers = spark.createDataFrame([("Beijing",), ("Beijing,Shanghai",), ("Paris",)], "city string")
    assert dict(dedup.cities_of(offers, cities).select("city", "cityid").collect()) == {"Beijing": "bj", "Beijing,Shanghai": "multi", "Paris": None}


# Control


def servers(spark, *data):
    return control.with_load(spark.createDataFrame([(a, "extractor", s, float(c), 0.0, None, -1.0) for a, s, c in data], "address string, servertype string, sites string, cpu_usage double, outgoing_bandwidth double, incomming_bandwidth double, datastore double"))


def test_decisions(spark):
    expected = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "site string, ord int")
    decide = lambda *data: [tuple(r) for r in control.balance_decision(expected, servers(spark, *data)).collect()]
    assert decide(("s1", "a;b", 10), ("s2", "", 20)) == [("add", "s2", "c")]
    assert decide(("s1", "a;b;c", 10), ("s2", "b", 20)) == [("remove", "s2", "b")]
    assert decide(("s1", "a;b", 90), ("s2", "", 80), ("s3", "b", 85)) == [("remove", "s1", "b")]  # none is free: on to duplicates
    assert decide(("s1", "a;b;c", 90), ("s2", "", 10)) == [("remove", "s1", "a")]
    assert decide(("s1", "a;b;c", 30), ("s2", "", 20)) == []
    averages = control.load_per_site(servers(spark, ("s1", "a;b", 30), ("s2", "", 20))).first()
    assert tuple(averages) == (50.0, 2, 25.0)
    assert control.load_per_site(servers(spark, ("s1", "", 30))).first().per_site == 3.0


def test_admission_and_leases(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    now = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 01:00:00")))
    df = spark.createDataFrame([("waits", at(3000), at(2500)), ("old", at(3000), at(2400)), ("done", at(2500), at(3000)), ("never", at(3000), None), ("new", None, None)], "k string, enqueuetime timestamp, lastupdate timestamp")
    assert dict(df.select("k", control.admit(now)).collect()) == {"waits": False, "old": True, "done": True, "never": True, "new": True}
    jobs = spark.createDataFrame([("free", None, None), ("held", "w", at(3100)), ("stale", "w", at(2900))], "k string, owner string, leased timestamp")
    assert dict(jobs.select("k", control.lease_free(now)).collect()) == {"free": True, "held": False, "stale": True}


def test_reports(spark):
    sites = spark.createDataFrame([("a", "me"), ("b", "you"), ("c", "me"), ("d", None), ("e", "you")], "siteid string, updateserver string")
    report = spark.createDataFrame([("a",), ("b",), ("d",), ("n",)], "siteid string")
    assert dict(control.merge_report(sites, report, "me").collect()) == {"a": "update", "b": "conflict", "c": "obsolete", "d": "update", "n": "update"}


# Crawl and induction


def test_reachability_keeps_the_least_depth(spark):
    edges = spark.createDataFrame([("a", "b", "B"), ("b", "c", "C"), ("a", "c", "direct"), ("c", "d", "D"), ("d", "a", "loop"), ("x", "y", "none")], "src string, dst string, text string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert rows(crawl.reachable(seeds, edges), "url", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(crawl.reachable(seeds, edges, most_depth=2), "url", "depth") == [("a", 0), ("b", 1), ("c", 1)]
    assert {r.url: r.linktext for r in crawl.reachable(seeds, edges).collect()}["d"] == "/direct/D"


def test_crawls_stop_at_a_number_of_pages(spark):
    edges = spark.createDataFrame([("a", x, x) for x in "bcde"] + [("b", "f", "f")], "src string, dst string, text string")
    seeds = spark.createDataFrame([("a",)], "url string")
    for most, expected in ((0, "abcdef"), (3, "abc"), (5, "abcde"), (1, "a")):
        assert "".join(sorted(r.url for r in crawl.reachable(seeds, edges, most_pages=most).collect())) == expected


def test_frontiers_go_through_text(spark):
    df = spark.createDataFrame([("http://a?b=[1]", 2, None), ("", 0, "x|y")], "url string, depth int, text string")
    lines = crawl.frontier_text(df)
    assert rows(crawl.parse_frontier(lines, df.columns)) == [("", "0", "x|y"), ("http://a?b=[1]", "2", "")]
    cut_off = lines.select(F.substring("line", 1, 8).alias("line"))
    assert crawl.parse_frontier(cut_off, df.columns).count() == 0


def test_seed_samples(spark):
    of = lambda n, seed=0: sorted(r.id for r in crawl.seed_sample(spark.range(n), "id", seed=seed).collect())
    assert of(0) == [] and of(7) == list(range(7)) and of(20) == list(range(4, 20))
    assert len(set(of(200))) == 16 and of(200) != of(200, 1) and of(200) != list(range(184, 200))


def test_candidates_without_ancestors(spark):
    df = spark.createDataFrame([(1, "/html"), (1, "/html/body/div"), (1, "/html/body/div[2]"), (1, "/html/body/div[2]/p"), (2, "/html"), (3, "/a/b"), (3, "/a/bc")], "page_id int, path string")
    assert rows(induce.without_ancestors(df)) == [(1, "/html/body/div"), (1, "/html/body/div[2]/p"), (2, "/html"), (3, "/a/b"), (3, "/a/bc")]


def test_fold_onto_a_store(spark):
    schema = "siteid string, title string, city string, url string, ord int"
    store = spark.createDataFrame([("s", "One", "Rome,Oslo", "u1", 1), ("s", "Two", "", "u2", 2)], schema)
    offers = spark.createDataFrame([("s", "One", "Oslo", "v1", 1), ("s", "One", "Bonn", "v2", 2), ("s", "Two", "Rome", "v3", 3), ("s", "New", "Rome", "v4", 4)], schema)
    assert rows(dedup.fold_onto(store, offers, ["siteid", "title"]), "title", "city", "url") == [("New", "Rome", "v4"), ("One", "Rome,Oslo,Bonn", "u1"), ("Two", "Rome", "u2")]


def test_strict_changes(spark):
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    changes = lambda *log: merge.fold_changes(spark.createDataFrame(log, "k int, op string, at int"), base, "k", "at")
    assert merge.apply_changes(base, changes((1, "delete", 1)), "k", strict=True).count() == 0
    with pytest.raises(merge.ChangeError, match="2: missing"):
        merge.apply_changes(base, changes((2, "update", 1), (1, "update", 2)), "k", strict=True)


@pytest.mark.parametrize(("url", "expected"), [("http://a.com/d/1", True), ("https://a.com/d/1", False), ("http://b7.com/d", True), ("http://xb7.com/d", False), ("http://a.com/x", False), ("http://a.com:80/d", False)])
def test_crawl_rules(spark, url, expected):
    assert one(spark, crawl.admitted(F.lit(url), ["a.com"], [r"b\d"], ["/d"])) is expected
    assert one(spark, crawl.admitted(F.lit(url))) is url.startswith("http://")


def test_similar_pages(spark):
    pages = spark.createDataFrame([("http://a?x=1", "T", ["1", "2"]), ("http://a?x=2", "T", ["1", "2", "3", "3"]), ("http://b?1", "T", []), ("http://b?2", "U", []), ("http://c", "T", [])], "url string, title string, links array<string>")
    assert rows(crawl.collapse_parameters(pages)) == [("http://a?*", 2, True), ("http://b?*", 2, False), ("http://c", 1, None)]
    assert one(spark, crawl.similar(F.lit("t"), F.lit("t"), F.array(F.lit("1")), F.array(*map(F.lit, "2223")))) is False  # each occurrence counts


def brute_collapse(pages):
    bases = {}
    for url, title, links in sorted(pages):
        bases.setdefault(url.split("?")[0] + ("?*" if "?" in url else ""), []).append((title, links))
    similar = lambda a, b: a[0] == b[0] and sum(x not in a[1] for x in b[1]) <= 2
    return sorted((base, len(of), similar(of[0], of[1]) if len(of) > 1 else None) for base, of in bases.items())


def test_the_first_two_pages_decide(spark):
    pages = [("http://a?1", "T", ["1"]), ("http://a?2", "T", ["1"]), ("http://a?3", "U", ["1"]), ("http://b?1", "T", []), ("http://b?2", "U", []), ("http://b?3", "T", []), ("http://c?1", "T", list("12")), ("http://c?2", "T", list("3456")), ("http://c?3", "T", []), ("http://d?1", "T", []), ("http://d?1", "T", []), ("http://d?2", "V", [])]
    df = spark.createDataFrame(pages, "url string, title string, links array<string>").repartition(5)
    assert rows(crawl.collapse_parameters(df)) == brute_collapse(pages)


def test_pages_without_title_or_links_count(spark, tmp_path):
    from offerflow import catalog

    link = "<a href='/{}'>x</a>"
    html = [("http://a?1", "<p>neither</p>"), ("http://a?2", "<title></title>" + link.format(1)), ("http://a?3", "<title>T</title>"), ("http://b?1", "<title>T</title>"), ("http://b?2", "<title>T</title>" + "".join(map(link.format, range(3)))), ("http://c?1", None)]
    spark.createDataFrame([(k, *r) for k, r in enumerate(html)], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    assert rows(catalog.QUERIES["crawl_parameter_collapse"](spark, f"file://{tmp_path}")) == [("http://a?*", 3, True), ("http://b?*", 2, False), ("http://c?*", 1, None)]


def test_frontier(spark):
    df = spark.createDataFrame([(1, 0, True), (2, 1, False), (3, 2, False), (4, 2, False)], "ord int, depth int, visited boolean")
    assert crawl.next_page(df).first().ord == 3
    assert crawl.frontier_text(df.select("ord", "depth")).first().line == "1[=%0=]%"


def test_templates(spark):
    maps = [{"price": "/a", "title": "/b"}, {"title": "/b", "price": "/a"}, {"price": "/c"}, {"price": "/c"}]
    voted = induce.vote(spark.createDataFrame(list(enumerate(maps)), "ord int, template map<string,string>")).first()
    assert (voted.n, voted["first"]) == (2, 0)
    stored = spark.createDataFrame([("/a", "", None)], "price string, title string, image string")
    assert induce.stored_template(stored).first().template == {"price": "/a"}


def test_prices_of_pages(spark):
    from offerflow.sources.markup import html_nodes

    long = "A fine long title that costs $ much"
    pages = spark.createDataFrame([(1, f"<h1>{long}</h1><b>$100</b><i>3.0 off</i><u>$30</u>"), (2, "<b>$5</b>")], "page_id long, html string")
    nodes = html_nodes(pages)
    triple = induce.price_triples(induce.price_candidates(nodes, "$", "off")).collect()
    assert [(r.page_id, r.first, r.second, r.discount, r.kinds) for r in triple] == [(1, 100.0, 30.0, 3.0, "original,price")]
    anchors = spark.createDataFrame([(1, 99)], "page_id long, anchor int")
    assert rows(induce.title_before(nodes, anchors, "$")) == [(1, long)]
    assert rows(induce.apply_template(nodes, {"title": "/h1", "price": "/u"})) == [(1, long, "$30")]


# Pipelines and streams


def test_pipeline(spark):
    feed = spark.createDataFrame([("http://a?t", "s", "One", "Beijing", "5", 1), ("http://b?t", "s", "One", "Shanghai", "6", 2), ("http://c?t", "s", "Two", "Beijing", "7", 3)], "url string, siteid string, title string, city string, bought string, ord int")
    store = spark.createDataFrame([("http://a", "s", "<i>Road</i>", None, None, None, None)], "url string, siteid string, address string, geoinfo string, title string, city string, bought long")
    cities = spark.createDataFrame([("bj", "Beijing")], "cityid string, name string")
    pages = spark.createDataFrame([("http://c", "<div class='addr'>Street</div>")], "url string, html string")
    places = spark.createDataFrame([("Street", "1.5,2.5")], "address string, geoinfo string")
    spec = [("remove_duplicates", {}), ("remove_tail", {"tail": "?t"}), ("reconcile", {}), ("enrich_from_pages", {"address": "class:addr"}), ("enrich_address", {}), ("geocode", {}), ("merge_typed", {})]
    found = pipeline.run(spec, feed, store=store, cities=cities, pages=pages, gazetteer=places)
    assert rows(found, "url", "title", "city", "bought", "address", "geoinfo") == [("http://a", "One", "Beijing,Shanghai", 5, "<i>Road</i>", geo.NOWHERE), ("http://c", "Two", "Beijing", 7, "Street", "1.5,2.5")]
    with pytest.raises(ValueError):
        pipeline.run([("nothing", {})], feed)
    with pytest.raises(ValueError):
        pipeline.run([("remove_duplicates", {})], store)


def test_addresses_and_places_from_markup(spark):
    """The page of a new row gives its shop, address and point; a map picture counts only where the details have none."""
    picture = "<img src='http://maps.google.com/m?markers={}'>"
    details = lambda at: f"<p>电话</p><p>地址：北京市 路 号 楼</p>{at}"
    rows_ = [
        ("http://a", "Beijing", "<b>Shop</b>", details(picture.format("12.5,45.25")), picture.format("1.5,1.5"), True), ("http://b", "Beijing,Shanghai", None, details(""), picture.format("12.5,45.25"), True),
        ("http://c", "Nowhere", None, None, None, True), ("http://d", "Beijing", "<b>Old</b>", None, None, False),
    ]
    df = spark.createDataFrame(rows_, "url string, city string, shop string, addrdetails string, mapimg string, html_flag boolean")
    cities = spark.createDataFrame([("bj", "Beijing")], "cityid string, name string")
    found = pipeline.run([("enrich_address", {"words": ["路", "号", "楼"]})], df, cities=cities)
    cell = spark.range(1).select(geo.cell_id(F.lit(12.5), F.lit(45.25)).alias("x")).first().x
    assert rows(found, "url", "cityid", "shop", "address", "geoinfo", "geogrid") == [
        ("http://a", "bj", "Shop", "北京市 路 号 楼", "12.5,45.25", cell), ("http://b", "multi", None, "北京市 路 号 楼", "12.5,45.25", cell),
        ("http://c", None, None, None, None, None), ("http://d", None, "<b>Old</b>", None, None, None),
    ]
    assert not {"addrdetails", "mapimg", "html_flag"} & set(found.columns)


def test_stream_of_feeds(spark, tmp_path):
    source, schema = f"file://{tmp_path}/in", "url string, siteid string, title string, bought long, ord int"
    store, kept = f"file://{tmp_path}/store", schemas.OFFERS
    write_snapshot(spark.createDataFrame([], kept), store, "url", 4)
    run = lambda: merge_batches(spark, source, spark.createDataFrame([], schema).schema, store, kept, "url", f"file://{tmp_path}/checkpoint", buckets=4).awaitTermination()
    found = lambda: rows(read_snapshot(spark, store, kept), "url", "title", "bought")
    spark.createDataFrame([("u", "s", "One", 1, 1), ("v", "s", "Two", 2, 2), ("u", "s", None, 3, 3)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert found() == [("u", "One", 3), ("v", "Two", 2)]
    spark.createDataFrame([("v", "s", "New", None, 4), ("w", "s", "Three", 9, 5)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert found() == [("u", "One", 3), ("v", "New", 2), ("w", "Three", 9)]
    run()  # nothing new
    assert found() == [("u", "One", 3), ("v", "New", 2), ("w", "Three", 9)]


def test_a_merge_writes_the_buckets_that_it_touches(spark, tmp_path):
    store, kept = f"file://{tmp_path}/store", schemas.OFFERS
    some = lambda *rows: spark.createDataFrame([], kept).unionByName(spark.createDataFrame(rows, "url string, title string"), allowMissingColumns=True)
    write_snapshot(some(*((f"u{k}", f"t{k}") for k in range(200))), store, "url", 8)
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("part-*")}
    before = files()
    change = spark.createDataFrame([("u7", "new")], "url string, title string")
    merge_into(spark, store, kept, change, "url", f"file://{tmp_path}/staged", 8)
    changed = {p.parent for p in set(before.items()) ^ set(files().items()) for p in [p[0]]}
    assert len(changed) == 1 and len({p.parent for p in before}) == 8
    whole = dict(read_snapshot(spark, store, kept).select("url", "title").collect())
    assert whole == {f"u{k}": f"t{k}" for k in range(200)} | {"u7": "new"}
    # A bucket that is lost while buckets are exchanged comes back when the batch is run again.
    shutil.rmtree(tmp_path / changed.pop())
    assert read_snapshot(spark, store, kept).count() < 200
    merge_into(spark, store, kept, change, "url", f"file://{tmp_path}/staged", 8)
    assert dict(read_snapshot(spark, store, kept).select("url", "title").collect()) == whole


def test_event_windows_over_a_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(f"file://{tmp_path}/events")
    table = spark.read.parquet(f"file://{tmp_path}/events")
    stream = spark.readStream.schema(table.schema).parquet(f"file://{tmp_path}/events")
    query = event_counts(stream).writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/checkpoint").start()
    query.awaitTermination()
    found = spark.table("windows").select("window.start", "event_type", "n")
    assert rows(found) == rows(event_counts(table).select("window.start", "event_type", "n"))
