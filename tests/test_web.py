"""Structure of markup, induction, crawls that go on, update states, versions and encodings, against loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from offerflow.functions import charsets
from offerflow.operators import crawl, structure, updates, versions
from offerflow.plans import induction, pipeline
from offerflow.sources import feeds, markup
from offerflow.sources.markup import Wanted


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: [(x is not None, x) for x in r])


def random_page(rnd, size=40):
    names = ["div", "span", "ul", "li", "b", "a"]
    parts = []
    for _ in range(size):
        kind = rnd.random()
        name = rnd.choice(names)
        parts.append(f'<{name} class="{rnd.choice("xyz")}">' if kind < 0.5 else f"</{name}>" if kind < 0.8 else rnd.choice(["text ", "<!--c-->", "<br>", "more"]))
    return "".join(parts)


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(3)
    return spark.createDataFrame([(k, random_page(rnd)) for k in range(30)] + [(90, None), (91, ""), (92, "plain")], "page_id long, html string").cache()


@pytest.fixture(scope="module")
def nodes(pages):
    return markup.html_nodes(pages).cache()


# Structure


def by_page(nodes):
    found = {}
    for r in nodes.orderBy("page_id", "ord").collect():
        found.setdefault(r.page_id, []).append(r)
    return found


def test_intervals_are_what_lies_below(nodes):
    for page in by_page(nodes).values():
        for r in page:
            below = [x.ord for x in page if x.path.startswith(r.path + "/") or x.kind != "tag" and x.path == r.path and x.ord > r.ord] if r.kind == "tag" else []
            assert below == list(range(r.ord + 1, r.last + 1))


def test_structural_joins(nodes):
    tops, some = nodes.filter("kind = 'tag' and name in ('div', 'ul')"), nodes.filter("kind <> 'tag' or name in ('li', 'ul')")
    every = [(p, t.ord, n.ord) for p, page in by_page(nodes).items() for t in page for n in page if t.name in ("div", "ul") and (n.kind != "tag" or n.name in ("li", "ul")) and t.ord < n.ord <= t.last]
    assert rows(structure.contained(some, tops)) == sorted(every)
    nearest = {}
    for p, t, n in every:
        nearest[p, n] = max(t, nearest.get((p, n), -1))
    assert rows(structure.contained(some, tops, nearest=True)) == sorted((p, t, n) for (p, n), t in nearest.items())
    assert rows(structure.inside_any(some, tops), "page_id", "ord") == sorted(nearest)


@pytest.mark.parametrize(("way", "limit"), [(structure.following, 1), (structure.following, 3), (structure.preceding, 1), (structure.preceding, 2), (structure.next_siblings, 2), (structure.previous_siblings, 2)])
def test_what_is_before_and_after(nodes, way, limit):
    of, wanted = nodes.filter("name in ('li', 'b')"), nodes.filter("name in ('b', 'a')")
    after, sibling = way in (structure.following, structure.next_siblings), way in (structure.next_siblings, structure.previous_siblings)
    expected = []
    for p, page in by_page(nodes).items():
        for n in (x for x in page if x.name in ("li", "b")):
            hits = [x.ord for x in page if x.name in ("b", "a") and (x.ord > n.ord if after else x.ord < n.ord) and (not sibling or x.parent == n.parent)]
            expected += [(p, n.ord, k + 1, hit) for k, hit in enumerate((hits if after else hits[::-1])[:limit])]
    assert rows(way(of, wanted, limit), "page_id", "ord", "place", "found") == sorted(expected)


def test_equal_subtrees_have_equal_digests(spark):
    page = '<ul><li class="a">x<b>y</b></li><li class="a">x<b>y</b></li><li class="b">x<b>y</b></li><li class="a">xy</li><li class="a">x<b>y</b> </li></ul>'
    nodes = markup.html_nodes(spark.createDataFrame([(1, page), (2, '<li class="a">x<b>y</b></li>')], "page_id long, html string"), digests=True)
    found = structure.repeated(nodes.filter("name = 'li'"))
    assert rows(found, "name", "text", "n", "pages") == [("li", "xy", 3, 2)]


def test_common_paths(spark):
    nodes = spark.createDataFrame([(1, "/a/b/c"), (1, "/a/bd"), (2, "/a/b"), (2, "/a/b/c"), (3, "/a/b[2]/c"), (4, "/a"), (4, "/b")], "page_id long, path string")
    assert rows(structure.common_path(nodes, ["page_id"])) == [(1, "/a"), (2, "/a"), (3, "/a/b[2]"), (4, "")]


@pytest.mark.parametrize("want", [{"name": "li"}, {"name": ["li", "a"]}, {"name": re.compile("^[lb]")}, {"attrs": {"class": "x"}}, {"attrs": {"class": ["x", "y"]}}, {"attrs": {"class": re.compile("[yz]")}}, {"attrs": {"id": None}}, {"attrs": "z"}, {"name": "b", "attrs": {"class": True}}])
def test_what_leaves_the_parse_is_what_is_found_after_it(pages, nodes, want):
    parsed = markup.html_nodes(pages, wanted=Wanted(**want))
    columns = [c for c in nodes.columns if c != "attrs"]
    assert rows(parsed, *columns) == rows(markup.find_all(nodes, want.get("name"), want.get("attrs")), *columns)


def test_texts_and_subtrees_that_leave_the_parse(pages, nodes):
    assert rows(markup.html_nodes(pages, wanted=Wanted(text="^mo")), "page_id", "ord", "text") == rows(nodes.filter("kind <> 'tag' and text rlike '^mo'"), "page_id", "ord", "text")
    below = markup.html_nodes(pages, wanted=Wanted(name="ul", below=True))
    lists = markup.find_all(nodes, "ul")
    assert rows(below, "page_id", "ord") == rows(lists.select("page_id", "ord").union(structure.inside_any(nodes, lists).select("page_id", "ord")).distinct())


def test_texts_of_tags_are_parts_of_what_a_page_says(pages, nodes):
    bare = markup.html_nodes(pages, texts=False)
    whole = bare.filter("said is not null").select("page_id", "said")
    part = F.substring("said", F.col("said_from") + 1, F.col("said_to") - F.col("said_from")).alias("text")
    assert rows(bare.drop("said").filter("kind = 'tag'").join(whole, "page_id").select("page_id", "ord", part)) == rows(nodes.filter("kind = 'tag'"), "page_id", "ord", "text")
    assert bare.filter("kind = 'tag' and text is not null").count() == 0


def test_addresses_count_words_after_the_colon(spark):
    texts = ["<p>street road lane：call us</p><p>At：1 street, road, lane</p>", "<p>street road lane</p>", "<p>x：street road</p>", None]
    nodes = markup.html_nodes(spark.createDataFrame(list(enumerate(texts)), "page_id long, html string"))
    assert rows(markup.find_address(nodes, ["street", "road", "lane"])) == [(0, "1 street, road, lane"), (1, "street road lane")]


# Induction


def offer(title, table=False, price=50):
    cells = f"<table><tr><td>was</td><td>$ 100</td></tr><tr><td>saved</td><td>$ {price}</td></tr></table>" if table else f"<p>was</p><i>$ 100</i><p>saved</p><i>$ {price}</i><i>5.0 off</i>"
    return f'<html><h1>{title}</h1><b>2 bought</b><div><q>so</q>{cells}</div><img src="/a.jpg"></html>'


def induced(spark, texts, stored=()):
    pages = spark.createDataFrame([(k, site, html) for k, (site, html) in enumerate(texts)], "page_id long, site string, html string")
    keywords = spark.createDataFrame([("c", 0, "items", ["bought"]), ("c", 1, "original", ["was"]), ("c", 2, "currency", ["$"]), ("c", 3, "saved", ["saved"])], "config string, ord int, attribute string, keywords array<string>")
    configs = spark.createDataFrame([(0, "c", ".")], "ord int, config string, pattern string")
    known = spark.createDataFrame([(f"http://{s}/a.jpg", 200000, -1, -1, None) for s in "st"], "url string, size int, width int, height int, kind string")
    kept = spark.createDataFrame(list(stored), "site string, ord int, template map<string,string>")
    return induction.induce(pages, markup.html_nodes(pages, texts=False), kept, configs, keywords, known, "off", "$")


GOOD, SHORT = "A title that costs $ 50 in all", "short"


def test_templates_of_a_site(spark):
    texts = [("s", offer(GOOD))] * 3 + [("s", offer(GOOD, True)), ("s", offer(SHORT, True)), ("s", offer(SHORT)), ("s", "<html><h1>none</h1></html>"), ("t", offer(GOOD, True)), ("t", None)]
    texts += [("s", offer(f"{GOOD} {k}")) for k in range(20)]
    run = induced(spark, texts)
    found = {r.page_id: r for r in run.results.collect()}
    assert [found[k].source for k in range(6)] == ["probe"] * 3 + ["page", "page", "probe"]  # short titles lie where the template says
    assert (found[6].source, found[6].error) == (None, "region") and (found[8].source, found[8].error) == (None, "region") and found[7].source == "probe"
    assert found[4].info["title"] == SHORT and found[4].info["original"] == "$ 100" and found[4].info["image"] == "/a.jpg" and found[5].info["discount"] == "5.0 off"
    assert run.counters == {"pages": 29, "resolved": 27, "stored": 0, "probe": 25, "page": 2, "failed": 2}
    assert rows(run.templates, "site", "rank", "source", "pages") == [("s", 1, "probe", 24), ("s", 2, "page", 2), ("t", 1, "probe", 1)]


def test_stored_templates_go_first(spark):
    texts = [("s", offer(GOOD)), ("s", offer(GOOD, True)), ("s", "<html><h1>only a title</h1></html>")]
    run = induced(spark, texts, [("s", 1, {"title": "/html/h1"}), ("s", 0, {"title": "/html/h1", "original": "/html/div/i"}), ("s", 2, {}), ("t", 0, {"title": "/html/h1"})])
    found = {r.page_id: (r.source, r["rank"], r.info["title"]) for r in run.results.collect()}
    assert found == {0: ("stored", 1, GOOD), 1: ("stored", 2, GOOD), 2: ("stored", 2, "only a title")}
    assert run.results.filter("page_id = 0").first().info == {"title": GOOD, "original": "$ 100"}


def test_no_pages(spark):
    run = induced(spark, [("s", offer(GOOD))][:0])
    assert run.results.count() == 0 and run.templates.count() == 0 and run.counters["pages"] == 0


def test_resolving_by_brute_force(spark):
    rnd = random.Random(8)
    paths = [f"/p{k}" for k in range(8)]
    have = {k: ("st"[k % 2], {p for p in paths if rnd.random() < 0.6}) for k in range(60)}
    templates = [(s, r, {f"t{i}": p for i, p in enumerate(rnd.sample(paths, rnd.randrange(1, 5)))}, None, "x") for s in "st" for r in range(1, 7)]
    found = induction.resolving(spark.createDataFrame([(k, s, p) for k, (s, ps) in have.items() for p in ps], "page_id long, site string, path string"), spark.createDataFrame(templates, induction.TEMPLATE))
    expected = []
    for k, (s, ps) in have.items():
        fits = [r for site, r, t, *_ in templates if site == s and set(t.values()) <= ps]
        expected += [(k, s, min(fits))] if fits else []
    assert rows(found) == sorted(expected)


def test_seed_pages_of_each_site(spark):
    pages = spark.createDataFrame([(k, "big") for k in range(100)] + [(k, "small") for k in range(200, 218)], "page_id long, site string")
    found = rows(induction.seed_pages(pages), "site", "page_id")
    assert [p for s, p in found if s == "small"] == list(range(202, 218)) and len([p for s, p in found if s == "big"]) == 16
    assert [p for s, p in rows(induction.seed_pages(pages, order=F.col("page_id")), "site", "page_id") if s == "big"] == list(range(16))


# Crawls


def graph(spark, rnd, n=60):
    return spark.createDataFrame(sorted({(f"p{rnd.randrange(n)}", f"p{rnd.randrange(n)}", f"t{rnd.randrange(4)}%=[=%") for _ in range(2 * n)}), "src string, dst string, text string").cache()


@pytest.mark.parametrize("options", [{}, {"most_depth": 4}])
def test_a_crawl_that_stops_and_goes_on(spark, options):
    edges = graph(spark, random.Random(2))
    begin = crawl.start(spark.createDataFrame([("p0",), ("p1",)], "url string"))
    whole = crawl.crawl(begin, edges, **options)
    for rounds in (1, 2):
        stopped = crawl.crawl(begin, edges, rounds=rounds, **options)
        assert stopped.filter("not visited").count() > 0
        restored = crawl.parse_frontier(crawl.frontier_text(stopped), stopped.columns)
        assert rows(restored, "url", "linktext") == rows(stopped, "url", "linktext")
        assert rows(crawl.crawl(crawl.start(restored.select("url"), restored), edges, **options)) == rows(whole)


def test_restored_rows_go_on_at_their_own_depths(spark):
    edges = spark.createDataFrame([("a", "b", "B"), ("c", "d", "D"), ("d", "e", "E"), ("v", "w", "W")], "src string, dst string, text string")
    restored = spark.createDataFrame([("a", 1, "/A", False), ("c", 5, "/C", False), ("v", 0, "/V", True)], "url string, depth int, linktext string, visited boolean")
    assert rows(crawl.crawl(crawl.start(restored, restored), edges), "url", "depth", "linktext", "visited") == [("a", 1, "/A", True), ("b", 2, "/A/B", True), ("c", 5, "/C", True), ("d", 6, "/C/D", True), ("e", 7, "/C/D/E", True), ("v", 0, "/V", True)]
    assert rows(crawl.crawl(crawl.start(restored, restored), edges, rounds=1), "url", "visited") == [("a", True), ("b", False), ("c", False), ("v", True)]
    assert crawl.crawl(crawl.start(restored.limit(0)), edges).count() == 0


def test_frontier_text_with_marks(spark):
    rows_in = [("a[=%b", "=]%"), ("%25", "%3D="), ("x", None)]
    df = spark.createDataFrame(rows_in, "url string, text string")
    lines = crawl.frontier_text(df)
    assert rows(crawl.parse_frontier(lines, df.columns)) == sorted((a, b or "") for a, b in rows_in)


# Update states


def brute_states(log):
    found = {}
    for site, _, event, said in sorted(log, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        s = found.setdefault(site, {"state": "absent", "error": None, "data": None, "events": 0, "illegal": 0, "first": None})
        s["events"] += 1
        to = updates.MOVES.get(event, {}).get(s["state"])
        if to is None:
            s["illegal"] += 1
            s["first"] = s["first"] or f"{event or ''} in {s['state']}"
            continue
        s["state"] = to
        if event != "add":
            s["error"] = said if event == "failed" else None
        s["data"] = said if event == "saved" else None if event == "reset" else s["data"]
    return sorted((k, *v.values()) for k, v in found.items())


def test_update_states(spark):
    rnd = random.Random(4)
    log = [(f"s{rnd.randrange(5)}", k * rnd.choice([1, 7]), rnd.choice([*updates.MOVES, "odd", None]), rnd.choice([None, f"said {k}"])) for k in range(400)]
    events = spark.createDataFrame(log, "siteid string, ord int, event string, said string")
    assert rows(updates.advance(None, events)) == brute_states(log) == rows(updates.advance(None, events, step=3))
    early, late = events.filter("ord < 500"), events.filter("ord >= 500")
    assert rows(updates.advance(updates.advance(None, early), late)) == brute_states(log)
    assert rows(updates.advance(updates.advance(None, events), events.limit(0))) == brute_states(log)
    assert updates.advance(None, events.limit(0)).count() == 0
    assert {r.state for r in updates.running(updates.advance(None, events)).collect()} <= {"initializing", "parsing", "extracting"}


# Versions


def test_versions(spark):
    rnd = random.Random(6)
    log = [(rnd.choice("st"), f"u{rnd.randrange(4)}", rnd.randrange(6), k, rnd.choice(["create", "update", "update", "delete"]), rnd.choice([None, f"v{k}"])) for k in range(120)]
    table = versions.history(spark.createDataFrame(log, "siteid string, url string, version int, ord int, op string, title string")).cache()
    states = {}
    for version in range(6):
        now = dict(states.get(version - 1, {}))
        for site, url, _, _, op, title in sorted((r for r in log if r[2] == version), key=lambda r: r[3]):
            if op == "delete":
                now.pop((site, url), None)
            else:
                now[site, url] = title if op == "create" or title is not None else now.get((site, url))
        states[version] = now
        # An update after a deletion has no creation to take values from.
        assert rows(versions.as_of(table, version)) == sorted(((*k, v) for k, v in now.items()), key=lambda r: (r[0], r[1]))
        assert rows(versions.as_of(table, version, "s"), "url") == sorted((u,) for s, u in now if s == "s")
    before, after = states[2], states[5]
    ops = {(r.siteid, r.url): r.op for r in versions.changed_since(table, 2).collect()}
    assert {k for k, op in ops.items() if op == "delete"} == before.keys() - after.keys() and {k for k, op in ops.items() if op == "create"} == after.keys() - before.keys()
    assert {k for k in before.keys() & after.keys() if before[k] != after[k]} <= {k for k, op in ops.items() if op == "update"}


# Encodings

SAID = {
    "gb18030": "北京市朝阳区团购今日特价，只要五十元", "big5": "台北市今日團購特價只要五十元", "shift_jis": "東京のランチが半額になります", "euc-jp": "東京のランチが半額になります", "euc-kr": "서울 오늘의 할인 상품입니다",
    "windows-1251": "Сегодня скидка на обед в центре", "koi8-r": "Сегодня скидка на обед в центре", "windows-1252": "Café “crème” à moitié prix – 5 €", "utf-8": "Grüße aus 北京", "utf-16-le": "plain text", "utf-16-be": "plain text", "ascii": "plain",
}


@pytest.mark.parametrize("name", sorted(SAID))
def test_encodings_without_marks(name):
    text = SAID[name]
    assert charsets.guess(text.encode(name)) == name and charsets.decode(text.encode(name)) == text
    assert charsets.decode(f"<p>price 50 {text} and so on</p>".encode(name)) == f"<p>price 50 {text} and so on</p>"


def test_declared_encodings_and_quotes():
    assert charsets.decode(b'<meta charset="iso-8859-1">\x93q\x94\xe9') == '<meta charset="iso-8859-1">“q”é'
    assert charsets.decode(b'<meta charset="nothing">plain') == '<meta charset="nothing">plain'
    assert charsets.decode("é".encode(), "utf-8") == "é" and charsets.decode(None) is None and charsets.decode(b"") == ""
    assert charsets.decode(b"\xffa\x81b\x8d\x80") is not None  # some text, whatever the bytes


def test_entity_modes(spark):
    said = "&lt;&eacute;&#233;&#x41;&nope; &amp;&#0; a & b;"
    df = spark.createDataFrame([(said,), (None,)], "t string")
    found = {m: [r[0] for r in df.select(charsets.resolve_entities(F.col("t"), m)).collect()] for m in ("html", "xml", "xhtml", "none")}
    assert found == {"html": ["<ééA&nope; &&#0; a & b;", None], "xml": ["<&eacute;éA&nope; &&#0; a & b;", None], "xhtml": ["&lt;ééA&nope; &amp;&#0; a & b;", None], "none": [said, None]}
    with pytest.raises(ValueError):
        charsets.resolve_entities(F.col("t"), "other")


# Stages


def test_cities_and_feeds_as_stages(spark):
    page = "<script>beijing shanghai shenzhen nowhere hangzhou</script>"
    pages = spark.createDataFrame([("http://a/c", page), ("http://b/c", "<p>shenzhen alone</p>")], "url string, html string")
    cities = spark.createDataFrame([(c, c) for c in ("beijing", "shanghai", "shenzhen", "hangzhou")], "cityid string, name string")
    sites = spark.createDataFrame([("a",), ("b",), ("c",)], "siteid string")
    config = '<sites><site id="*"><processor module="cities"><cityurl>http://%s/c</cityurl><url>http://f</url><param>c=%s</param><batchquery>{}</batchquery></processor>{}</site></sites>'
    run = lambda batch, more, **env: pipeline.run_sites(feeds.pipeline_spec(config.format(batch, more)), sites, {"cities": "city_addresses", "feeds": "read_feeds"}, pages=pages, cities=cities, **env)
    assert rows(run(1, ""), "siteid", "url") == [("a", "http://f?c=beijing&c=shanghai&c=shenzhen&c=hangzhou")]
    assert rows(run(0, ""), "url") == [(f"http://f?c={c}",) for c in ("beijing", "hangzhou", "shanghai", "shenzhen")]
    xml = "<urlset><url><loc>u1</loc><title>T</title></url><url><loc>u2</loc></url></urlset>"
    read = spark.createDataFrame([("http://f?c=beijing", xml), ("http://f?c=shanghai", "<urlset></urlset>")], "url string, xml string")
    assert rows(run(0, '<processor module="feeds"/>', feeds=read), "siteid", "ord", "url", "title") == [("a", 1, "u1", "T"), ("a", 2, "u2", None)]


def test_pages_that_could_not_be_read(spark):
    columns = "url string, siteid string, db_flag boolean, ord int"
    df = spark.createDataFrame([("u1", "s", False, 1), ("u2", "s", False, 2), ("u3", "s", True, 3), ("u4", "s", False, 4), ("u5", "s", False, 5)], columns)
    pages = spark.createDataFrame([("u1", "<h1>One</h1>"), ("u3", "<h1>Old</h1>"), ("u4", None), ("u5", "<p>no head")], "url string, html string")
    found = pipeline.run([("enrich_from_pages", {"head": "path:/h1"})], df, pages=pages)
    assert rows(found, "url", "html_flag", "head") == [("u1", True, "<h1>One</h1>"), ("u3", False, None), ("u4", True, None), ("u5", True, None)]


def test_sites_are_crawled_by_their_own_policies(spark):
    site = lambda name, inner: f'<site id="{name}"><starturls><url>http://a/0</url></starturls>{inner}</site>'
    texts = [site("all", ""), site("host", "<domains><s>a</s></domains>"), site("pattern", "<domains><p>a</p></domains><patterns><p>/[0-9]$</p></patterns>"), site("deep", "<maxdepth>2</maxdepth>"), site("few", "<maxpages>3</maxpages>"), '<site id="none"/>']
    policies = feeds.crawl_policies(spark, *texts)
    edges = [("http://a/0", "http://a/1"), ("http://a/0", "http://ab/2"), ("http://a/1", "http://a/10"), ("http://a/1", "https://a/s"), ("http://ab/2", "http://b/3"), ("http://b/3", "http://a/0"), ("http://a/1", "http://a/10"), ("http://a/0", None)]
    names = ["all", "host", "pattern", "deep", "few", "none", "stranger"]
    links = spark.createDataFrame([(n, s, t, "x") for n in names for s, t in edges], "site string, src string, dst string, text string")
    found = {}
    for r in crawl.crawl_sites(policies, links).collect():
        found.setdefault(r.site, {})[r.url] = (r.depth, r.linktext)
    depths = {n: {u.removeprefix("http://"): d for u, (d, _) in rows.items()} for n, rows in found.items()}
    whole = {"a/0": 0, "a/1": 1, "ab/2": 1, "a/10": 2, "b/3": 2}
    assert depths == {"all": whole, "host": {"a/0": 0, "a/1": 1, "a/10": 2}, "pattern": {"a/0": 0, "a/1": 1, "ab/2": 1}, "deep": {"a/0": 0, "a/1": 1, "ab/2": 1}, "few": {"a/0": 0, "a/1": 1, "ab/2": 1}}
    assert found["all"]["http://a/10"][1] == "/x/x"
    assert crawl.crawl_sites(policies, links.limit(0)).count() == 5 and crawl.crawl_sites(policies.limit(0), links).count() == 0
