"""Queries of whole sites: templates induced from many pages, crawls that go on, update states, the structure of markup, versions and encodings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .catalog import part_pages, query
from .functions import charsets
from .operators import crawl, dedup, structure, updates, versions
from .plans import induction, pipeline, views
from .plans.views import SNAPSHOTS, read
from .sources import feeds, markup
from .sources.tables import cut, large

# Induction

_LINES = {"discount": "/html/body/div/div/i[3]", "image": "/html/body/div/img", "items": "/html/body/div/b", "original": "/html/body/div/div/i", "saved": "/html/body/div/div/i[2]", "title": "/html/body/h1"}
#: Two layouts, and pages without a title, which neither fits.
_KIND = "CASE p_size % 4 WHEN 0 THEN 0 WHEN 3 THEN 3 ELSE 1 END"
_INDUCED = f"""WITH p AS (SELECT p_partkey AS page_id, replace(lower(p_brand), '#', '') || '.example.com' AS site, p_size, p_name, {_KIND} AS kind, p_size * 12 + 100 AS original,
    CASE WHEN p_partkey % 3 = 0 AND p_brand NOT LIKE 'Brand#1%' THEN 'region' WHEN {_KIND} = 3 THEN 'title' WHEN p_size <= 10 THEN 'picture' END AS error FROM part),
s AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS place FROM p),
w AS (SELECT site, kind FROM (SELECT site, kind, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, min(page_id)) AS place FROM s WHERE place <= 16 AND error IS NULL GROUP BY site, kind) WHERE place = 1),
t AS (SELECT p.*, CASE WHEN p.site = 'brand11.example.com' AND p.kind = 0 THEN 'stored' WHEN w.kind = p.kind THEN 'probe' END AS first FROM p LEFT JOIN w ON w.site = p.site),
o AS (SELECT DISTINCT site, kind FROM t WHERE first IS NULL AND error IS NULL),
r AS (SELECT t.*, coalesce(first, CASE WHEN o.kind IS NOT NULL THEN 'page' END) AS source FROM t LEFT JOIN o ON o.site = t.site AND o.kind = t.kind)"""


def _induced(spark, d):
    part = read(spark, d, "part")
    size = F.col("p_size") % 4
    pages, pictures, configs, keywords = part_pages(spark, part, F.when(size == 0, 0).when(size == 3, 3).otherwise(1))
    stored = spark.createDataFrame([("brand11.example.com", 0, _LINES), ("brand11.example.com", 1, {})], "site string, ord int, template map<string,string>")
    nodes = markup.html_nodes(pages, texts=False)
    return induction.induce(pages, nodes, stored, configs, keywords, pictures, "off", "$", order=F.col("page_id"))


@query(f"""{_INDUCED} SELECT page_id, site, source, CASE WHEN source IS NULL THEN error END AS error,
  CASE WHEN source IS NOT NULL THEN p_name || ' for $ ' || (original - original // 4) || ' on these days' END AS title, CASE WHEN source IS NOT NULL THEN '$ ' || original END AS original, CASE WHEN source IS NOT NULL THEN '../img/' || page_id || '.jpg' END AS image FROM r""")
def template_induction(spark, d):
    """Pages of two layouts and of none: what a stored template, the vote of seed pages, or the analysis of other pages resolves."""
    found = _induced(spark, d).results
    return found.select("page_id", "site", "source", "error", *[F.col("info")[c].alias(c) for c in ("title", "original", "image")])


@query(f"{_INDUCED} SELECT site, kind = 0 AS lines, any_value(source) AS source, count(*) AS pages FROM r WHERE source IS NOT NULL GROUP BY site, kind")
def induced_templates(spark, d):
    """The templates that serve a page, as they are stored."""
    found = _induced(spark, d).templates
    return found.select("site", F.map_contains_key("template", F.lit("discount")).alias("lines"), "source", "pages")


@query(f"""{_INDUCED} SELECT count(*) AS pages, count(source) AS resolved, count(*) FILTER (WHERE source = 'stored') AS stored, count(*) FILTER (WHERE source = 'probe') AS probe,
  count(*) FILTER (WHERE source = 'page') AS page, count(*) FILTER (WHERE source IS NULL) AS failed FROM r""")
def induction_counters(spark, d):
    """What the pass that wrote the results counted."""
    counted = _induced(spark, d).counters
    return spark.createDataFrame([tuple(counted.values())], ", ".join(f"{k} long" for k in counted))


# Crawls


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey * 2 + k AS dst, p_brand AS text FROM part, (VALUES (0), (1)) t(k)),
r(url, depth, linktext) AS (SELECT 1::BIGINT, 0, '' UNION ALL SELECT dst, depth + 1, linktext || '/' || text FROM r JOIN e ON src = url)
SELECT CAST(url AS VARCHAR) AS url, depth, linktext, true AS visited FROM r""")
def crawl_resumed(spark, d):
    """A crawl of parts that stops after three rounds, is stored as text, and goes on from it: the same as one that never stopped."""
    key = F.col("p_partkey")
    edges = read(spark, d, "part").select(key.cast("string").alias("src"), F.explode(F.array((key * 2).cast("string"), (key * 2 + 1).cast("string"))).alias("dst"), F.col("p_brand").alias("text"))
    stopped = crawl.crawl(crawl.start(spark.createDataFrame([("1",)], "url string")), edges, rounds=3)
    restored = crawl.parse_frontier(crawl.frontier_text(stopped), stopped.columns)
    return crawl.crawl(crawl.start(restored.select("url"), restored), edges)


@query("""WITH n AS (SELECT p_partkey, p_name || '[=%' || p_brand AS name FROM part) SELECT p_partkey, name, CASE WHEN name LIKE '%a%' THEN '50%=' || name END AS other FROM n""")
def frontier_escapes(spark, d):
    """Values that hold the marks of a frontier's text, written and read back; null comes back as empty."""
    name = F.concat("p_name", F.lit("[=%"), "p_brand")
    rows = read(spark, d, "part").select("p_partkey", name.alias("name"), F.when(name.contains("a"), F.concat(F.lit("50%="), name)).alias("other"))
    found = crawl.parse_frontier(crawl.frontier_text(rows), rows.columns)
    return found.select(F.col("p_partkey").cast("long").alias("p_partkey"), "name", F.nullif("other", F.lit("")).alias("other"))


_POLICIES = """<sites><site id="one"><starturls><url>http://h1.example.com/part/1</url></starturls><domains><s>h0.example.com</s><s>h1.example.com</s><s>h2.example.com</s></domains><patterns/><maxdepth>6</maxdepth><maxpages>0</maxpages></site>
<site id="two"><starturls><url>http://h1.example.com/part/1</url></starturls><domains><p>h[0-2]</p></domains><patterns><p>/part/[0-9]*[0-4]$</p><p>/part/[0-9]*[67]$</p></patterns><maxdepth>0</maxdepth><maxpages>0</maxpages></site>
<site id="three"><starturls><url>http://h1.example.com/part/1</url></starturls><domains/><patterns/><maxdepth>3</maxdepth><maxpages>0</maxpages></site></sites>"""


@query("""WITH RECURSIVE s(site, most) AS (VALUES ('one', 6), ('two', 0), ('three', 3)), e AS (SELECT p_partkey AS src, p_partkey * 2 + x AS dst, p_brand AS text FROM part, (VALUES (0), (1)) t(x)),
r(site, most, k, depth, linktext) AS (SELECT site, most, 1::BIGINT, 0, '' FROM s UNION ALL SELECT site, most, dst, depth + 1, linktext || '/' || text FROM r JOIN e ON src = k
  WHERE (most = 0 OR depth + 1 < most) AND CASE site WHEN 'one' THEN dst % 4 < 3 WHEN 'two' THEN dst % 4 < 3 AND dst % 10 IN (0, 1, 2, 3, 4, 6, 7) ELSE true END)
SELECT site, 'http://h' || (k % 4) || '.example.com/part/' || k AS url, depth, linktext FROM r""")
def crawl_by_policies(spark, d):
    """Three sites crawled at once over the parts, each by its own hosts, paths and depth, as a configuration gives them."""
    policies = feeds.crawl_policies(spark, _POLICIES)
    url = lambda k: F.concat(F.lit("http://h"), (k % 4).cast("string"), F.lit(".example.com/part/"), k.cast("string"))
    key = F.col("p_partkey")
    links = read(spark, d, "part").select(F.explode(F.array(*map(F.lit, ("one", "two", "three")))).alias("site"), key, F.col("p_brand").alias("text"))
    links = links.select("site", url(key).alias("src"), F.explode(F.array(url(key * 2), url(key * 2 + 1))).alias("dst"), "text")
    return crawl.crawl_sites(policies, links)


# Update states

_UPDATES = """WITH RECURSIVE log AS (SELECT user_id AS siteid, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, event_id AS ord, 'v' || event_id AS said,
  CASE WHEN event_type = 'signup' AND value > 60 THEN 'reset' WHEN event_type = 'click' AND value > 40 THEN 'saved' ELSE CASE event_type WHEN 'signup' THEN 'add' WHEN 'view' THEN 'start' WHEN 'click' THEN 'parsed' WHEN 'purchase' THEN 'done' ELSE 'failed' END END AS event FROM events),
r AS (SELECT siteid, 0::BIGINT AS step, 'absent' AS state, NULL::VARCHAR AS error, NULL::VARCHAR AS data, 0::BIGINT AS illegal, NULL::VARCHAR AS first_illegal FROM (SELECT DISTINCT siteid FROM log)
  UNION ALL
  SELECT siteid, step, CASE WHEN legal THEN next ELSE state END, CASE WHEN legal AND event <> 'add' THEN CASE WHEN event = 'failed' THEN said END ELSE error END,
    CASE WHEN legal AND event = 'saved' THEN said WHEN legal AND event = 'reset' THEN NULL ELSE data END, illegal + CASE WHEN legal THEN 0 ELSE 1 END, coalesce(first_illegal, CASE WHEN NOT legal THEN event || ' in ' || state END)
  FROM (SELECT r.siteid, log.step, event, said, state, error, data, illegal, first_illegal,
    CASE event WHEN 'add' THEN CASE WHEN state = 'absent' THEN 'initializing' ELSE state END WHEN 'start' THEN 'parsing' WHEN 'parsed' THEN 'extracting' WHEN 'saved' THEN 'extracting' WHEN 'done' THEN 'finished' WHEN 'failed' THEN 'error' ELSE 'absent' END AS next,
    event IN ('add', 'reset') OR event = 'start' AND state = 'initializing' OR event = 'parsed' AND state = 'parsing' OR event IN ('saved', 'done') AND state = 'extracting' OR event = 'failed' AND state IN ('initializing', 'parsing', 'extracting') AS legal
    FROM r JOIN log ON log.siteid = r.siteid AND log.step = r.step + 1)),
final AS (SELECT siteid, state, error, data, step AS events, illegal, first_illegal FROM r QUALIFY row_number() OVER (PARTITION BY siteid ORDER BY step DESC) = 1)"""


def _update_log(spark, d):
    kind = F.create_map(*[F.lit(x) for pair in (("signup", "add"), ("view", "start"), ("click", "parsed"), ("purchase", "done"), ("error", "failed")) for x in pair])[F.col("event_type")]
    event = F.when((F.col("event_type") == "signup") & (F.col("value") > 60), "reset").when((F.col("event_type") == "click") & (F.col("value") > 40), "saved").otherwise(kind)
    return read(spark, d, "events").select(F.col("user_id").alias("siteid"), F.col("event_id").alias("ord"), event.alias("event"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("said"))


@query(f"{_UPDATES} SELECT * FROM final")
def update_states(spark, d):
    """Users as sites whose updates begin, go on, fail and end; events that a state does not allow are named."""
    return updates.advance(None, _update_log(spark, d))


@query(f"{_UPDATES} SELECT * FROM final WHERE state IN ('initializing', 'parsing', 'extracting')")
def updates_to_resume(spark, d):
    """The states after the first half of the events was folded, and then the rest from there: of those sites that are still running."""
    log = _update_log(spark, d)
    half = F.lit(updates.halfway(log))
    early, late = log.filter(F.col("ord") <= half), log.filter(F.col("ord") > half)
    return updates.running(updates.advance(updates.advance(None, early), late))


# Structure of markup

_TAGS = r"""WITH k AS (SELECT page_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<(?:/?(?:nav|ul|li|article|h1)[ >]|a [^>]*>|/a>)') AS toks FROM pages)),
n AS (SELECT page_id, pos, regexp_extract(tok, '</?([a-z0-9]+)', 1) AS name, tok LIKE '</%' AS closes, regexp_extract(tok, 'href="([^"]*)"', 1) AS href FROM k),
m AS (SELECT *, row_number() OVER (PARTITION BY page_id, name, closes ORDER BY pos) AS nth FROM n),
tags AS (SELECT o.page_id, o.pos AS start, c.pos AS stop, o.name, o.href FROM m o JOIN m c ON c.page_id = o.page_id AND c.name = o.name AND c.nth = o.nth AND c.closes AND NOT o.closes)"""


@query(rf"""{_TAGS} SELECT a.page_id, a.href,
  (SELECT string_agg(t.name, ' ' ORDER BY t.start) FROM tags t WHERE t.page_id = a.page_id AND t.start < a.start AND t.stop > a.stop AND t.name IN ('nav', 'ul', 'li', 'article')) AS around,
  (SELECT t.href FROM tags t WHERE t.page_id = a.page_id AND t.name = 'a' AND t.start > a.start ORDER BY t.start LIMIT 1) AS next_link,
  (SELECT string_agg(t.href, ' ' ORDER BY t.start DESC) FROM (SELECT * FROM tags u WHERE u.page_id = a.page_id AND u.name = 'a' AND u.start < a.start ORDER BY u.start DESC LIMIT 2) t) AS links_before,
  (SELECT count(*) FROM tags t WHERE t.page_id = a.page_id AND t.name = 'h1' AND t.start > a.start) > 0 AS heading_after,
  (SELECT count(*) FROM tags t WHERE t.page_id = a.page_id AND t.name = 'a' AND EXISTS (SELECT 1 FROM tags n WHERE n.page_id = a.page_id AND n.name = 'nav' AND n.start < a.start AND n.stop > a.stop AND n.start < t.start AND n.stop > t.stop)) AS in_nav
FROM tags a WHERE a.name = 'a'""")
def structural_joins(spark, d):
    """Links of real pages with what is around, before and after them: parents by name, next and previous in document order, descendants of a parent."""
    nodes = markup.html_nodes(read(spark, d, "pages"), wanted=markup.Wanted(name=["nav", "ul", "li", "a", "article", "h1"]), texts=False)
    nodes = cut(nodes.select("page_id", "ord", "last", "depth", "kind", "name", "attrs"))  # read many times, parsed once
    key = ["page_id", "ord"]
    a = markup.find_all(nodes, "a").select(*key, "last", F.col("attrs")["href"].alias("href"))
    parents = markup.ancestors(nodes, a, name=["nav", "ul", "li", "article"])
    around = parents.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("depth", "name")))["name"], " ").alias("around"))
    after = structure.following(a, a, carry=("href",)).select(*key, F.col("href").alias("next_link"))
    before = structure.preceding(a, a, 2, carry=("href",)).groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "href")))["href"], " ").alias("links_before"))
    heads = structure.following(a, markup.find_all(nodes, "h1")).select(*key, F.lit(True).alias("heading_after"))
    nav = structure.contained(a, markup.find_all(nodes, "nav"), nearest=True)
    held = markup.descendants(nodes, markup.find_all(nodes, "nav"), name="a").groupBy("page_id", F.col("ord").alias("top")).agg(F.count("*").alias("in_nav"))
    met = a.select(*key, "href")
    for more in (around, after, before, heads, nav.join(large(held), ["page_id", "top"]).select(*key, "in_nav")):
        met = met.join(large(more), key, "left")
    return met.select("page_id", "href", "around", "next_link", "links_before", F.coalesce("heading_after", F.lit(False)).alias("heading_after"), F.coalesce("in_nav", F.lit(0)).alias("in_nav"))


@query(r"""WITH b AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '<li>.*?</li>'), regexp_extract_all(html, '<div class="ad">[^<]*</div>'))) AS block FROM pages)
SELECT regexp_extract(block, '<([a-z]+)', 1) AS name, trim(regexp_replace(block, '<[^>]*>', '', 'g')) AS text, count(*) AS n, count(DISTINCT page_id) AS pages FROM b GROUP BY block HAVING count(*) > 1""")
def repeated_blocks(spark, d):
    """List items and advertisements of real pages that are the same tree, with their counts."""
    nodes = markup.html_nodes(read(spark, d, "pages"), wanted=markup.Wanted(name=["li", "div"]), digests=True)
    blocks = nodes.filter("name = 'li' or attrs['class'] = 'ad'")
    return structure.repeated(blocks).select("name", "text", "n", "pages")


@query("""SELECT page_id, unnest(list_filter(regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1), lambda x: regexp_matches(x, '^/[a-m]'))) AS href FROM pages""")
def parsed_subset(spark, d):
    """Links to addresses of a kind: only they leave the parse."""
    nodes = markup.html_nodes(read(spark, d, "pages"), wanted=markup.Wanted(name="a", attrs={"href": re.compile("^/[a-m]")}), texts=False)
    return nodes.select("page_id", F.col("attrs")["href"].alias("href"))


@query("""WITH t AS (SELECT page_id, unnest([['li', '/html/body/nav/ul'], ['a', CASE WHEN len(regexp_extract_all(html, '<li>')) > 1 THEN '/html/body/nav/ul' ELSE '/html/body/nav/ul/li' END], ['title', '/html/head']]) AS x, len(regexp_extract_all(html, '<li>')) AS n FROM pages)
SELECT page_id, x[1] AS name, x[2] AS path FROM t WHERE n > 0 OR x[1] = 'title'""")
def common_paths(spark, d):
    """Of each page the tag around all its list items, all its links, and its title."""
    nodes = markup.html_nodes(read(spark, d, "pages"), wanted=markup.Wanted(name=["li", "a", "title"]), texts=False)
    return structure.common_path(nodes, ["page_id", "name"])


@query("""WITH p AS (SELECT p_partkey AS page_id, p_name, p_size, '<div id="' || p_partkey || '"><p>' || p_name || ' </p><br><b>' || p_size || '<i>x</i></b><!--c--></div>' AS html FROM part)
SELECT page_id, ord, parent, last, depth, kind, name, path, text, string FROM p, LATERAL (VALUES
  (0, -1, 8, 0, 'tag', 'div', '/div', trim(p_name) || p_size || 'xc', NULL), (1, 0, 2, 1, 'tag', 'p', '/div/p', trim(p_name), p_name || ' '), (2, 1, 2, 2, 'text', NULL, '/div/p', p_name || ' ', p_name || ' '),
  (3, 0, 3, 1, 'tag', 'br', '/div/br', '', NULL), (4, 0, 7, 1, 'tag', 'b', '/div/b', p_size || 'x', NULL), (5, 4, 5, 2, 'text', NULL, '/div/b', p_size::VARCHAR, p_size::VARCHAR),
  (6, 4, 7, 2, 'tag', 'i', '/div/b/i', 'x', 'x'), (7, 6, 7, 3, 'text', NULL, '/div/b/i', 'x', 'x'), (8, 0, 8, 1, 'comment', NULL, '/div', 'c', 'c')) v(ord, parent, last, depth, kind, name, path, text, string)""")
def node_rows(spark, d):
    """Parts as small pages, and all their node rows."""
    html = F.format_string('<div id="%d"><p>%s </p><br><b>%d<i>x</i></b><!--c--></div>', "p_partkey", "p_name", "p_size")
    nodes = markup.html_nodes(read(spark, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))
    return nodes.select("page_id", "ord", "parent", "last", "depth", "kind", "name", "path", "text", "string")


@query("""SELECT p_partkey AS page_id, ord, parent, kind, name, href, text FROM part, LATERAL (VALUES (0, -1, 'decl', NULL, NULL, 'DOCTYPE d' || p_size), (1, -1, 'tag', 'div', NULL, p_name || p_size), (2, 1, 'tag', 'a', 'x/' || p_partkey, ''),
  (3, 1, 'text', NULL, NULL, p_name), (4, 1, 'tag', 'a', 'y/', ''), (5, 1, 'comment', NULL, NULL, p_size::VARCHAR)) v(ord, parent, kind, name, href, text)""")
def malformed_tags(spark, d):
    """Parts as small pages whose tags end in a slash right after a value, and whose declarations and comments begin with a blank."""
    html = F.format_string('<! DOCTYPE d%d><div><a href=x/%d/>%s<a href="y/"/><! --%d--></div>', "p_size", "p_partkey", "p_name", "p_size")
    nodes = markup.html_nodes(read(spark, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))
    return nodes.select("page_id", "ord", "parent", "kind", "name", F.col("attrs")["href"].alias("href"), "text")


# Pages as stages of configured pipelines


@query("""WITH p AS (SELECT *, regexp_extract(url, '/([a-z][a-z])/', 1) AS siteid, url LIKE '%?%' AS db_flag, url NOT LIKE 'http:%' AND url LIKE '%#%' AS failed FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY siteid, db_flag ORDER BY page_id) AS turn FROM p)
SELECT page_id AS ord, siteid, NOT db_flag AS html_flag, CASE WHEN NOT db_flag THEN regexp_extract(html, '<title>.*?</title>', 0, 's') END AS head, CASE WHEN NOT db_flag THEN nullif(regexp_extract(html, '<div class="ad">[^<]*</div>', 0), '') END AS ad
FROM n WHERE db_flag OR turn <= 50 AND NOT failed""")
def enriched_pages(spark, d):
    """Real pages as offers: of each language at most fifty new ones get fields of their pages, those whose page could not be read go, the known ones stay behind them."""
    pages = read(spark, d, "pages")
    key = F.concat(F.lit("http://offers.example.com/"), F.col("page_id").cast("string"))
    rows = pages.select(key.alias("url"), F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("siteid"), F.col("url").contains("?").alias("db_flag"), F.col("page_id").alias("ord"))
    read_ones = pages.filter(~(~F.col("url").startswith("http:") & F.col("url").contains("#"))).select(key.alias("url"), "html")
    config = '<sites><site id="*"><processor module="pages"><head>path:/html/head/title</head><ad>class:ad</ad></processor></site></sites>'
    found = pipeline.run_sites(feeds.pipeline_spec(config), rows, {"pages": "enrich_from_pages"}, pages=read_ones)
    return found.select("ord", "siteid", "html_flag", "head", "ad")


@query("""WITH g AS (SELECT p_partkey // 100 AS k, list_prepend('list', regexp_extract_all(string_agg(p_name, ' ' ORDER BY p_partkey), '[a-zA-Z]+')) AS words, min_by(p_brand, p_partkey) AS brand FROM part GROUP BY 1),
c AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS city FROM part),
u AS (SELECT k, unnest(words) AS city, generate_subscripts(words, 1) AS place FROM g WHERE brand NOT LIKE 'Brand#1%' AND list_contains(words, 'cold') AND list_contains(words, 'small') AND list_contains(words, 'large')),
n AS (SELECT k, city, row_number() OVER (PARTITION BY k ORDER BY place) - 1 AS pos FROM u WHERE city IN (SELECT city FROM c)),
b AS (SELECT k, pos // 11 AS batch, 'http://feeds?' || string_agg('c=' || city, '&' ORDER BY pos) AS url, min(city) AS title FROM n GROUP BY 1, 2)
SELECT 'site' || k AS siteid, title, count(*) AS n FROM b GROUP BY ALL""")
def city_discovery(spark, d):
    """A configured pipeline that begins with the pages that list a site's cities: eleven cities to a feed, whose records are read. Sites whose page is missing have none."""
    part = read(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("k"), "p_partkey", "p_name", "p_brand")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " ")
    groups = part.groupBy("k").agg(names.alias("names"), F.min_by("p_brand", "p_partkey").alias("brand"))
    site = F.concat(F.lit("site"), F.col("k").cast("string"))
    pages = groups.filter("brand not like 'Brand#1%'").select(F.concat(F.lit("http://"), site, F.lit("/cities")).alias("url"), F.format_string("<html><p>towns</p><script>list %s</script></html>", "names").alias("html"))
    cities = read(spark, d, "part").select(F.substring_index("p_name", " ", 1).alias("cityid")).distinct()
    config = """<sites><site id="*"><processor module="city_html"><cityurl>http://%s/cities</cityurl><url>http://feeds</url><param>c=%s</param><batchquery>1</batchquery></processor>
      <processor module="feeds"/></site></sites>"""
    spec = {s: [(m, p | {"anchor": "list", "samples": ("cold", "small", "large")} if m == "city_html" else p) for m, p in steps] for s, steps in feeds.pipeline_spec(config).items()}
    sites = groups.select(site.alias("siteid"))
    env = {"pages": pages, "cities": cities}
    # What is at the addresses: a feed of one record, named by the first of its cities.
    addresses = pipeline.run([("city_addresses", dict(spec["*"][0][1]))], sites, **env).select("url").distinct()
    first = F.array_min(F.regexp_extract_all("url", F.lit("c=([a-zA-Z]+)"), F.lit(1)))
    env["feeds"] = addresses.select("url", F.concat(F.lit("<urlset><url><loc>x</loc><data><title>"), first, F.lit("</title></data></url></urlset>")).alias("xml"))
    found = pipeline.run_sites(spec, sites, {"city_html": "city_addresses", "feeds": "read_feeds"}, **env)
    return found.groupBy("siteid", "title").agg(F.count("*").alias("n"))


@query("SELECT r_name AS site, 'k' || (n_nationkey % 2) AS attribute, string_agg(DISTINCT n_name, ';' ORDER BY n_name) AS keywords FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def keyword_lists(spark, d):
    """Nations as the keywords of their regions, each written twice, read from a configuration."""
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    word = F.format_string("<k%d>%s</k%d>", F.col("n_nationkey") % 2, F.col("n_name"), F.col("n_nationkey") % 2)
    site = rows.groupBy("r_name").agg(F.array_join(F.collect_list(F.concat(word, word, F.lit("<k0> </k0>"))), "").alias("words"))
    text = "".join(f'<site id="{r.r_name}">{r.words}</site>' for r in site.collect())  # a configuration: five sites
    found = feeds.keyword_map(spark, f"<sites>{text}</sites>")
    return found.select("site", "attribute", F.array_join(F.sort_array("keywords"), ";").alias("keywords"))


@query(f"""{SNAPSHOTS}, s AS (SELECT siteid, title, city, url, ord, 0 AS late FROM stored UNION ALL SELECT siteid, title, city, url, ord, 1 FROM feed),
c AS (SELECT siteid, title, city, min((late, ord)) AS first FROM s GROUP BY ALL)
SELECT siteid, title, list_reduce(list(city ORDER BY first), lambda acc, c: CASE WHEN contains(acc, c) THEN acc ELSE acc || ',' || c END) AS city, (SELECT arg_min(url, (late, ord)) FROM s WHERE s.siteid = c.siteid AND s.title = c.title) AS url FROM c GROUP BY siteid, title""")
def fold_onto_a_store(spark, d):
    """The feed folded onto what is stored: stored rows come first and take the cities that they lack."""
    columns = ["siteid", "title", "city", "url", "ord"]
    return dedup.fold_onto(views.stored(spark, d).select(columns), views.feed(spark, d).select(columns), ["siteid", "title"]).select("siteid", "title", "city", "url")


# Versions

_VERSIONS = """WITH changes AS (SELECT o_orderpriority AS siteid, o_custkey AS url, year(o_orderdate) AS version, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'create' WHEN 'O' THEN 'update' ELSE 'delete' END AS op,
  CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price, o_orderkey AS last FROM orders),
s AS (SELECT *, sum(CASE WHEN op <> 'update' THEN 1 ELSE 0 END) OVER (PARTITION BY siteid, url ORDER BY version, ord) AS life FROM changes),
w AS (SELECT *, max(CASE WHEN price IS NOT NULL AND op <> 'delete' THEN n END) OVER (PARTITION BY siteid, url, life ORDER BY n) AS at FROM (SELECT *, row_number() OVER (PARTITION BY siteid, url ORDER BY version, ord) AS n FROM s)),
v AS (SELECT w.siteid, w.url, w.version, w.n, w.op, w.last, p.price, lead(w.version) OVER (PARTITION BY w.siteid, w.url ORDER BY w.n) AS next FROM w LEFT JOIN s0 p ON p.siteid = w.siteid AND p.url = w.url AND p.n = w.at),
h AS (SELECT siteid, url, price, last, version AS valid_from, next AS valid_to FROM v WHERE op <> 'delete' AND (next IS NULL OR next > version))""".replace(
    "v AS (SELECT w.siteid", "s0 AS (SELECT siteid, url, n, price FROM w), v AS (SELECT w.siteid")


def _history(spark, d):
    op = F.when(F.col("o_orderstatus") == "F", "create").when(F.col("o_orderstatus") == "O", "update").otherwise("delete")
    changes = read(spark, d, "orders").select(F.col("o_orderpriority").alias("siteid"), F.col("o_custkey").alias("url"), F.year("o_orderdate").alias("version"), F.col("o_orderkey").alias("ord"), op.alias("op"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"), F.col("o_orderkey").alias("last"))
    return versions.history(changes)


@query(f"{_VERSIONS} SELECT * FROM h")
def version_history(spark, d):
    """Orders as changes to their customers' rows, versions by year, sites by priority."""
    return _history(spark, d)


@query(f"{_VERSIONS} SELECT siteid, url, price, last FROM h WHERE valid_from <= 1996 AND (valid_to IS NULL OR valid_to > 1996) AND siteid = '1-URGENT'")
def table_as_of(spark, d):
    return versions.as_of(_history(spark, d), 1996, "1-URGENT")


@query(f"""{_VERSIONS}, b AS (SELECT siteid, url FROM h WHERE valid_from <= 1996 AND (valid_to IS NULL OR valid_to > 1996)), n AS (SELECT siteid, url, valid_from FROM h WHERE valid_to IS NULL),
x AS (SELECT siteid, url, CASE WHEN n.url IS NULL THEN 'delete' WHEN b.url IS NULL THEN 'create' WHEN valid_from > 1996 THEN 'update' END AS op, n.valid_from FROM (SELECT siteid, url FROM b UNION SELECT siteid, url FROM n) k
  LEFT JOIN b USING (siteid, url) LEFT JOIN n USING (siteid, url)) SELECT siteid, url, op FROM x WHERE op IS NOT NULL""")
def changes_since_a_version(spark, d):
    return versions.changed_since(_history(spark, d), 1996)


# Encodings

_SAID = {"gb18030": "北京今日团购特价，只要", "big5": "台北今日團購特價只要", "euc-jp": "東京のランチが半額になります", "windows-1251": "Сегодня скидка на обед ", "windows-1252": "Café “crème” à moitié – "}
_KINDS = [*_SAID, "utf-8", "utf-16-le", "utf-16-be", "ascii"]


@query("SELECT p_partkey, CASE p_size % 9 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_KINDS)) + " END AS charset, CASE p_size % 9 " + " ".join(f"WHEN {k} THEN '{_SAID[n]}' || p_name" for k, n in enumerate(_KINDS) if n in _SAID) + " WHEN 5 THEN 'é漢' || p_name ELSE p_name END AS decoded FROM part")
def detected_charsets(spark, d):
    """Texts in nine encodings without a mark or a declaration."""
    kind, name = F.col("p_size") % 9, F.col("p_name")
    plain = F.encode(name, "UTF-8")
    data = F.when(kind == 5, F.encode(F.concat(F.lit("é漢"), name), "UTF-8")).when(kind == 6, F.encode(name, "UTF-16LE")).when(kind == 7, F.encode(name, "UTF-16BE")).when(kind == 8, plain)
    for k, n in enumerate(_SAID):
        data = data.when(kind == k, F.concat(F.unhex(F.lit(_SAID[n].encode(n).hex())), plain))
    found = read(spark, d, "part").select("p_partkey", data.alias("data"))
    return found.select("p_partkey", charsets.detected_charset("data").alias("charset"), charsets.decode_markup("data").alias("decoded"))


@query("""SELECT p_partkey, p_name || ' <b>é' || chr(65) || '& "' || p_size || '&nope;' AS html, p_name || ' <b>&eacute;' || chr(65) || '& "' || p_size || '&nope;' AS xml, p_name || ' &lt;b&gt;é' || chr(65) || '&amp; &quot;' || p_size || '&nope;' AS xhtml FROM part""")
def entity_modes(spark, d):
    """Named, numbered and unknown entities in the modes of a parser."""
    said = F.concat("p_name", F.lit(" &lt;b&gt;&eacute;&#x41;&amp; &quot;"), F.col("p_size").cast("string"), F.lit("&nope;"))
    return read(spark, d, "part").select("p_partkey", *[charsets.resolve_entities(said, m).alias(m) for m in ("html", "xml", "xhtml")])
