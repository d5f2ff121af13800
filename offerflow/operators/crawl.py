"""Link graphs: admission rules, reachability, page similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_url, url_host, url_path
from ..sources.tables import cut, large, work_folder

#: Pages of a round, or pages known, up to which Spark may send them to all tasks. More are sorted with what they meet.
FEW = 10_000


def admitted(url: Column, hosts: list[str] = (), host_patterns: list[str] = (), path_patterns: list[str] = ()) -> Column:
    """Scheme ``http``, a listed host or one whose start a pattern matches, and such a path; an empty list lets all pass."""
    host, path = url_host(url), F.when(url_path(url) == "", "/").otherwise(url_path(url))
    of_host = host.isin(*hosts) if hosts else F.lit(not host_patterns)
    for p in host_patterns:
        of_host = of_host | host.rlike(f"^(?:{p})")
    of_path = F.lit(not path_patterns)
    for p in path_patterns:
        of_path = of_path | path.rlike(f"^(?:{p})")
    return url.startswith("http://") & of_host & of_path


def admitted_by(url: Column, policy: str = "policy") -> Column:
    """The same by a row's own policy, a struct with the fields of ``feeds.POLICY``."""
    host, path = url_host(url), F.when(url_path(url) == "", "/").otherwise(url_path(url))
    of = F.col(policy)
    starts = lambda text, patterns: F.exists(patterns, lambda p: F.regexp_like(text, F.concat(F.lit("^(?:"), p, F.lit(")"))))
    any_host = (F.size(of["domains"]) == 0) & (F.size(of["domain_patterns"]) == 0)
    of_host = any_host | F.array_contains(of["domains"], host) | starts(host, of["domain_patterns"])
    return url.startswith("http://") & of_host & ((F.size(of["path_patterns"]) == 0) | starts(path, of["path_patterns"]))


def start(urls: DataFrame, restored: DataFrame | None = None) -> DataFrame:
    """The frontier that a crawl begins from, ``url, depth, linktext, visited``: the rows restored, if there are any given, else the start addresses at depth 0."""
    if restored is not None:
        return restored.select("url", F.col("depth").cast("int").alias("depth"), "linktext", F.col("visited").cast("boolean").alias("visited"))
    return urls.select("url", F.lit(0).alias("depth"), F.lit("").alias("linktext"), F.lit(False).alias("visited")).distinct()


def crawl(frontier: DataFrame, edges: DataFrame, most_depth: int = 0, most_pages: int = 0, rounds: int = 0) -> DataFrame:
    """The frontier after ``rounds`` rounds (0: until nothing is left), as ``start`` gives it, over ``edges(src, dst, text)``.

    Each round takes the unvisited pages of the least depth, those restored at that depth with those found there, joins
    them to the edges and keeps what is not known. A page known already keeps its depth. The link text is that of the way by the
    smallest source. Only rounds of up to ``FEW`` pages may be broadcast. What a round finds is written as files of its own, and the pages known are these files together: no
    round writes again what another found. Where ``edges`` has a ``most_depth`` of its own, it limits the pages that the edge leaves from. Depth 0 of ``most_depth`` and 0 of ``most_pages``: no limit; of the pages of a round that are too many the first by address stay.
    """
    spark = frontier.sparkSession
    folder = work_folder(spark, "crawl")
    schema = "url {}, depth int, linktext string".format(dict(frontier.dtypes)["url"])
    files: list[str] = []

    def append(rows: DataFrame) -> tuple[DataFrame, int]:
        files.append(f"{folder}/round={len(files)}")
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(files[-1])
        return spark.read.schema(schema).parquet(files[-1]), seen.get["n"]

    appended = lambda: spark.read.schema(schema).parquet(folder)

    known = cut(frontier)
    found, begun = known.select("url"), known.count()
    counted, sizes = begun, {}
    restored = {r[0] for r in known.filter("not visited").select("depth").distinct().collect()}  # one number for each level
    done, fresh = [], {}
    while (restored or fresh) and (not rounds or len(done) < rounds):
        depth = min(restored | fresh.keys())
        fronts = [fresh.pop(depth)] if depth in fresh else []
        if depth in restored:
            restored.discard(depth)
            fronts.append(known.filter((F.col("depth") == depth) & ~F.col("visited")).select("url", "depth", "linktext"))
        front = fronts[0] if len(fronts) == 1 else fronts[0].unionByName(fronts[1])
        few = begun + sizes.pop(depth, 0) <= FEW
        done.append(depth)
        if most_depth and depth + 1 >= most_depth:
            continue
        steps = (front if few else large(front)).join(edges, F.col("url") == F.col("src"))
        if "most_depth" in edges.columns:
            steps = steps.filter((F.col("most_depth") == 0) | (F.col("most_depth") > depth + 1))
        steps = steps.groupBy("dst").agg(F.min(F.struct("src", F.concat_ws("/", "linktext", "text").alias("linktext"))).alias("way"))
        before = found.withColumnRenamed("url", "_known")
        new = steps.join(before if counted <= FEW else large(before), F.col("dst") == F.col("_known"), "left_anti")
        new = new.select(F.col("dst").alias("url"), F.lit(depth + 1).alias("depth"), F.col("way.linktext").alias("linktext"))
        if most_pages:
            new = new.orderBy("url").limit(max(0, most_pages - counted))
        rows, n = append(new)
        if n:
            fresh[depth + 1], sizes[depth + 1] = rows, n
            counted += n
        found = known.select("url").unionByName(appended().select("url"))
    every = known
    if files:
        every = every.unionByName(appended().select("url", "depth", "linktext").withColumn("visited", F.lit(False)))
    return every.withColumn("visited", F.col("visited") | F.col("depth").isin(*done) if done else F.col("visited"))


def reachable(seeds: DataFrame, edges: DataFrame, most_depth: int = 0, most_pages: int = 0) -> DataFrame:
    """``url, depth, linktext``: what the seeds (``url``) reach over ``edges(src, dst, text)``, at the least depth."""
    return crawl(start(seeds), edges, most_depth, most_pages).select("url", "depth", "linktext")


def crawl_sites(policies: DataFrame, links: DataFrame) -> DataFrame:
    """``site, url, depth, linktext``: what each site's crawl finds by its policy (``feeds.POLICY``) over ``links(site, src, dst, text)``, the links of the pages read for it.

    Start addresses need not be admitted. All sites go on in the same rounds; those that limit the number of their
    pages, named by the configuration, go one by one. Policies come from the driver and are broadcast, never the links. A site without a policy is not crawled; repeated links count once.
    """
    rows = policies.dropDuplicates(["site"]).select("site", F.struct(*[c for c in policies.columns if c != "site"]).alias("policy"))
    at = lambda url: F.struct("site", F.col(url).alias("url"))
    allowed = links.join(F.broadcast(rows), "site").filter(admitted_by(F.col("dst")))
    # Written once, so that rounds do not try the patterns on every link again.
    edges = cut(allowed.select("site", at("src").alias("src"), at("dst").alias("dst"), "text", F.col("policy.maximum_depth").alias("most_depth")))
    seeds = rows.select("site", F.col("policy.maximum_pages").alias("most_pages"), F.explode("policy.starturls").alias("url")).select("site", "most_pages", at("url").alias("url"))
    found = crawl(start(seeds.filter("most_pages = 0").select("url")), edges)
    for site, most in seeds.filter("most_pages > 0").select("site", "most_pages").distinct().collect():  # of a configuration
        of = F.col("site") == site
        found = found.unionByName(crawl(start(seeds.filter(of).select("url")), edges.filter(of), most_pages=most))
    return found.select("url.site", "url.url", "depth", "linktext")


def next_page(frontier: DataFrame) -> DataFrame:
    """The deepest unvisited page that came first."""
    return frontier.filter(~F.col("visited")).orderBy(F.desc("depth"), "ord").limit(1)


def similar(title_a: Column, title_b: Column, links_a: Column, links_b: Column, most: int = 2) -> Column:
    """Equal titles, and at most two links of the second page, each occurrence counting, that the first lacks."""
    return title_a.eqNullSafe(title_b) & (F.size(F.filter(links_b, lambda x: ~F.array_contains(links_a, x))) <= most)


def collapse_parameters(pages: DataFrame) -> DataFrame:
    """``base, n, collapse``: pages that differ in parameters alone; they collapse if the first two by URL are similar. ``pages(url, title, links)``"""
    rows = pages.select(canonical_url(F.col("url")).alias("base"), "url", "title", "links")
    # Spark keeps the first two of a base in each task before they meet.
    place = F.row_number().over(Window.partitionBy("base").orderBy("url", "title", "links"))
    first_two = rows.withColumn("_place", place).filter("_place <= 2").select("base", F.lit(0).cast("long").alias("n"), F.struct("url", "title", "links").alias("page"))
    sizes = rows.groupBy("base").agg(F.count("*").alias("n")).withColumn("page", F.lit(None).cast(first_two.schema["page"].dataType))
    both = sizes.unionByName(first_two).groupBy("base").agg(F.sum("n").alias("n"), F.min("page").alias("a"), F.max("page").alias("z"))
    return both.select("base", "n", F.when(F.col("n") > 1, similar(F.col("a.title"), F.col("z.title"), F.col("a.links"), F.col("z.links"))).alias("collapse"))


# The marks that end a field and a row.
FIELD, ROW = "[=%", "=]%"
#: No value holds a mark once these are replaced, in this order.
_ESCAPES = (("%", "%25"), ("=", "%3D"))


def frontier_text(frontier: DataFrame, field: str = FIELD, row: str = ROW) -> DataFrame:
    """The frontier as delimited rows (``line``), for exchange. A percent or equals sign within a value is escaped, so that none looks like a mark; null is empty."""
    def said(c):
        value = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for plain, escaped in _ESCAPES:
            value = F.replace(value, F.lit(plain), F.lit(escaped))
        return value

    return frontier.select(F.concat(F.concat_ws(field, *map(said, frontier.columns)), F.lit(row)).alias("line"))


def parse_frontier(lines: DataFrame, columns: list[str], field: str = FIELD, row: str = ROW) -> DataFrame:
    """The rows of such text as text columns; what is cut off before its row mark is left out."""
    parts = F.split(F.regexp_replace("line", re.escape(row) + "$", ""), re.escape(field), -1)
    whole = lines.filter(F.col("line").endswith(row)).withColumn("_parts", parts).filter(F.size("_parts") == len(columns))

    def value(k):
        said = F.col("_parts")[k]
        for plain, escaped in reversed(_ESCAPES):
            said = F.replace(said, F.lit(escaped), F.lit(plain))
        return said

    return whole.select(*[value(k).alias(c) for k, c in enumerate(columns)])


def seed_sample(pages: DataFrame, order: str, size: int = 16, spare: int = 5, seed: int = 0) -> DataFrame:
    """``size`` of the pages at random, each once; the last ones if there are fewer than ``spare`` more."""
    few = pages.limit(size + spare).count() < size + spare
    return pages.orderBy(F.desc(order) if few else F.xxhash64(F.lit(seed), order)).limit(size)
