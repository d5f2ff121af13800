"""Feeds, dimensions and configurations in XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .markup import html_nodes
from .tables import cut, large

# Names of the feed's elements and of the columns that they fill.
FEED_FIELDS = {
    "loc": "url", "website": "sitename", "city": "city", "category": "category", "address": "address", "title": "title", "image": "image",
    "starttime": "starttime", "endtime": "duetime", "value": "original", "price": "current", "rebate": "discount", "bought": "bought",
}


def parse_feeds(feeds: DataFrame, key: str = "feed_id", column: str = "xml") -> DataFrame:
    """A record for each ``url`` element, well-formed or not; a later element of one name wins; null feeds give nothing."""
    nodes = html_nodes(feeds, key, column, xml=True).filter(F.col("name").isin("url", *FEED_FIELDS))
    nodes = cut(nodes.select(key, "ord", "kind", "name", "path", F.when(F.col("name") != "url", F.col("text")).alias("text")))
    items = nodes.filter("kind = 'tag' and name = 'url'").select(key, F.col("ord").alias("item"), F.concat("path", F.lit("/")).alias("below"))
    parts = nodes.filter(F.col("name").isin(*FEED_FIELDS)).select(key, "ord", "name", "path", "text")
    inside = parts.withColumn("below", F.regexp_extract("path", r"^(.*/url(\[\d+\])?/)", 1)).join(large(items), [key, "below"])
    return inside.groupBy(key, "item").agg(*[F.max_by("text", F.when(F.col("name") == n, F.col("ord"))).alias(c) for n, c in FEED_FIELDS.items()])


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed feed files through the XML source: rows are split within large files."""
    schema = ", ".join(f"`{n}` string" for n in FEED_FIELDS)
    return spark.read.format("xml").option("rowTag", "url").schema(schema).load(path).withColumnsRenamed(FEED_FIELDS)


def dimension(spark: SparkSession, text: str, tag: str, id_name: str = "id") -> DataFrame:
    """``id, name, ord`` of a small list such as cities; names are trimmed. An element without an id has its name for one."""
    rows = [(e.get(id_name) or (e.text or "").strip(), (e.text or "").strip(), k) for k, e in enumerate(ET.fromstring(text).iter(tag))]
    return spark.createDataFrame(rows, "id string, name string, ord int")


def keyword_map(spark: SparkSession, text: str) -> DataFrame:
    """``site, attribute, keywords, ord``: distinct keywords of each attribute; empty ones are skipped."""
    rows, n = {}, 0
    for site in ET.fromstring(text):
        for e in site:
            word = (e.text or "").strip()
            if word:
                entry = rows.setdefault((site.get("id") or site.tag, e.tag), (len(rows), []))
                if word not in entry[1]:
                    entry[1].append(word)
    return spark.createDataFrame([(s, a, w, k) for (s, a), (k, w) in rows.items()], "site string, attribute string, keywords array<string>, ord int")


def pipeline_spec(text: str) -> dict[str, list[tuple[str, dict[str, str]]]]:
    """``site: [(stage, parameters)]`` from ``<site id><processor module><param>…``."""
    return {site.get("id"): [(p.get("module"), {e.tag: (e.text or "").strip() for e in p}) for p in site.iter("processor")] for site in ET.fromstring(text).iter("site")}


POLICY = "site string, starturls array<string>, domains array<string>, domain_patterns array<string>, path_patterns array<string>, maximum_depth int, maximum_pages int"


def crawl_policy(text: str) -> dict:
    """The first of ``crawl_policies`` of a configuration."""
    return _policies(text)[0]


def crawl_policies(spark: SparkSession, *texts: str) -> DataFrame:
    """A row of ``POLICY`` for each ``<site id>`` of the configurations: start addresses, hosts, patterns of hosts and of paths, depth and pages (0: no limit)."""
    return spark.createDataFrame([tuple(policy.values()) for text in texts for policy in _policies(text)], POLICY)


def _policies(text: str) -> list[dict]:
    """Of each site ``<starturls><url>``, ``<domains>`` with ``<s>`` for a host and ``<p>`` for a pattern, ``<patterns><p>``, ``<maxdepth>`` and ``<maxpages>``; what is missing or empty limits nothing."""
    root = ET.fromstring(text.strip().encode())
    said = lambda site, path: [word for e in site.findall(path) if (word := (e.text or "").strip())]
    number = lambda site, tag: int((said(site, tag) or [0])[0])
    return [
        {"site": site.get("id"), "starturls": said(site, "starturls/url"), "domains": said(site, "domains/s"), "domain_patterns": said(site, "domains/p"), "path_patterns": said(site, "patterns/p"), "maximum_depth": number(site, "maxdepth"), "maximum_pages": number(site, "maxpages")}
        for site in root.iter("site")
    ]
