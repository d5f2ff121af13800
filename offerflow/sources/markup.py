"""Tolerant markup: HTML or XML text as node rows, from one pass over each page.

The tree is built from the events of the standard library's parser; a page
gives rows ``(ord, parent, last, depth, kind, name, path, attrs, text, string, begin, end, said_from, said_to, said)``:
``last`` is the last node below, ``begin`` and ``end`` are character places in the markup, ``said_from``
and ``said_to`` those in the page's joined and stripped texts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.charsets import decode_markup  # noqa: F401 - reading bytes is part of reading markup
from .tables import dealt, large

# How elements nest. Void elements have no content; quoted ones hold plain text; others close what they reset.
VOID = frozenset(["br", "hr", "input", "img", "meta", "spacer", "link", "frame", "base", "col"])
QUOTED = frozenset(["script", "textarea"])
KEEPS_SPACE = frozenset(["pre", "textarea"])
INLINE = frozenset(["span", "font", "q", "object", "bdo", "sub", "sup", "center"])
BLOCK = frozenset(["blockquote", "div", "fieldset", "ins", "del"])
#: An element that nests within itself only below one of these.
NESTS_IN = {"ol": (), "ul": (), "li": ("ul", "ol"), "dl": (), "dd": ("dl",), "dt": ("dl",), "table": (), "tr": ("table", "tbody", "tfoot", "thead"), "td": ("tr",), "th": ("tr",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
RESETS = BLOCK | frozenset(NESTS_IN) | frozenset(["address", "form", "p", "pre", "noscript"])
#: By start tag: the open elements that stay and below which all others end. A tag that nests freely has none.
STAYS = {n: RESETS - {n} for n in RESETS} | {n: frozenset(homes) for n, homes in NESTS_IN.items()} | dict.fromkeys(INLINE | BLOCK, frozenset())
#: Start tags that do not end an open element of their own name.
NESTS = INLINE | BLOCK | frozenset(NESTS_IN)
NODE = "ord int, parent int, last int, depth int, kind string, name string, path string, attrs map<string,string>, text string, string string, begin int, end int, said_from int, said_to int, said string"
#: Node rows, and characters of markup, after which a task passes on what it has.
MOST_ROWS, MOST_MARKUP = 8192, 1 << 18
_TYPES = {"int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string()), "binary": pa.binary()}


class _Builder(HTMLParser):
    def __init__(self, xml: bool, markup: str):
        super().__init__(convert_charrefs=False)
        self.xml, self.markup, self.rows, self.open, self.counts, self.buffer, self.text_at = xml, markup, [], [], [{}], [], 0
        self.lines = [0, *(m.end() for m in re.finditer("\n", markup))]
        if xml:
            self.CDATA_CONTENT_ELEMENTS = ()

    def at(self) -> int:
        """The place in the markup where the current event begins."""
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _add(self, kind, name, text, begin, attrs=None):
        parent = self.open[-1] if self.open else None
        path = parent["path"] if parent else ""
        if kind == "tag":
            n = self.counts[-1][name] = self.counts[-1].get(name, 0) + 1
            path += f"/{name}" + (f"[{n}]" if n > 1 else "")
        row = {"ord": len(self.rows), "parent": parent["ord"] if parent else -1, "depth": len(self.open), "kind": kind, "name": name, "path": path, "attrs": attrs or {}, "text": text, "begin": begin, "end": len(self.markup)}
        self.rows.append(row)
        return row

    def _flush(self, end):
        text, self.buffer = "".join(self.buffer), []
        if text and not text.strip() and not any(t["name"] in KEEPS_SPACE for t in self.open):
            text = "\n" if "\n" in text else " "
        if text:
            self._add("text", None, text, self.text_at)["end"] = end

    def _end(self, depth, place):
        """End the open elements from this depth on, at a place in the markup."""
        for row in self.open[depth:]:
            row["end"] = place
        del self.open[depth:], self.counts[depth + 1 :]

    def _end_named(self, name, outer, inner):
        """End the innermost element of that name, and before it what is open within."""
        places = [k for k, row in enumerate(self.open) if row["name"] == name]
        if places:
            self._end(places[-1] + 1, inner)
            self._end(places[-1], outer)

    def _make_room(self, name, place):
        """End what the start of ``name`` ends, by the table of what stays open above it."""
        innermost = {row["name"]: k for k, row in enumerate(self.open)}
        stays = max((innermost.get(n, -1) for n in STAYS.get(name, ())), default=-1)
        own = -1 if name in NESTS else innermost.get(name, -1)
        if max(stays, own) >= 0:
            self._end(own if own > stays else stays + 1, place)

    def _start(self, tag, attrs):
        begin = self.at()
        self._flush(begin)
        if not self.xml:
            self._make_room(tag, begin)
        row = self._add("tag", tag, None, begin, {k: v or "" for k, v in attrs})
        row["end"] = begin + len(self.get_starttag_text())
        return row

    def _quoted(self):
        """Within a script or the like a tag is text."""
        if self.xml or not self.open or self.open[-1]["name"] not in QUOTED:
            return False
        self.handle_data(self.get_starttag_text())
        return True

    def handle_starttag(self, tag, attrs):
        if attrs and self.get_starttag_text().endswith("/>"):  # the slash after a value without quotation marks ends the tag
            name, value = attrs[-1]
            return self.handle_startendtag(tag, [*attrs[:-1], (name, value and value.removesuffix("/"))])
        if self._quoted():
            return
        row = self._start(tag, attrs)
        if self.xml or tag not in VOID:
            row["end"] = len(self.markup)
            self.open.append(row)
            self.counts.append({})

    def handle_startendtag(self, tag, attrs):
        if not self._quoted():
            self._start(tag, attrs)

    def handle_endtag(self, tag):
        begin = self.at()
        self._flush(begin)
        self._end_named(tag, self.markup.find(">", begin) + 1 or len(self.markup), begin)

    def handle_data(self, data):
        if not self.buffer:
            self.text_at = self.at()
        self.buffer.append(data)

    def handle_entityref(self, name):
        self._as_written(f"&{name}")

    def handle_charref(self, name):
        self._as_written(f"&#{name}")

    def _as_written(self, said):
        """An entity stays as the page has it, with its semicolon or without."""
        self.handle_data(said + ";" * self.markup.startswith(";", self.at() + len(said)))

    def _other(self, kind, data):
        begin = self.at()
        self._flush(begin)
        self._add(kind, None, data, begin)["end"] = self.markup.find(">", begin + len(data)) + 1 or len(self.markup)

    def handle_comment(self, data):
        """A comment; or a declaration or comment that has blanks after its first two characters, as what it is without them."""
        said = data.lstrip() if self.markup.startswith("<!", self.at()) and not self.markup.startswith("<!--", self.at()) else ""
        if said in (data, ""):
            self._other("comment", data)
        elif said.startswith("--") and said.endswith("--") and len(said) > 3:
            self._other("comment", said[2:-2])
        else:
            self._other("decl", said)

    def handle_decl(self, data):
        self._other("decl", data)

    def handle_pi(self, data):
        self._other("pi", data)

    def unknown_decl(self, data):
        self._other("cdata" if data.startswith("CDATA[") else "decl", data.removeprefix("CDATA["))


def parse(markup: str, xml: bool = False, texts: bool = True) -> list[dict]:
    """The node rows of a text in document order; tags get the joined and stripped text below them, and their only text.

    Without ``texts`` they get neither: the first row has all that the page says (``said``), of which a tag's text is the part from
    ``said_from`` to ``said_to``.
    """
    builder = _Builder(xml, markup)
    builder.feed(markup)
    builder.close()
    builder._flush(len(markup))
    rows, pieces, size = builder.rows, [], 0
    for row in rows:
        row["said_from"], row["last"], row["said"] = size, row["ord"], None
        if row["kind"] != "tag":
            pieces.append(row["text"].strip())
            size += len(pieces[-1])
        row["said_to"] = size
    for row in reversed(rows):
        if row["parent"] >= 0:
            above = rows[row["parent"]]
            above["last"] = max(above["last"], row["last"])
    whole = "".join(pieces)
    for row in rows:
        row["string"] = row["text"]
        if row["kind"] == "tag":
            row["said_to"] = rows[row["last"]]["said_to"]
            if texts:
                row["text"] = whole[row["said_from"] : row["said_to"]]
                only = rows[row["last"]]  # a tag's only node is the one after it
                row["string"] = only["text"] if row["last"] == row["ord"] + 1 and only["kind"] != "tag" else None
    if rows and not texts:
        rows[0]["said"] = whole
    return rows


def add_digests(rows: list[dict]) -> None:
    """Give each row the digest of its subtree: of its kind, name, attributes in order, text, and its children's digests in order."""
    below: list[list] = [[] for _ in rows]
    for row in reversed(rows):
        own = [row["kind"], row["name"] or "", *(x for pair in row["attrs"].items() for x in pair)] if row["kind"] == "tag" else [row["kind"], row["text"]]
        hashed = hashlib.blake2b(digest_size=16)
        for part in own:
            data = part.encode("utf-8", "surrogatepass")
            hashed.update(b"%d:" % len(data) + data)
        for digest in reversed(below[row["ord"]]):
            hashed.update(digest)
        row["digest"] = hashed.digest()
        if row["parent"] >= 0:
            below[row["parent"]].append(row["digest"])


@dataclass(frozen=True)
class Wanted:
    """Which nodes leave the parse: tags by name, attributes and path, as ``find_all`` takes them, or with ``text`` the texts in which that pattern is found.

    With ``below`` all nodes below them leave it too.
    """

    name: object = None
    attrs: object = None
    path: object = None
    text: str | None = None
    below: bool = False

    def rows(self, rows: list[dict]) -> list[dict]:
        kept, until = [], -1
        for row in rows:
            if row["ord"] <= until:
                kept.append(row)
            elif self._fits(row):
                kept.append(row)
                until = row["last"] if self.below else until
        return kept

    def _fits(self, row: dict) -> bool:
        if self.text is not None:
            return row["kind"] != "tag" and re.search(self.text, row["text"]) is not None
        if row["kind"] != "tag" or self.name is not None and not _is(row["name"], self.name) or self.path is not None and not _is(row["path"], self.path):
            return False
        if isinstance(self.attrs, str):
            return self.attrs in re.split(r"\s+", row["attrs"].get("class", ""))
        return all(_is(row["attrs"].get(k), want) for k, want in (self.attrs or {}).items())


def _is(value: str | None, want) -> bool:
    if want is True or want is None:
        return (value is not None) is bool(want)
    if isinstance(want, (list, tuple, set, frozenset)):
        return value in want
    return value is not None and want.search(value) is not None if isinstance(want, re.Pattern) else value == want


def html_nodes(pages: DataFrame, key: str = "page_id", column: str = "html", xml: bool = False, wanted: Wanted | None = None, texts: bool = True, digests: bool = False) -> DataFrame:
    """Node rows of every page; null is a page without nodes. ``wanted`` limits which rows leave the parse, and ``digests`` adds a ``digest`` of each node's subtree."""
    fields = [x.split() for x in (NODE + ", digest binary" * digests).split(", ")]
    key_type = dict(pages.dtypes)[key]

    def run(batches):
        for batch in batches:
            found, places, size = [], [], 0
            for k in range(batch.num_rows):
                markup = batch.column(1)[k].as_py() or ""
                rows = parse(markup, xml, texts)
                if digests:
                    add_digests(rows)
                if wanted is not None:
                    rows = wanted.rows(rows)
                found += rows
                places += [k] * len(rows)
                size += len(markup)
                # Small pages leave together, large ones as they come.
                if found and (len(found) >= MOST_ROWS or size >= MOST_MARKUP or k == batch.num_rows - 1):
                    columns = [pa.array([list(r[n].items()) if n == "attrs" else r[n] for r in found], _TYPES[t]) for n, t in fields]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), *columns], [key, *(n for n, _ in fields)])
                    found, places, size = [], [], 0

    return dealt(pages.select(key, column)).mapInArrow(run, f"{key} {key_type}, {', '.join(map(' '.join, fields))}")


def find_all(nodes: DataFrame, name: str | list[str] | None = None, attrs: dict | str | None = None, limit: int = 0, below: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """Tags of a page by name and attributes, in document order.

    A name may be several. An attribute's value is matched whole; as a list, any of it; as a pattern (``re``), where
    it is found; as True, if there is any, and as None, if there is none. ``attrs`` as a text is a token of ``class``. Of each page the
    first ``limit`` are taken (0: all), and only descendants of the tags ``below``, if given.
    """
    def fits(column, want):
        if want is True or want is None:
            return column.isNotNull() if want else column.isNull()
        if isinstance(want, (list, tuple, set, frozenset)):
            return column.isin(*want)
        return column.rlike(want.pattern) if isinstance(want, re.Pattern) else column == want

    found = nodes.filter("kind = 'tag'")
    if name is not None:
        found = found.filter(fits(F.col("name"), name))
    if isinstance(attrs, str):
        found = found.filter(F.array_contains(F.split(F.col("attrs")["class"], r"\s+"), attrs))
    else:
        for k, v in (attrs or {}).items():
            found = found.filter(fits(F.col("attrs")[k], v))
    if below is not None:
        from ..operators.structure import inside_any

        found = inside_any(found, below, key)
    if limit:
        from pyspark.sql import Window

        found = found.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).filter(F.col("_place") <= limit).drop("_place")
    return found


def in_order(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """The node before and after each node in document order, of any depth."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("ord")
    return nodes.withColumns({"before": F.lag("ord").over(w), "after": F.lead("ord").over(w)})


def find_text(nodes: DataFrame, pattern: str) -> DataFrame:
    """Texts in which the pattern is found, in comments and scripts too."""
    return nodes.filter((F.col("kind") != "tag") & F.col("text").rlike(pattern))


def ancestors(nodes: DataFrame, of: DataFrame, key: str = "page_id", name: str | list[str] | None = None) -> DataFrame:
    """``key, ord, ancestor, name, depth`` for the nodes ``of``: the tags around each, or those of a name; the nearest is the deepest."""
    from ..operators.structure import contained

    tags = find_all(nodes, name)
    met = contained(of, tags, key).withColumnRenamed("top", "ancestor")
    return met.join(large(tags.select(key, F.col("ord").alias("ancestor"), "name", "depth")), [key, "ancestor"]).select(key, "ord", "ancestor", "name", "depth")


def descendants(nodes: DataFrame, of: DataFrame, key: str = "page_id", name: str | list[str] | None = None) -> DataFrame:
    """``key, ord, descendant`` for the nodes ``of``: the tags below each, or those of a name."""
    from ..operators.structure import contained

    return contained(find_all(nodes, name), of, key).select(key, F.col("top").alias("ord"), F.col("ord").alias("descendant"))


def quota_cells(nodes: DataFrame, labels: dict[str, str], key: str = "page_id") -> DataFrame:
    """``label, value`` of a dashboard's cells such as ``12%``: a number less its last character, named by the text before it."""
    from pyspark.sql import Window

    from ..functions.text import is_blank, matching_label

    texts = nodes.filter((F.col("kind") == "text") & ~is_blank(F.col("text"))).select(key, "ord", F.trim("text").alias("text"))
    named = texts.withColumn("before", F.lag("text").over(Window.partitionBy(key).orderBy("ord")))
    value = F.substring(F.col("text"), F.lit(1), F.char_length("text") - 1).try_cast("double")
    return named.select(key, "ord", matching_label(F.col("before"), labels).alias("label"), value.alias("value")).filter("label is not null and value is not null")


def city_list(nodes: DataFrame, anchor: str, samples: list[str], least: int = 3, key: str = "page_id") -> DataFrame:
    """``key, pos, token``: the words of the first text that holds the anchor and enough of the sample cities."""
    hits = sum((F.col("text").contains(w).cast("int") for w in samples), F.lit(0))
    texts = nodes.filter((F.col("kind") != "tag") & F.col("text").contains(anchor) & (hits >= least))
    first = texts.groupBy(key).agg(F.min_by("text", "ord").alias("text"))
    return first.select(key, F.posexplode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("pos", "token"))


def get_node(nodes: DataFrame, path: str) -> DataFrame:
    """Tags at ``/a/b[2]/…``; a place of 1 may be written or left out."""
    return nodes.filter((F.col("kind") == "tag") & (F.col("path") == path.replace("[1]", "")))


def links(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """``href, text`` of each link that leads somewhere."""
    return find_all(nodes, "a").filter(F.col("attrs")["href"] != "").select(key, "ord", F.col("attrs")["href"].alias("href"), "text")


def titles(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    return find_all(nodes, "title").groupBy(key).agg(F.min_by("text", "ord").alias("title"))


def children_count(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    return nodes.groupBy(key, "parent").agg(F.count("*").alias("n"))


def siblings(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Previous and next sibling of each node."""
    from pyspark.sql import Window

    w = Window.partitionBy(key, "parent").orderBy("ord")
    return nodes.withColumn("previous", F.lag("ord").over(w)).withColumn("next", F.lead("ord").over(w))


def extract_fields(pages: DataFrame, specs: dict[str, str], key: str = "page_id", column: str = "html") -> DataFrame:
    """``key`` and a column for each field: the markup of the first node at ``path:/a/b`` or with ``attr:value``; null where there is none.

    Fields are cut out where a page is parsed, so that no page travels. Pages without tags are left out. Of pages that repeat a key any one is read.
    """
    def matches(spec):
        kind, _, value = spec.partition(":")
        return Wanted(path=value.replace("[1]", "")) if kind == "path" else Wanted(attrs={kind: value})

    wanted = {n: matches(s) for n, s in specs.items()}
    key_type = dict(pages.dtypes)[key]

    def run(batches):
        for batch in batches:
            keys, fields = [], []
            for k, html in enumerate(batch.column(1)):
                said = html.as_py() or ""
                rows = parse(said, texts=False)
                if any(r["kind"] == "tag" for r in rows):
                    keys.append(k)
                    first = (next(iter(w.rows(rows)), None) for w in wanted.values())
                    fields.append([r and said[r["begin"] : r["end"]] for r in first])
            if keys:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), *(pa.array(c, pa.string()) for c in zip(*fields))], [key, *wanted])

    found = dealt(pages.select(key, column)).mapInArrow(run, ", ".join([f"{key} {key_type}", *(f"`{n}` string" for n in wanted)]))
    return found.dropDuplicates([key])


def find_address(nodes: DataFrame, words: list[str], least: int = 3, key: str = "page_id") -> DataFrame:
    """The first text node of five characters at least that has enough address words after its first full-width colon: what follows that; a text without one is taken whole."""
    from ..functions.text import after_colon

    texts = nodes.filter((F.col("kind") == "text") & (F.char_length("text") >= 5)).withColumn("_said", after_colon(F.col("text")))
    hits = sum((F.col("_said").contains(w).cast("int") for w in words), F.lit(0))
    return texts.filter(hits >= least).groupBy(key).agg(F.min_by("_said", "ord").alias("address"))


def map_markers(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Coordinates in the first picture of a map service."""
    from ..functions.text import coordinate_pairs, query_part, url_host

    source = F.coalesce(F.col("attrs")["src"], F.col("attrs")["lazysrc"])
    images = find_all(nodes, "img").select(key, "ord", source.alias("src")).filter(url_host(F.col("src")).contains("google"))
    pairs = images.withColumn("geoinfo", coordinate_pairs(query_part(F.col("src"), "markers="))).filter("geoinfo <> ''")
    return pairs.groupBy(key).agg(F.min_by("geoinfo", "ord").alias("geoinfo"))
