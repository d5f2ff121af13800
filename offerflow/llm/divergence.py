"""Source divergence audit: wide term vectors.

Within a language, each kept term is one row with an array of its counts, which lie
there by the number of their source. Higher-order functions turn a row into the
contributions of the source pairs that both hold the term; they are summed where
they arise, so that a task sends one row for each pair. What a term adds to a pair
that holds it on one side, or on none, depends on one count alone: a histogram of
counts for each source gives those parts in closed form, so that zeros need no rows.
All of it is integer arithmetic.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, utf8

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
MOST_RANKS = 200
#: Terms that a task gathers before it passes their counts on.
HELD_TERMS = 300_000
#: Bytes of a text that are taken apart at a time.
PIECE = 4 << 20

#: ASCII letters in lower case and whatever is not ASCII; the rest separates terms.
_LETTERS = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def term_pieces(data: bytes, piece: int = PIECE):
    """The terms of a text, list by list."""
    start = 0
    while start < len(data):
        end = min(len(data), start + piece)
        while end < len(data) and _LETTERS[data[end]] != 32:
            end += 1
        yield data[start:end].translate(_LETTERS).split()
        start = end


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that hold the term, gathered within tasks."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        counts, texts = defaultdict(Counter), defaultdict(Counter)

        def gathered():
            for (lang, source), found in counts.items():
                terms = list(found)
                for a in range(0, len(terms), 1 << 16):
                    some = terms[a : a + (1 << 16)]
                    held = texts[lang, source]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()),
                        pa.array([found[t] for t in some], pa.int64()), pa.array([held[t] for t in some], pa.int64()),
                    ], names)
            counts.clear()
            texts.clear()

        for batch in slices(batches):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                group, distinct = counts[lang, source], set()
                for terms in term_pieces(text):
                    group.update(terms)
                    distinct.update(terms)
                texts[lang, source].update(distinct)
            if sum(map(len, counts.values())) > HELD_TERMS:
                yield from gathered()
        yield from gathered()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def wide_terms(counted: DataFrame, groups: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, counts`` of each kept term: structs of a source's number and the count there, by number.

    One exchange by language and term serves both sums.
    """
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    numbered = by_source.join(groups, ["lang", "source"])
    wide = numbered.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("i", "n"))).alias("counts"))
    return wide.filter(F.col("docs") >= least).select("lang", "term", "counts")


def share(n: Column, total: Column) -> Column:
    """``1 + floor(SCALE * (n + 1) / total)``; decimals carry the product, which counts beyond 9e9 take out of 64 bits."""
    scaled = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", scaled, total.cast("decimal(20,0)"))


def excess(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``, exact as shares are at most ``SCALE + 1``."""
    return F.call_function("div", (p - q) * (p - q), q)


def parameters(wide: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, v, total, totals, zeros``: kept terms, their occurrences in all and by a source's number, and the share of an absent term there."""
    by_source = wide.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.i").alias("i")).agg(F.sum("c.n").alias("n"))
    sizes = wide.groupBy("lang").agg(F.count("*").alias("v"))
    rows = groups.join(by_source, ["lang", "i"], "left").join(sizes, "lang", "left").select("lang", "i", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    rows = rows.withColumn("total", F.greatest(F.col("n") + F.col("v"), F.lit(1)))
    each = F.sort_array(F.collect_list(F.struct("i", "total", share(F.lit(0).cast("long"), F.col("total")).alias("zero"))))
    found = rows.groupBy("lang").agg(F.max("v").alias("v"), F.sum("n").alias("n"), each.alias("each"))
    return found.select("lang", "v", (F.col("n") + F.col("v")).alias("total"), F.col("each.total").alias("totals"), F.col("each.zero").alias("zeros"))


def pair_sums(wide: DataFrame, known: DataFrame) -> DataFrame:
    """``lang, a, b, value``: for each two sources of a language, by number, the sum over all kept terms."""
    f = excess
    # Terms that both sources hold: what they add beyond the parts that follow from one side.
    entry = lambda c: F.struct(c["i"].alias("i"), share(c["n"], F.col("totals")[c["i"]]).alias("p"), F.col("zeros")[c["i"]].alias("z"))
    later = lambda at: F.slice(F.col("v"), at + 2, F.size("v"))
    pairs = F.flatten(F.transform("v", lambda x, at: F.transform(later(at), lambda y: F.struct(x["i"].alias("a"), y["i"].alias("b"), x["p"].alias("p"), y["p"].alias("q"), x["z"].alias("y"), y["z"].alias("z")))))
    both = wide.join(known.select("lang", "totals", "zeros"), "lang").select("lang", F.transform("counts", entry).alias("v")).select("lang", F.explode(pairs).alias("t")).select("lang", "t.*")
    p, q, y, z = (F.col(c) for c in "pqyz")
    there = both.groupBy("lang", "a", "b").agg(
        F.sum(f(p, q) - f(p, z) - f(y, q) + f(y, z)).alias("ab"),
        F.sum(f(q, p) - f(q, y) - f(z, p) + f(z, y)).alias("ba"),
    )
    there = there.select("lang", F.explode(F.array(F.struct("a", "b", F.col("ab").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ba").alias("value")))).alias("t")).select("lang", "t.*")

    # Terms that one source holds, by their count there, against the absent ones of each other source.
    histogram = wide.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.i").alias("a"), F.col("c.n").alias("n")).agg(F.count("*").alias("terms"))
    others = known.select("lang", "totals", F.col("zeros"))
    met = histogram.join(others, "lang").select("lang", "a", "terms", F.posexplode("zeros").alias("b", "z"), share(F.col("n"), F.col("totals")[F.col("a")]).alias("p"), F.col("zeros")[F.col("a")].alias("y")).filter("a <> b")
    one = met.groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * (f(p, z) - f(y, z))).alias("ab"), F.sum(F.col("terms") * (f(z, p) - f(z, y))).alias("ba"))
    one = one.select("lang", F.explode(F.array(F.struct("a", "b", F.col("ab").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ba").alias("value")))).alias("t")).select("lang", "t.*")

    # All terms, as if absent on both sides.
    left = known.select("lang", "v", "zeros", F.posexplode("zeros").alias("a", "y"))
    none = left.select("lang", "v", "a", "y", F.posexplode("zeros").alias("b", "z")).filter("a <> b").select("lang", "a", "b", (F.col("v") * f(y, z)).alias("value"))
    columns = ["lang", "a", "b", "value"]
    return there.select(columns).unionByName(one.select(columns)).unionByName(none).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def leading_terms(wide: DataFrame, known: DataFrame, ranks: int = MOST_RANKS) -> DataFrame:
    """``lang, a, item, value, rank``: of each source's own terms those whose share exceeds the language's most."""
    all_of = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    rows = wide.join(known.select("lang", "totals", "total"), "lang").select("lang", "term", "totals", share(all_of, F.col("total")).alias("q"), F.explode("counts").alias("c"))
    rows = rows.select("lang", F.col("c.i").alias("a"), F.col("term").alias("item"), share(F.col("c.n"), F.col("totals")[F.col("c.i")]).alias("p"), "q").filter("p > q")
    valued = rows.select("lang", "a", "item", excess(F.col("p"), F.col("q")).alias("value"))
    # Each task keeps its own first ranks before rows meet.
    return valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= ranks)


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = MOST_RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source's use of terms lies from the other sources of its language.

    Null text, lang and source are ''. Part ``pair`` has each other source of the
    language with the chi-square-like sum over all kept terms, part ``term`` the
    source's own terms that stand out most from the language. Terms in fewer than
    ``least`` documents of the language are not kept; a repeated row is a document
    of its own. A group without terms is compared as one of zero counts; without kept
    terms all values are 0. Ties are ranked by the item's bytes. A language of one
    source has no pairs. Texts are read whole; other columns are not looked at. No documents: no rows.
    """
    plain = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = cut(plain.select("lang", "source").distinct().withColumn("i", place))
    wide = cut(wide_terms(count_terms(plain), groups, least))
    known = cut(parameters(wide, groups))
    name = groups.select("lang", F.col("i").alias("b"), F.col("source").alias("item"))
    pairs = pair_sums(wide, known).join(name, ["lang", "b"]).select("lang", "a", "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("value"), "item")))
    found = pairs.withColumn("part", F.lit("pair")).unionByName(leading_terms(wide, known, ranks).withColumn("part", F.lit("term")))
    return found.join(groups.select("lang", F.col("i").alias("a"), "source"), ["lang", "a"]).select("lang", "source", "part", "item", "value", "rank")


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST_DOCUMENTS}
), g AS (SELECT DISTINCT lang, source FROM d
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), n AS (
  SELECT g.lang, g.source, v.v, coalesce(sum(c.n), 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), p AS (
  SELECT n.lang, n.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (n.n + n.v)::HUGEINT AS p
  FROM n JOIN kept ON kept.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c.n)::HUGEINT + 1)) // (any_value(m.n)::HUGEINT + any_value(m.v)) AS q
  FROM c JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM n GROUP BY lang) m USING (lang) GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), term AS (
  SELECT p.lang, p.source, p.term AS item, ((p.p - q) * (p.p - q)) // q AS value FROM p JOIN whole USING (lang, term) WHERE p.n > 0 AND p.p > q
), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {MOST_RANKS}
"""
