"""Structural joins: which node rows lie in, before and after which, by their places in the document.

A node row has its place ``ord`` in document order and the place ``last`` of the last node below it, so that what
lies below it are the places from ``ord + 1`` to ``last``. Intervals of one page are nested or apart.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import large


def contained(nodes: DataFrame, tops: DataFrame, key: str = "page_id", nearest: bool = False) -> DataFrame:
    """``key, top, ord``: each node with every one of the tops around it, or only the innermost. A node is not around itself.

    Both are merged in document order once; a task holds the tops that are open, no more than the document is deep.
    """
    sides = [df.select(key, "ord", "last", F.lit(top).alias("top")) for df, top in ((nodes, False), (tops, True))]
    merged = sides[0].unionByName(sides[1]).repartition(key).sortWithinPartitions(key, "ord", "top")
    key_type = dict(nodes.dtypes)[key]

    def run(batches):
        page, open_tops = object(), []
        for batch in batches:
            found = []
            for at, (k, ord_, last, top) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if k != page:
                    page, open_tops = k, []
                while open_tops and open_tops[-1][1] < ord_:
                    open_tops.pop()
                if not top:
                    found += [(at, t, ord_) for t, _ in (open_tops[-1:] if nearest else open_tops) if t < ord_]
                elif not open_tops or open_tops[-1][0] != ord_:
                    open_tops.append((ord_, last))
            if found:
                rows, around, inside = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(around, pa.int32()), pa.array(inside, pa.int32())], [key, "top", "ord"])

    return merged.mapInArrow(run, f"{key} {key_type}, top int, ord int")


def inside_any(nodes: DataFrame, tops: DataFrame, key: str = "page_id") -> DataFrame:
    """The nodes that lie in one of the tops at least: the farthest end of those begun before reaches them."""
    marked = nodes.withColumn("_ends", F.lit(None).cast("int")).unionByName(tops.select(key, "ord", F.col("last").alias("_ends")), allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy("ord").rangeBetween(Window.unboundedPreceding, -1)
    reached = marked.withColumn("_reach", F.max("_ends").over(before))
    return reached.filter(F.col("_ends").isNull() & (F.col("_reach") >= F.col("ord"))).drop("_ends", "_reach")


def _numbered(of: DataFrame, wanted: DataFrame, keys: list[str], limit: int, after: bool, carry: tuple[str, ...]) -> DataFrame:
    carried = [F.col(c).alias(f"_carried_{c}") for c in carry]
    nothing = [F.lit(None).cast(wanted.schema[c].dataType).alias(f"_carried_{c}") for c in carry]
    sides = [df.select(*keys, "ord", F.lit(hit).alias("_hit"), *more) for df, hit, more in ((of, 0, nothing), (wanted, 1, carried))]
    # Hits up to a node, itself among them, or only those before it.
    count = F.sum("_hit").over(Window.partitionBy(*keys).orderBy("ord").rangeBetween(Window.unboundedPreceding, 0 if after else -1))
    marked = sides[0].unionByName(sides[1]).withColumn("_count", F.coalesce(count, F.lit(0)))
    first, step = (F.col("_count") + 1, 1) if after else (F.col("_count"), -1)
    asked = marked.filter("_hit = 0").select(*keys, "ord", F.posexplode(F.sequence(first, first + step * (limit - 1), F.lit(step).cast("long"))).alias("place", "_number"))
    hits = marked.filter("_hit = 1").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("ord").alias("found"), (F.col("_count") + (0 if after else 1)).alias("_of"), *[f"_carried_{c}" for c in carry])
    same = F.col("_number") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return asked.join(large(hits), same).select(*keys, "ord", (F.col("place") + 1).alias("place"), "found", *[F.col(f"_carried_{c}").alias(c) for c in carry])


def following(of: DataFrame, wanted: DataFrame, limit: int = 1, key: str = "page_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, ord, place, found``: for each node the first ``limit`` of the wanted nodes that begin after it in document order, those below it too.

    Nodes and hits meet by the number of hits so far, so that a node meets the hits it gets and no others. ``carry`` names columns of the wanted nodes that come with them.
    """
    return _numbered(of, wanted, [key], limit, True, carry)


def preceding(of: DataFrame, wanted: DataFrame, limit: int = 1, key: str = "page_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, ord, place, found``: the nearest ``limit`` of the wanted nodes that begin before it, those around it too, the nearest first."""
    return _numbered(of, wanted, [key], limit, False, carry)


def next_siblings(of: DataFrame, wanted: DataFrame, limit: int = 1, key: str = "page_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, parent, ord, place, found``: the same among the children of one parent."""
    return _numbered(of, wanted, [key, "parent"], limit, True, carry)


def previous_siblings(of: DataFrame, wanted: DataFrame, limit: int = 1, key: str = "page_id", carry: tuple[str, ...] = ()) -> DataFrame:
    return _numbered(of, wanted, [key, "parent"], limit, False, carry)


def repeated(nodes: DataFrame, key: str = "page_id", least: int = 2) -> DataFrame:
    """``digest, name, text, n, pages``: equal subtrees that occur ``least`` times, by the digests of their nodes (``html_nodes(digests=True)``)."""
    counted = nodes.groupBy("digest").agg(F.min("name").alias("name"), F.min("text").alias("text"), F.count("*").alias("n"), F.countDistinct(key).alias("pages"))
    return counted.filter(F.col("n") >= least)


def common_path(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, path``: what the paths of a group begin with alike, without its last step, so that it is a tag around all of them.

    The least and the greatest path of a group begin alike as far as all do.
    """
    ends = nodes.groupBy(*keys).agg(F.min("path").alias("_low"), F.max("path").alias("_high"))
    n = F.least(F.char_length("_low"), F.char_length("_high"))
    alike = F.filter(F.sequence(F.lit(0), n), lambda k: F.left(F.col("_low"), k) == F.left(F.col("_high"), k))
    prefix = F.left(F.col("_low"), F.array_max(alike))
    return ends.select(*keys, F.regexp_replace(prefix, "/[^/]*$", "").alias("path"))
