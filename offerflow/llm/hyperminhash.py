"""Near-duplicates: HyperMinHash.

A document's distinct 5-word shingles are hashed into 256 buckets; a register
keeps, of a bucket's smallest hash, the count of leading zeros (6 bits) and the
10 bits of mantissa after them. Empty buckets borrow from a filled one that a
fixed probe order names (optimal densification), so that short texts match as
long ones do. Registers are banded 32 times 8 for a threshold of 85 of 100 and
42 times 6 below it: sets just at 0.85 share no band with probability 4e-5, at
0.9 2e-8, and with the second shape at 0.8 3e-6.

Documents with equal sets are one class from the start. Sharing a band ties
classes into clusters. A cluster that is more than a block is split again by full sets:
two that are as similar as asked share one of their rarest shingles, so that a passage
in common ties nothing. Each cluster is then resolved exactly. Its classes lie in
blocks of bounded size, ordered by set size, and a task takes two blocks: the
registers give a Jaccard estimate, corrected for accidental collisions, and what
it does not rule out, and no found link joins yet, is verified on full sets.
Tasks return spanning links, never pairs, and components are those of the links.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_and_text, mix, shingles, slices, utf8
from .components import connected_components

PERCENT = 85
WIDTH = 5
BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
#: Deviations by which an estimate may fall short before a pair is ruled out.
MARGIN = 5.0
#: Counters of how many texts hold a shingle, 8 bytes each, in which shingles of one hash prefix share one.
COUNT_BITS = 20
#: Of shingles, with ``BLOCK_EXTRA`` more for each class, in a block.
BLOCK_WEIGHT, BLOCK_EXTRA = 1 << 19, 2048

_EDGES = np.arange(1, BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
_PROBES = (mix(np.arange(1024 * BUCKETS, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64).reshape(1024, BUCKETS)
_BAND_MULTIPLIERS = mix(np.arange(1, BUCKETS + 1, dtype=np.uint64)) | np.uint64(1)


def registers(sorted_hashes: np.ndarray) -> np.ndarray:
    """The 256 registers of a non-empty set of 64-bit hashes."""
    at = np.concatenate([[0], np.searchsorted(sorted_hashes, _EDGES), [len(sorted_hashes)]])
    filled = at[1:] > at[:-1]
    least = sorted_hashes[np.minimum(at[:-1], len(sorted_hashes) - 1)] << np.uint64(BUCKET_BITS)
    mantissa, exponent = np.frexp(least.astype(np.float64))
    zeros = np.where(least == 0, 63, 64 - exponent)
    value = ((zeros << MANTISSA_BITS) | np.minimum(((mantissa - 0.5) * (2 << MANTISSA_BITS)).astype(np.int64), (1 << MANTISSA_BITS) - 1).clip(0)).astype(np.uint16)
    empty = np.flatnonzero(~filled)
    for tries in (slice(0, 64), slice(64, 1024)):
        if len(empty) == 0:
            return value
        probes = _PROBES[tries][:, empty]
        hit = filled[probes]
        first = hit.argmax(axis=0)
        found = hit.any(axis=0)
        value[empty[found]] = value[probes[first[found], np.flatnonzero(found)]]
        empty = empty[~found]
    if len(empty):
        value[empty] = value[np.flatnonzero(filled)[0]]
    return value


def band_rows(percent: int) -> int:
    """Registers in a band for a threshold."""
    return 8 if percent >= 85 else 6 if percent >= 75 else 4


def band_keys(value: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` registers."""
    bands = BUCKETS // rows
    product = value.astype(np.uint64) * _BAND_MULTIPLIERS
    return mix(product[: bands * rows].reshape(bands, rows).sum(axis=1) + np.arange(bands, dtype=np.uint64)).view(np.int64)


@lru_cache(maxsize=4096)
def accidental(quarters: int) -> float:
    """The chance that registers of two disjoint sets of ``2**(quarters/4)`` hashes agree."""
    load = 2.0 ** (quarters / 4) / BUCKETS
    j = np.arange(1 << MANTISSA_BITS)
    total = 0.0
    for zeros in range(40):
        low = (1 + j / (1 << MANTISSA_BITS)) * 2.0 ** -(zeros + 1)
        high = (1 + (j + 1) / (1 << MANTISSA_BITS)) * 2.0 ** -(zeros + 1)
        total += float(((np.exp(-load * low) - np.exp(-load * high)) ** 2).sum())
    return total / max(1e-300, (1 - np.exp(-load)) ** 2)


def estimate(agreeing, size: int):
    """Jaccard similarity from the share of agreeing registers, without accidental collisions."""
    chance = accidental(round(4 * np.log2(max(1, size))))
    return (agreeing - chance) / (1 - chance)


def local_links(nodes: list, sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple]:
    """Spanning links ``(u, v)`` among the classes of two blocks (``side`` 0 and 1), or of one (all 0)."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(s) for s in sets])[order]
    value = np.stack([registers(sets[k]) for k in order])
    crossing, side = bool(side.any()), side[order]
    parent = np.arange(len(order))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    candidates = []
    for i in range(len(order) - 1):
        last = np.searchsorted(sizes, sizes[i] * 100 // percent, side="right")  # |A| / |B| bounds the similarity
        if last <= i + 1:
            continue
        others = np.arange(i + 1, last)
        if crossing:
            others = others[side[i + 1 : last] != side[i]]
        agreeing = (value[others] == value[i]).mean(axis=1)
        j = percent / 100
        least = j - MARGIN * np.sqrt(j * (1 - j) * (1 / BUCKETS + 1 / sizes[i]))
        guess = estimate(agreeing, int(sizes[i]))
        keep = guess >= least
        candidates += [(-g, i, k) for g, k in zip(guess[keep].tolist(), others[keep].tolist())]
    for _, i, k in sorted(candidates):
        a, b = root(i), root(k)
        if a == b:
            continue
        x, y = sets[order[i]], sets[order[k]]
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        shared = int((y[at] == x).sum())
        if 100 * shared >= percent * (len(x) + len(y) - shared):
            parent[b] = a
            links.append((nodes[order[i]], nodes[order[k]]))
    return links


def sketch(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, digest, bands`` of each row; without words the last two are null."""
    names = ["doc_id", "n_shingles", "digest", "bands"]
    rows = band_rows(percent)

    def run(batches):
        for batch in slices(batches):
            sizes, digests, bands = [], [], []
            for text in utf8(batch.column(1)):
                s = shingles(text, WIDTH)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(registers(s), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """``node, root``: classes tied by bands. Each band ties its classes to the smallest, so that a large one adds a row for each class.

    The shared bands are a table of their own, and always met by a sort and a merge, so that a band with a third of all
    classes can be split there and no size of the input changes the plan.
    """
    return tied(classes.select(F.explode("bands").alias("key"), F.col("digest").alias("node")))


def tied(keys: DataFrame) -> DataFrame:
    """``node, root`` of the nodes that share keys (``key, node``)."""
    least = cut(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").drop("most"))
    return connected_components(keys.join(least.hint("merge"), "key").select(F.col("node").alias("u"), F.col("least").alias("v")), rank=lambda node: node)


def block_members(members: DataFrame) -> DataFrame:
    """Number the blocks of each cluster by set size, without sorting a cluster in one task.

    Sizes are summed first; a class lies at a hashed place among those of its size.
    """
    weight = F.col("n_shingles") + BLOCK_EXTRA
    steps = members.groupBy("root", "n_shingles").agg(F.count("*").alias("n"))
    before = Window.partitionBy("root").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(F.col("root").alias("of"), F.col("n_shingles").alias("of_size"), "n", F.coalesce(F.sum(F.col("n") * weight).over(before), F.lit(0)).alias("below"), F.sum(F.col("n") * weight).over(Window.partitionBy("root")).alias("all"))
    placed = members.join(steps, (F.col("root") == F.col("of")) & (F.col("n_shingles") == F.col("of_size")))
    place = F.col("below") + F.pmod(F.xxhash64("node"), F.col("n")) * weight
    return placed.select("root", "node", "doc_id", "n_shingles", F.floor(place / BLOCK_WEIGHT).alias("block"), F.floor((F.col("all") - 1) / BLOCK_WEIGHT).alias("last_block"))


def prefix_size(n: int, percent: int) -> int:
    """How many of a set's first members, in any order that all sets share, hold one of every set that is as similar as that."""
    return n + 1 - -(-n * percent // 100)


def set_members(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``root, node, shingles``: the full sets of classes, each text read once."""
    texts = id_and_text(docs).withColumnRenamed("doc_id", "of_id").join(members.select("root", "node", "doc_id").hint("merge"), F.col("of_id").eqNullSafe(F.col("doc_id")))

    def run(batches):
        for batch in slices(batches):
            kept, sets = [], []
            for k, (node, text) in enumerate(zip(batch.column(1).to_pylist(), utf8(batch.column(2)))):
                s = shingles(text, WIDTH)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == node:  # else another text with the same id
                    kept.append(k)
                    sets.append(s.tobytes())
            if kept:
                take = pa.array(kept)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(sets, pa.binary())], ["root", "node", "shingles"])

    return texts.select("root", "node", "text").mapInArrow(run, "root binary, node binary, shingles binary")


def split_clusters(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``node, root``: what is left of clusters when only classes stay together that share a shingle of their prefixes.

    Shingles are ordered by how many texts hold them, so that a prefix has a set's rarest: texts that have a passage in common, and
    not much else, share none. How many hold a shingle is counted by a part of its hash, in a table of fixed size; that several count as one
    changes the order, which is the same for all texts, and so loses no link.
    """
    sets = cut(set_members(docs, members))

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - COUNT_BITS), 1)
        held = np.flatnonzero(total)
        for a in range(0, len(held), 1 << 16):
            part = held[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["bucket", "n"])

    counted = sets.select("shingles").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    often = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in counted.toArrow().to_batches():  # no more than the table's size
        often[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                s = np.frombuffer(batch.column(1)[k].as_buffer(), np.uint64)
                order = np.lexsort((s, shared.value[s >> np.uint64(64 - COUNT_BITS)]))
                keys = s[order[: prefix_size(len(s), percent)]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(keys), pa.binary()), pa.array(keys)], ["node", "key"])

    return tied(sets.select("node", "shingles").mapInArrow(prefixes, "node binary, key long"))


def verified_links(docs: DataFrame, blocks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``u, v``: spanning links within clusters, from full sets of their classes' texts."""
    # A block meets only those whose set sizes allow the similarity.
    ranges = blocks.groupBy("root", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    a, b = ranges.alias("a"), ranges.alias("b")
    pairs = a.join(b, (F.col("a.root") == F.col("b.root")) & (F.col("a.block") <= F.col("b.block"))).filter(F.col("b.low") * percent <= F.col("a.high") * 100)
    pairs = pairs.select(F.col("a.root").alias("root"), F.col("a.block").alias("i"), F.col("b.block").alias("j"))
    ends = pairs.select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    # Always by a sort and a merge: which texts are candidates grows with the input.
    candidates = blocks.filter("doc_id is not null or n_shingles > 0").hint("merge")
    texts = id_and_text(docs).withColumnRenamed("doc_id", "of_id").join(candidates, F.col("of_id").eqNullSafe(F.col("doc_id")))
    rows = texts.join(ends, ["root", "block"]).select("root", "i", "j", "block", "node", "text")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def run(batches):
        key, nodes, sets, side = None, [], [], []

        def links():
            return local_links(nodes, sets, np.array(side), percent) if len(nodes) > 1 else []

        out = lambda found: pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["u", "v"])
        for batch in slices(batches):
            found = []
            for root, i, j, block, node, text in zip(*(batch.column(k).to_pylist() for k in range(5)), utf8(batch.column(5))):
                if key != (root, i, j):
                    found += links()
                    key, nodes, sets, side = (root, i, j), [], [], []
                if nodes and nodes[-1] == node:
                    continue  # a repeated row
                s = shingles(text, WIDTH)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == node:  # else another text with the same id
                    nodes.append(node)
                    sets.append(s)
                    side.append(int(block != i))
            if found:
                yield out(found)
        if found := links():
            yield out(found)

    return rows.mapInArrow(run, "u binary, v binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Texts are linked at ``100 * shared >= percent * united`` distinct shingles. Fewer
    than five words are one shingle; null, empty and wordless texts have none
    and are linked with nothing. ``component_id`` is the smallest id reachable;
    rows that repeat an id and its text are one document, all kept or none. A
    null id is passed over by the minimum. No rows: no rows.
    """
    sketched = cut(sketch(docs, percent))
    classes = sketched.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = cut(classes)
    of_node = classes.select(F.col("digest").alias("node"), "doc_id", "n_shingles")
    blocks = cut(block_members(cut(candidate_clusters(classes).join(of_node, "node"))))
    left = split_clusters(docs, blocks.filter("last_block > 0"), percent)
    blocks = cut(blocks.filter("last_block = 0").unionByName(block_members(cut(left.join(of_node, "node")))))
    found = connected_components(verified_links(docs, blocks, percent), rank=lambda node: node)
    named = cut(found.join(classes.select(F.col("digest").alias("node"), "doc_id"), "node").select("node", "root", "doc_id"))
    smallest = cut(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    linked = named.join(smallest, "root").select(F.col("node").alias("digest"), "component_id")
    of_class = cut(classes.select("digest", "doc_id").join(linked, "digest", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id")))
    result = sketched.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
