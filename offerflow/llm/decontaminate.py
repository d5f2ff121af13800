"""Benchmark decontamination: size-partitioned MinHash containment search.

Benchmark items are partitioned by the size of their shingle set, as the number of
MinHash registers that an item needs follows from its size: of ``n`` shingles a
document at the threshold lacks ``m`` at most, so it holds one of the ``m + 1``
with the smallest hashes at least. These are an item's registers, and they make an
inverted index from hash to items for each partition. A document looks its own
shingles up, in the partitions whose items are not too large for it: a short item
is found in a long document as in a short one, at a cost that does not grow with
the number of items but for the logarithm of a search. No pair at or above the
threshold is lost, and what is found is verified by exact containment.

Items are the query set: they are shingled in tasks and go to all tasks in blocks
of bounded size, one block after the other, each meeting all documents in a scan
without a shuffle. A block's results are written before the next one is sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, cut, id_and_text, new_table_path, shingles, slices, utf8

PERCENT = 80
WIDTH = 5
#: Shingles of the items in one block, about; 8 bytes each, and 12 for each register.
BLOCK_SHINGLES = 1 << 20


class ItemBlock:
    """The shingle sets of some items, and the inverted index of the registers of each size partition."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        by_size: dict[int, list[int]] = {}
        for k, (_, s) in enumerate(items):
            by_size.setdefault(len(s).bit_length(), []).append(k)
        self.partitions = []  # the least number of shingles that a document needs, hashes in order, their items
        for numbers in by_size.values():
            needed = [-(-len(items[k][1]) * PERCENT // 100) for k in numbers]
            parts = [items[k][1][: len(items[k][1]) - least + 1] for k, least in zip(numbers, needed)]  # sets are sorted
            hashes, of = np.concatenate(parts), np.repeat(np.array(numbers, np.int32), [len(p) for p in parts])
            order = np.argsort(hashes, kind="stable")
            self.partitions.append((min(needed), hashes[order], of[order]))

    def candidates(self, document: np.ndarray) -> np.ndarray:
        """Items of which the document holds a register."""
        found = [np.zeros(0, np.int32)]
        for least, hashes, of in self.partitions:
            if len(document) < least:
                continue
            if len(hashes) <= len(document):
                at = np.minimum(np.searchsorted(document, hashes), len(document) - 1)
                found.append(of[document[at] == hashes])
            else:
                first, end = np.searchsorted(hashes, document), np.searchsorted(hashes, document, side="right")
                found += [of[a:b] for a, b in zip(first[first < end], end[first < end])]
        return np.unique(np.concatenate(found))

    def matches(self, document: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item_id, shared, item shingles)`` with ``100 * shared >= PERCENT * size``."""
        found = []
        for k in self.candidates(document):
            item_id, s = self.items[k]
            at = np.minimum(np.searchsorted(document, s), len(document) - 1)
            shared = int((document[at] == s).sum())
            if 100 * shared >= PERCENT * len(s):
                found.append((item_id, shared, len(s)))
        return found


def item_sets(items: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, int]:
    """``block, item_id, hashes`` of the items with an id and words, and the number of blocks. Items are dealt to blocks by their hash."""
    def run(batches):
        for batch in slices(batches):
            sets = [shingles(t, WIDTH) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["item_id", "n", "hashes"])

    known = items.select("item_id", "text").filter("text is not null and item_id is not null")
    sets = cut(known.mapInArrow(run, "item_id long, n long, hashes binary").filter("n > 0"))
    blocks = -(-(sets.agg(F.sum("n")).first()[0] or 0) // block_shingles)
    return sets.select(F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))).alias("block"), "item_id", "hashes"), blocks


def item_blocks(items: DataFrame, block_shingles: int = BLOCK_SHINGLES):
    """The number of blocks, and a function that brings one of them to the driver."""
    sets, blocks = item_sets(items, block_shingles)

    def block(k: int) -> ItemBlock:
        rows = sets.filter(F.col("block") == k).select("item_id", "hashes").toArrow()  # about ``block_shingles`` hashes
        return ItemBlock([(i, np.frombuffer(h, np.uint64)) for i, h in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())])

    return blocks, block


def contained_items(docs: DataFrame, items: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, item_id, shared, item_shingles``: items of which a document holds 80 of 100 distinct 5-word shingles or more.

    Texts with fewer than five words are one shingle; null, empty and wordless
    texts contain nothing and are contained nowhere, as are items without an id.
    Repeated rows on either side give repeated pairs. An empty table on either side:
    no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    names = ["doc_id", "item_id", "shared", "item_shingles"]
    schema = "doc_id long, item_id long, shared long, item_shingles long"

    def scan(shared) -> DataFrame:
        def run(batches):
            for batch in slices(batches):
                rows = [(doc_id, *m) for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))) for m in shared.value.matches(shingles(text, WIDTH))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        return id_and_text(docs).mapInArrow(run, schema)

    blocks, block = item_blocks(items, block_shingles)
    if blocks <= 1:
        return scan(spark.sparkContext.broadcast(block(0)))
    target = new_table_path(spark, "contained")
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(block(k))
        scan(shared).write.mode("append").parquet(target)
        shared.destroy()
    return spark.read.schema(schema).parquet(target)


def flag_contaminated(docs: DataFrame, items: DataFrame, column: str = "contaminated", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``docs`` with a boolean column: whether any item is contained, in the sense of ``contained_items``. All rows and columns stay."""
    def hit(shared):
        @F.arrow_udf("boolean")
        def contaminated(texts: pa.Array) -> pa.Array:
            return pa.array(by_slices(texts, lambda part: [bool(shared.value.matches(shingles(t, WIDTH))) for t in part]), pa.bool_())

        return contaminated(F.coalesce(F.col("text"), F.lit("")))

    blocks, block = item_blocks(items, block_shingles)
    flagged = docs.withColumn(column, F.lit(False))
    for k in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block(k))
        flagged = flagged.withColumn(column, F.col(column) | hit(shared))
        if blocks > 1:
            flagged = cut(flagged)
            shared.destroy()
    return flagged


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
ishort AS (SELECT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) END) AS s FROM i WHERE len(w) > 0),
iset AS (SELECT DISTINCT item_id, s FROM ishort),
size AS (SELECT item_id, count(*) AS n FROM iset GROUP BY item_id),
dshort AS (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) END) AS s FROM d WHERE len(w) > 0),
dset AS (SELECT DISTINCT doc_id, s FROM dshort WHERE s IN (SELECT s FROM iset))
SELECT doc_id, item_id, count(*) AS shared, CAST(any_value(n) AS BIGINT) AS item_shingles
FROM dset JOIN iset USING (s) JOIN size USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n)
"""
