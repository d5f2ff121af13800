"""Shared helpers of the training-data operators.

Rows stream through ``mapInArrow``; a task never holds more than one Arrow
batch, which is cut again into slices of a few MB of text.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


#: Only where a session on one machine names no folder, as in tests.
OWN_FOLDER = "file:///tmp/checkpoints/offerflow"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from the session; on a cluster there must be one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or OWN_FOLDER


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor costs no recomputation, and the planner knows the size."""
    path = new_table_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the named columns; whatever else the table has is left out."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes) // limit
        starts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)


def by_slices(texts, values, limit: int = SLICE_BYTES) -> list:
    """``values`` of the UTF-8 texts of a column, which it gets a slice of about ``limit`` bytes at a time."""
    found = []
    for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text", limit):
        found.extend(values(utf8(part.column(0))))
    return found


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def crc32(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    return data.lower().split()


def word_hashes(data: bytes) -> np.ndarray:
    found = words(data)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


# Odd multipliers of the shingle hash, one for each of the word positions.
_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(b"word %d" % i) | 1 for i in range(16)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a permutation of the 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``width`` are one shingle, none is empty."""
    w = word_hashes(data)
    n = len(w) - width + 1
    if len(w) == 0:
        return w
    if n < 1:
        return mix((w * _MULTIPLIERS[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    total = w[:n] * _MULTIPLIERS[0]
    for k in range(1, width):
        total = total + w[k : k + n] * _MULTIPLIERS[k]
    return np.unique(mix(total))
