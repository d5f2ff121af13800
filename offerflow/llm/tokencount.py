"""Token counts through a digest cache.

The cache is a table ``(digest, version, n_tokens)``: ``digest`` is the SHA-256
of the normalised content, ``version`` that of the vocabulary file. Texts are
joined to it; only distinct contents that it lacks are encoded, and their counts
are appended to it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, new_table_path, slices
from .tokens import encoder

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
#: A content with this share of all rows or more is frequent: there are no more of them than that many, so their counts are broadcast.
FREQUENT = 10_000


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def content_digest(text: Column) -> Column:
    """The normalisation keeps every byte that the tokenizer may see: only null becomes the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_cache(spark, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException:
        return spark.createDataFrame([], CACHE_SCHEMA)


def encode_misses(docs: DataFrame, path: str, version: str, cache: str) -> None:
    """Append the counts of the distinct contents that the cache lacks.

    Copies are dropped in each task before contents meet each other or the
    cache, so that a text with a third of all rows is one row of each task.
    """
    known = read_cache(docs.sparkSession, cache).filter(F.col("version") == version).select("digest")
    texts = id_and_text(docs).select(content_digest(F.col("text")).alias("digest"), "text")
    misses = texts.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")

    def run(batches):
        enc = encoder(path)
        for batch in slices(batches):
            counts = [len(enc.encode(text)) // enc.dtype.itemsize for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    misses.mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, in its number.

    Null text counts as empty; repeated rows and null ids stay; no rows give no rows. ``cache`` is a
    table in a folder that all executors share; None starts a new one. Contents that many rows
    share get their count without a shuffle, so that no task has a third of all rows.
    """
    version = tokenizer_version(path)
    cache = cache or new_table_path(docs.sparkSession, "token-counts")
    encode_misses(docs, path, version, cache)
    stored = read_cache(docs.sparkSession, cache).filter(F.col("version") == version)
    counts = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two jobs may have appended the same content
    rows = cut(id_and_text(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("digest")))
    frequent = rows.groupBy("digest").agg(F.count("*").alias("n")).filter(F.col("n") * FREQUENT >= rows.count()).select("digest")
    often = cut(counts.join(frequent, "digest", "left_semi"))  # FREQUENT rows at most
    met = rows.join(F.broadcast(often), "digest", "left")
    rest = rows.join(F.broadcast(often), "digest", "left_anti").join(counts, "digest")
    every = met.filter("n_tokens is not null").unionByName(rest)
    return every.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
