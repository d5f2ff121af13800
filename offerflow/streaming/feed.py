"""Feeds that arrive as files: each micro-batch is merged into the stored snapshot, which lies in buckets of its key."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import last_of_each, upsert

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_snapshot(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A snapshot as a table partitioned by the bucket of its key, a file for each bucket and task at most."""
    rows.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``bucket`` and the columns of the schema."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)


def _is_there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def merge_into(spark: SparkSession, path: str, schema: T.StructType, changes: DataFrame, key: str, staged: str, buckets: int = BUCKETS) -> None:
    """Merge changes, one for each key, into the snapshot; only the buckets that they touch are read and written.

    The new buckets are written to the folder ``staged`` first and marked as whole, then take the place of the old ones. Run again
    after a failure with the same folder, it takes what was staged, so that buckets that were lost half-way come back. While buckets are
    exchanged, readers may see some of them old and some new.
    """
    mark = f"{staged}-whole"
    if not _is_there(spark, mark):
        changes = changes.withColumn("bucket", bucket_of(key, buckets))
        touched = [r.bucket for r in changes.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return
        old = read_snapshot(spark, path, schema).filter(F.col("bucket").isin(touched))
        merged = upsert(old.drop("bucket"), changes.drop("bucket"), key)
        write_snapshot(merged.select(*schema.fieldNames()), staged, key, buckets)
        spark.range(1).write.mode("overwrite").parquet(mark)
    new = read_snapshot(spark, staged, schema)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def merge_batches(spark: SparkSession, source: str, source_schema: T.StructType, path: str, schema: T.StructType, key: str, checkpoint: str, order: str = "ord", files_per_trigger: int = 10, buckets: int = BUCKETS):
    """Start the stream over Parquet files in ``source`` and drain what is there into the snapshot at ``path``, which ``write_snapshot`` began.

    The number of files of a micro-batch is bounded. A batch that is run again after a failure merges to the same snapshot.
    """
    def merge(batch: DataFrame, number: int) -> None:
        merge_into(spark, path, schema, last_of_each(batch, key, order), key, f"{checkpoint}-staged/batch={number}", buckets)

    stream = spark.readStream.schema(source_schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows; the same plan over a table or a stream."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs times with a zone
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
