"""Tables that hold what is worked on, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the driver and all executors share; on one machine without such a setting, a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or 'file:///tmp/checkpoints/offerflow').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage ends there."""
    path = work_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df`` for a join whose two sides grow with the data: both are sorted, none goes through the driver.

    Spark takes a table for as large as its files. Rows that repeat each other are many times that, so that it would broadcast millions of them.
    """
    return df.hint("merge")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly over as many tasks as a shuffle has, for work that takes long for each byte: a small file is one task otherwise."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
