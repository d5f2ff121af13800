"""From raw documents to packed training sequences: toxic documents go, one of each group of near-duplicates
stays, documents that hold benchmark items go, and the rest is packed by source.

Each stage takes the rows that its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerflow.llm.common import new_table_path, read_table
from offerflow.llm.decontaminate import flag_contaminated
from offerflow.llm.hyperminhash import near_duplicates
from offerflow.llm.packing import pack
from offerflow.llm.tokens import vocabulary_path
from offerflow.llm.toxicity import THRESHOLD, train, with_score

#: Shared 5-word shingles, of 100 that two texts have together, that make them near-duplicates here.
NEAR_PERCENT = 80


def _free(docs: DataFrame, name: str) -> str:
    """A column name like this one that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of the toxicity model, which learns from the labels of these documents.

    Null texts are scored as empty ones. Repeated rows and null ids stay or go as
    others do. Without labels all scores are low and all documents stay. No documents: no rows.
    """
    model = train(docs, read_table(spark, sf_dir, "labels"))
    score = _free(docs, "_toxicity")
    return with_score(docs, model, score).filter(F.col(score) < THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Texts that are null, empty or without words are in no group and stay. A document is
    its id: repeated rows of an id that is kept all stay, whatever their texts. Rows
    without an id stay where their group has no id at all. No documents: no rows.
    """
    of = _free(docs, "_kept_id")
    kept = near_duplicates(docs, NEAR_PERCENT).filter("kept").select(F.col("doc_id").alias(of)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(of)), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null, empty and wordless texts hold none and stay, as do all if there is no item.
    Repeated rows and null ids stay or go as others do. No documents: no rows.
    """
    leak = _free(docs, "_leak")
    return flag_contaminated(docs, read_table(spark, sf_dir, "benchmark"), leak).filter(~F.col(leak)).drop(leak)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence. Null texts are empty; repeated rows and null ids are packed as others are. No documents: no rows."""
    return pack(docs, vocabulary_path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # SQL expresses neither the toxicity model nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_table_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
