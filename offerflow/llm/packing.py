"""Mixture-controlled packing.

Each source is a queue of documents. Windows of ``window`` tokens are filled to
target proportions by deficit round-robin: through window ``w`` of ``W`` a queue has
sent ``floor(T * (w + 1) / W)`` of its ``T`` tokens, and the fraction below a token
is the deficit that it carries into the next window. As this is a closed form,
any window can be filled without those before it: no task walks a whole queue,
and nothing is lost between partitions. Within a window the queues take turns by
the share of their own stream that has been sent, a document at a time.

Targets are shares of the tokens by source; what they leave goes to all other
sources, which make one queue. Queues send at these rates until the first one is
empty, which ends a phase; then the others share its part by their rates, and so on.
A queue's deficit is carried from phase to phase. Without targets a queue's rate is its share of
all tokens, with which all queues end together and there is one phase.

Windows lie end to end and are cut into sequences of ``length`` tokens, so that
only the last sequence has padding.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32, cut, new_table_path, slices
from .tokens import encoder, id_type

#: Documents in a task that orders a part of a queue.
PART_DOCUMENTS = 2_000
#: The queue of all sources that have no target; no source that has one is called so.
REST = "\0rest"


def stage_tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Encode each whole text once and store the ids; ``row`` tells rows with the same ``doc_id`` apart."""
    def run(batches):
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in slices(batches):
            ids = [enc.encode(text) + end for text in batch.column(2).to_pylist()]
            digest = pa.array([crc32(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64()), digest, pa.array(ids, pa.binary())], ["doc_id", "source", "n_tokens", "digest", "ids"])

    source = F.coalesce("source", F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select("doc_id", source.alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    target = new_table_path(docs.sparkSession, "packing")
    rows.mapInArrow(run, "doc_id long, source string, n_tokens long, digest long, ids binary").withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(target)
    return docs.sparkSession.read.parquet(target)


def queue_places(lengths: DataFrame) -> DataFrame:
    """``a``, the tokens of its own queue before each document, and ``total``, those of the whole queue.

    A queue is ordered by a hash of the document, which mixes it, and summed in
    parts of bounded size, so that a queue with a third of all rows is no task.
    """
    parts = max(1, lengths.count() // PART_DOCUMENTS)
    keyed = lengths.withColumn("part", F.pmod(F.xxhash64("doc_id", "digest", "row"), F.lit(parts)))
    sums = keyed.groupBy("source", "part").agg(F.sum("n_tokens").alias("sum"))
    queue = Window.partitionBy("source")
    before = queue.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"), F.sum("sum").over(queue).alias("total"))
    within = Window.partitionBy("source", "part").orderBy("doc_id", "digest", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("prefix", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(sums, ["source", "part"]).withColumn("a", F.col("base") + F.col("prefix")).drop("part", "base", "prefix")


def phases(totals: dict[str, int], targets: dict[str, float], window: int) -> list[tuple]:
    """``(queue, begin, end, first_window, n_windows)``: which of its tokens a queue sends in each phase, and the windows of that phase."""
    rates = {q: Fraction(str(w)) for q, w in targets.items()}
    rates[REST] = 1 - sum(rates.values())
    if min(rates.values()) < 0:
        raise ValueError("targets are shares of 1 at most together, and none is negative")
    sent, due = dict.fromkeys(totals, 0), dict.fromkeys(totals, Fraction(0))
    found, first = [], 0
    while left := {q: n - due[q] for q, n in totals.items() if n > due[q]}:
        rate = {q: rates[q] for q in left if rates[q] > 0} or dict.fromkeys(left, Fraction(1))  # what has no share comes last
        turns = min(left[q] / r for q, r in rate.items())
        for q, r in rate.items():
            due[q] += r * turns
        now = {q: (sent[q], int(due[q])) for q in rate}
        windows = -(-sum(end - begin for begin, end in now.values()) // window)
        found += [(q, begin, end, first, windows) for q, (begin, end) in now.items() if begin < end]
        sent |= {q: end for q, (_, end) in now.items()}
        first += windows
    return found


def in_phases(placed: DataFrame, targets: dict[str, float] | None, window: int) -> DataFrame:
    """The documents cut at the ends of phases: ``a`` and ``total`` are of the phase, ``skip`` tokens of the document come before."""
    if targets is None:
        n_windows = max(1, -(-(placed.agg(F.sum("n_tokens")).first()[0] or 0) // window))
        return placed.withColumns({"skip": F.lit(0).cast("long"), "first_window": F.lit(0).cast("long"), "n_windows": F.lit(n_windows).cast("long")})
    totals = {r.source: r.total for r in placed.groupBy("source").agg(F.max("total").alias("total")).collect()}  # a queue for each target, and one
    table = placed.sparkSession.createDataFrame(phases(totals, targets, window), "queue string, begin long, end long, first_window long, n_windows long")
    meets = (F.col("source") == F.col("queue")) & (F.col("a") < F.col("end")) & (F.col("a") + F.col("n_tokens") > F.col("begin"))
    met = placed.join(F.broadcast(table), meets)  # a row for each queue and phase, so for each two targets at most
    low, high = F.greatest("a", "begin"), F.least(F.col("a") + F.col("n_tokens"), "end")
    return met.select("row", "source", (low - F.col("begin")).alias("a"), (high - low).alias("n_tokens"), (F.col("end") - F.col("begin")).alias("total"), (low - F.col("a")).alias("skip"), "first_window", "n_windows")


def fill_windows(placed: DataFrame) -> DataFrame:
    """Cut the documents at the ends of windows: ``(row, source, from, size, window, turn)``."""
    wide = "cast({} as decimal(38,0))"
    window_of = lambda x: f"cast(({wide.format(x)} + 1) * n_windows - 1 as decimal(38,0)) div total"
    sent = lambda w: f"cast({wide.format('total')} * ({w}) div n_windows as bigint)"
    # A queue of fewer tokens than windows has none in most of them: there the windows are those of its tokens.
    windows = f"if(total < n_windows, array_distinct(transform(sequence(a, a + n_tokens - 1), t -> {window_of('t')})), sequence({window_of('a')}, {window_of('a + n_tokens - 1')}))"
    return (
        placed.withColumn("window", F.explode(F.expr(windows)))
        .withColumn("lo", F.expr(f"greatest(a, {sent('window')})"))
        .withColumn("hi", F.expr(f"least(a + n_tokens, {sent('window + 1')})"))
        .select("row", "source", (F.col("skip") + F.col("lo") - F.col("a")).alias("from"), (F.col("hi") - F.col("lo")).alias("size"), (F.col("first_window") + F.col("window")).alias("window"), (F.col("lo") / F.col("total")).alias("turn"))
    )


def place_pieces(filled: DataFrame, length: int) -> DataFrame:
    """Lay the windows end to end and cut at the ends of sequences: ``(row, from, size, sequence_id, offset)``."""
    bases = filled.groupBy("window").agg(F.sum("size").alias("size"))
    # Windows are few; their sums are themselves summed in parts of 4096 windows.
    parts = bases.withColumn("part", F.expr("window div 4096"))
    before = lambda keys, by: (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    coarse = parts.groupBy("part").agg(F.sum("size").alias("sum")).select("part", F.coalesce(F.sum("sum").over(before((), "part")), F.lit(0)).alias("above"))
    bases = parts.join(coarse, "part").select("window", (F.col("above") + F.coalesce(F.sum("size").over(before(("part",), "window")), F.lit(0))).alias("base"))
    turn = Window.partitionBy("window").orderBy("turn", "source", "row").rowsBetween(Window.unboundedPreceding, -1)
    at = filled.withColumn("at", F.coalesce(F.sum("size").over(turn), F.lit(0))).join(bases, "window").withColumn("at", F.col("at") + F.col("base"))
    return (
        at.withColumn("sequence_id", F.explode(F.expr(f"sequence(at div {length}, (at + size - 1) div {length})")))
        .withColumn("lo", F.greatest("at", F.col("sequence_id") * length))
        .withColumn("hi", F.least(F.col("at") + F.col("size"), (F.col("sequence_id") + 1) * length))
        .select("row", (F.col("from") + F.col("lo") - F.col("at")).alias("from"), (F.col("hi") - F.col("lo")).alias("size"), "sequence_id", (F.col("lo") - F.col("sequence_id") * length).alias("offset"))
    )


def cut_ids(staged: DataFrame, pieces: DataFrame, dtype: str, keep_ids: bool = False) -> DataFrame:
    """The pieces with their ids' crc32, and the ids themselves if asked for. A document's pieces meet its ids once."""
    per_row = pieces.groupBy("row").agg(F.collect_list(F.struct("from", "size", "sequence_id", "offset")).alias("pieces"))
    joined = staged.select("row", "doc_id", "n_tokens", "ids").join(per_row, "row").select("doc_id", "n_tokens", "ids", "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids

    def run(batches):
        for batch in slices(batches, "ids"):
            rows = []
            for doc_id, n, ids, cuts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                whole = np.frombuffer(ids, dtype).astype("<u4").tobytes()
                for c in cuts:
                    part = whole[4 * c["from"] : 4 * (c["from"] + c["size"])]
                    rows.append((doc_id, c["from"], c["size"], crc32(part), n, c["sequence_id"], c["offset"], part)[: len(names)])
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return joined.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, end_id: int = 1, length: int = 2048, window: int = 64 * 2048, keep_ids: bool = False, targets: dict[str, float] | None = None) -> DataFrame:
    """All documents packed into sequences of at most ``length`` tokens, a row for each piece.

    ``targets`` are shares of the tokens of a window by source; None: the shares that the
    sources have in all documents. Null text is empty: a piece of the end id alone. A null
    source is the empty one. Repeated rows are packed as often as they come, and null ids
    stay. Equal places in a queue are told apart by id, ids and row. No documents: no rows.
    """
    staged = stage_tokens(docs, path, end_id)
    lengths = staged.select("row", "doc_id", "source", "n_tokens", "digest")
    if targets is not None:
        lengths = lengths.withColumn("source", F.when(F.col("source").isin(*targets), F.col("source")).otherwise(REST))
    pieces = place_pieces(fill_windows(in_phases(cut(queue_places(lengths)), targets, window)), length)
    return cut_ids(staged, pieces, id_type(path).str, keep_ids)
