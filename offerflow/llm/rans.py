"""Token files: static range asymmetric numeral system.

One frequency table, counted over the whole corpus and scaled to ``2**SCALE``,
serves all blocks. A block holds the ids of consecutive documents, dealt in turn
to interleaved lanes; each lane is a 64-bit coder with 32-bit renormalisation.
Every ``CHECKPOINT`` rounds the lanes' states and the place in the word stream
are stored, so that the parts of a block decode side by side. A block ends with
the crc32 of all that precedes it.

The file format is a table of blocks (``file_no``, ``block_no``, ``payload``),
in ascending ``doc_id`` order, and a table with the counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32, id_and_text, new_table_path, slices
from .tokens import encoder, id_type

SCALE = 20
LOW = 1 << 31
BLOCK_TOKENS = 1 << 18
LANES = 1024
CHECKPOINT = 64
MAGIC = b"RNS1"
_U64, _U32 = np.dtype("<u8"), np.dtype("<u4")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of ``2**SCALE``; a counted id gets 1 at least."""
    total = int(counts.sum())
    if total == 0:
        return counts.astype(np.int64)
    scaled = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (1 << SCALE) / total).astype(np.int64)), 0)
    short = (1 << SCALE) - int(scaled.sum())
    while short:
        # The largest give or get; nothing falls below 1.
        for k in np.argsort(-scaled, kind="stable")[:4096]:
            step = max(short, 1 - int(scaled[k])) if short < 0 else short
            scaled[k] += step
            short -= step
            if not short:
                break
    return scaled


class Model:
    def __init__(self, scaled: np.ndarray):
        self.f = scaled.astype(np.uint64)
        self.start = (np.cumsum(scaled) - scaled).astype(np.uint64)
        self.limit = self.f << np.uint64(63 - SCALE)
        self._symbol = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))
        return self._symbol


def encode_block(ids: np.ndarray, model: Model) -> bytes:
    n = len(ids)
    lanes = min(LANES, max(1, n // 64))
    rounds = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words, marks, sizes = [], [], np.zeros(rounds + 1, np.int64)
    for t in range(rounds - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        y, f = x[: len(s)], model.f[s]
        full = y >= model.limit[s]
        emitted = (y[full] & np.uint64(0xFFFFFFFF)).astype(_U32)
        y[full] >>= np.uint64(32)
        q = y // f
        x[: len(s)] = (q << np.uint64(SCALE)) + (y - q * f) + model.start[s]
        words.append(emitted)
        sizes[t] = len(emitted)
        if t % CHECKPOINT == 0:
            marks.append(x.astype(_U64).copy())
    place = np.concatenate([[0], np.cumsum(sizes[:rounds])])[0:rounds:CHECKPOINT]
    head = np.array([n, lanes, len(place), int(sizes.sum())], _U32).tobytes()
    return head + place.astype(_U32).tobytes() + b"".join(m.tobytes() for m in marks[::-1]) + b"".join(w.tobytes() for w in words[::-1])


def decode_block(data: bytes, model: Model) -> np.ndarray:
    """All parts between checkpoints at once."""
    n, lanes, parts, size = (int(v) for v in np.frombuffer(data, _U32, 4))
    if n == 0:
        return np.zeros(0, np.uint32)
    place = np.frombuffer(data, _U32, parts, 16).astype(np.int64)
    at = 16 + 4 * parts
    x = np.frombuffer(data, _U64, parts * lanes, at).reshape(parts, lanes).copy()
    words = np.concatenate([np.frombuffer(data, _U32, size, at + 8 * parts * lanes), np.zeros(1, np.uint32)]).astype(np.uint64)
    out = np.zeros((parts, CHECKPOINT, lanes), np.uint32)
    left = n - np.arange(parts) * CHECKPOINT * lanes
    mask, scale, symbol = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), model.symbol
    for t in range(CHECKPOINT):
        open_ = left > t * lanes
        k = int(open_.sum())  # only the last part may be shorter
        if k == 0:
            break
        y = x[:k]
        slot = y & mask
        s = symbol[slot]
        out[:k, t] = s
        new = model.f[s] * (y >> scale) + slot - model.start[s]
        more = new < LOW
        if k == parts and left[-1] < (t + 1) * lanes:
            more[-1, left[-1] - t * lanes :] = False
        order = np.cumsum(more, axis=1) - more + place[:k, None]
        new = np.where(more, (new << np.uint64(32)) | words[np.minimum(order, size)], new)
        place[:k] += more.sum(axis=1)
        x[:k] = new
    return out.reshape(-1)[:n]


def pack_block(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, model: Model) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    index = zlib.compress(known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.astype("<i8").tobytes(), 1)
    body = MAGIC + np.array([len(doc_ids), len(index)], _U32).tobytes() + index + encode_block(ids, model)
    return body + crc32(body).to_bytes(4, "little")


def unpack_block(data: bytes, model: Model) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their token counts and all ids; raises on a wrong checksum."""
    if data[:4] != MAGIC or crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("damaged block")
    n, size = (int(v) for v in np.frombuffer(data, _U32, 2, 4))
    index = zlib.decompress(data[12 : 12 + size])
    known, ids = index[:n], np.frombuffer(index, "<i8", n, n).tolist()
    lengths = np.frombuffer(index, "<i8", n, 9 * n)
    return [d if k else None for d, k in zip(ids, known)], lengths, decode_block(data[12 + size : -4], model)


def stage_tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Encode every whole text once. Rows of kind 0 have a document's packed ids, one of kind 1 for each task the counts of its ids."""
    names = ["kind", "doc_id", "tie", "data"]
    row = lambda kind, ids, ties, data: pa.RecordBatch.from_arrays([pa.array([kind] * len(data), pa.int8()), ids, pa.array(ties, pa.int64()), pa.array(data, pa.binary())], names)

    def run(batches):
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        total = np.zeros(max(enc.vocabulary, end_id + 1), np.int64)
        for batch in slices(batches):
            ids = [enc.encode(text) + end for text in batch.column(1).to_pylist()]
            total += np.bincount(np.frombuffer(b"".join(ids), enc.dtype), minlength=len(total))
            yield row(0, batch.column(0), [crc32(x) for x in ids], [zlib.compress(x, 1) for x in ids])
        seen = np.flatnonzero(total)
        if len(seen):
            yield row(1, pa.nulls(1, pa.int64()), [0], [np.stack([seen, total[seen]]).astype("<i8").tobytes()])

    target = new_table_path(docs.sparkSession, "staged-tokens")
    id_and_text(docs).mapInArrow(run, "kind byte, doc_id long, tie long, data binary").write.option("compression", "none").parquet(target)
    return docs.sparkSession.read.parquet(target)


def token_counts(staged: DataFrame) -> DataFrame:
    """``id, n`` over all texts: a row for each id that a task saw, summed before they meet."""
    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                ids, n = np.frombuffer(data, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "n"])

    return staged.filter("kind = 1").select("data").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def count_vector(counts: DataFrame) -> np.ndarray:
    """The counts on the driver: a number for each vocabulary entry."""
    rows = counts.toArrow()
    ids, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("id", "n"))
    vector = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    vector[ids] = n
    return vector


def write_token_files(docs: DataFrame, path: str, end_id: int, target: str) -> None:
    """Encode every whole text, append ``end_id``, and write the blocks in ascending ``doc_id`` order.

    Null text is empty; a null id sorts first; repeated rows stay, next to each other.
    Only the counts (a row for each vocabulary entry) come to the driver.
    """
    spark = docs.sparkSession
    staged = stage_tokens(docs, path, end_id)
    token_counts(staged).coalesce(1).write.parquet(f"{target}/counts")
    shared = spark.sparkContext.broadcast(count_vector(spark.read.parquet(f"{target}/counts")))
    dtype = id_type(path)

    def run(batches):
        model = Model(frequencies(shared.value))
        file_no, block_no, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, size = [], [], 0

        def flush():
            nonlocal doc_ids, parts, size, block_no, first
            lengths = np.array([len(p) // dtype.itemsize for p in parts], np.int64)
            payload = pack_block(doc_ids, lengths, np.frombuffer(b"".join(parts), dtype).astype(np.int64), model)
            row = pa.RecordBatch.from_arrays([pa.array([file_no], pa.int64()), pa.array([block_no], pa.int64()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], ["file_no", "block_no", "first_token", "n_tokens", "payload"])
            first, block_no = first + size, block_no + 1
            doc_ids, parts, size = [], [], 0
            return row

        for batch in slices(batches, "data"):
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                ids = zlib.decompress(data)
                doc_ids.append(doc_id)
                parts.append(ids)
                size += len(ids) // dtype.itemsize
                if size >= BLOCK_TOKENS:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered = staged.filter("kind = 0").select("doc_id", "tie", "data").repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.mapInArrow(run, "file_no long, block_no long, first_token long, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{target}/blocks")


def read_token_files(spark, source: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document, in any order of rows; ``start`` counts the ids of all documents before it."""
    blocks = spark.read.parquet(f"{source}/blocks")
    totals = sorted((r[0], r[1]) for r in blocks.groupBy("file_no").agg(F.sum("n_tokens")).collect())  # a row for each file
    before, total = {}, 0
    for file_no, n in totals:
        before[file_no] = total
        total += n
    shared = spark.sparkContext.broadcast((count_vector(spark.read.parquet(f"{source}/counts")), before))

    def run(batches):
        table, before = shared.value
        model = Model(frequencies(table))
        for batch in batches:
            for file_no, first, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                doc_ids, lengths, ids = unpack_block(payload, model)
                ends = lengths.cumsum()
                data = ids.astype(_U32).tobytes()
                edges = (4 * np.concatenate([[0], ends])).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(before[file_no] + first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([data[a:b] for a, b in zip(edges, edges[1:])], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("file_no", "first_token", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder, read them back, and return each document's place, length and crc32."""
    target = new_table_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, end_id, target)
    return read_token_files(docs.sparkSession, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
