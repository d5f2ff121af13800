"""Language identification: hyperdimensional profiles.

Every letter, and the gap between words, has a random vector of -1 and 1, drawn from
its code point alone. Three symbols in a row are bound into one vector, the product
of the first turned by two places, the second by one and the third. A text is the sum
of its vectors; a language is the sum over the texts that it is learned from, and a
text belongs to the language whose sum is nearest by cosine. Sums are integers, so
that results do not depend on how texts are dealt to tasks.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, mix, slices
from .toxicity import held_out

DIMENSIONS = 1024
NONE = "und"
#: Bytes of text whose vectors are bound together, and code points of one text at a time.
SLICE, PIECE = 1 << 19, 1 << 20
#: Languages that a task holds or a pass compares.
MOST_LANGUAGES = 256
#: Distinct three-symbol sequences that are bound, and texts that are compared, at a time.
BOUND, TEXTS = 2048, 256


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def symbol_vectors(symbols: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of -1 and 1 for each code point; 0 is the gap."""
    words = -(-dimensions // 64)
    seeds = mix(symbols.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64) + np.uint64(1))
    bits = np.unpackbits(mix(seeds ^ np.uint64(0x9E3779B97F4A7C15)).view(np.uint8).reshape(len(symbols), -1), axis=1)[:, :dimensions]
    return (bits.astype(np.int8) << 1) - 1


def symbols_of(text: str) -> np.ndarray:
    """The code points of the text's letters in lower case; each run of others is one 0, and so are both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.concatenate([[0], np.where(letter_table()[codes], codes, 0), [0]])
    return codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]


def sequences(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of three symbols of one owner, and for each occurrence its owner and its row."""
    inside = np.flatnonzero((owner[2:] == owner[:-2]) & (owner[1:-1] == owner[2:]))
    used = np.zeros(sys.maxunicode + 1, bool)
    used[codes] = True
    alphabet = np.flatnonzero(used)
    number = np.zeros(sys.maxunicode + 1, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    x, size = number[codes], len(alphabet)
    key = (x[inside] * size + x[inside + 1]) * size + x[inside + 2]
    if size**3 <= 1 << 24:  # a table of all keys saves sorting them
        present = np.zeros(size**3, bool)
        present[key] = True
        distinct = np.flatnonzero(present)
        at = np.zeros(size**3, np.int32)
        at[distinct] = np.arange(len(distinct))
        row = at[key]
    else:
        distinct, row = np.unique(key, return_inverse=True)
    return alphabet[np.stack([distinct // (size * size), distinct // size % size, distinct % size], 1)], owner[inside], row


def bind(rows: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vector of each row of three symbols."""
    alphabet, at = np.unique(rows, return_inverse=True)
    vectors, at = symbol_vectors(alphabet, dimensions), at.reshape(rows.shape)
    return np.roll(vectors, 2, axis=1)[at[:, 0]] * np.roll(vectors, 1, axis=1)[at[:, 1]] * vectors[at[:, 2]]


def bundle(texts: list[str], owners: list[int], n: int, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``n`` owners the sum of its texts' vectors, and whether they hold a letter."""
    total, letters = np.zeros((n, dimensions), np.int64), np.zeros(n, bool)

    def add(codes, owner):
        rows, doc, row = sequences(codes, owner)
        for a in range(0, len(rows), BOUND):
            some = rows[a : a + BOUND]
            here = slice(None) if len(some) == len(rows) else (row >= a) & (row < a + BOUND)
            counts = np.bincount(doc[here] * len(some) + row[here] - a, minlength=n * len(some)).reshape(n, len(some))
            # Exact in 32-bit floats: no more than two pieces' code points are summed.
            total[:] += (counts.astype(np.float32) @ bind(some, dimensions).astype(np.float32)).astype(np.int64)

    held, names, size = [], [], 0
    for text, k in zip(texts, owners):
        codes = symbols_of(text)
        letters[k] |= bool(codes.any())
        for a in range(0, max(1, len(codes) - 2), PIECE):  # pieces of a text share two symbols
            held.append(codes[a : a + PIECE + 2])
            names.append(k)
            size += len(held[-1])
            if size >= PIECE:
                add(*_joined(held, names))
                held, names, size = [], [], 0
    if held:
        add(*_joined(held, names))
    return total, letters


def _joined(held: list[np.ndarray], names: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces one after the other and their owners; what lies between two pieces has none, so that no sequence spans both."""
    gap = np.zeros(1, np.int64)
    codes = np.concatenate([x for piece in held for x in (piece, gap)])
    owner = np.repeat(np.array([x for k in names for x in (k, -1)]), [x for piece in held for x in (len(piece), 1)])
    return codes, owner


def profiles(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``lang, at, value``: the vector of each language, a row for each place, summed over all texts of ``docs``."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def gathered():
            for lang, total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([total], pa.list_(pa.int64()))], ["lang", "values"])
            sums.clear()

        for batch in slices(batches, "text", SLICE):
            langs, own = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            for lang, total in zip(langs, bundle(batch.column(0).to_pylist(), own.tolist(), len(langs), dimensions)[0]):
                sums[lang] = sums.get(lang, 0) + total
            if len(sums) > MOST_LANGUAGES:
                yield from gathered()
        yield from gathered()

    found = docs.select("text", "lang").mapInArrow(run, "lang string, values array<long>")
    return found.select("lang", F.posexplode("values").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))


def nearest(total: np.ndarray, names: list[str], unit: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Of each sum the language with the largest cosine, the first by name among equals, and that cosine, 0 at least."""
    length = np.sqrt((total.astype(np.float64) ** 2).sum(axis=1))
    # Rounded, as the last bits depend on how many rows and languages are multiplied at once.
    cosine = (total.astype(np.float64) @ unit.T / np.maximum(length, 1)[:, None]).round(12)
    best = cosine.argmax(axis=1)
    return [names[k] for k in best], cosine[np.arange(len(best)), best].clip(0, 1)


def predict(docs: DataFrame, learned: DataFrame, dimensions: int = DIMENSIONS, most: int = MOST_LANGUAGES) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row. Languages are compared ``most`` at a pass, each of which carries the best so far on."""
    names = sorted(r.lang for r in learned.select("lang").distinct().collect())
    found = id_and_text(docs).select("doc_id", "text", F.lit(NONE).alias("lang_pred"), F.lit(-1.0).alias("score"))
    for a in range(0, max(1, len(names)), most):
        some = names[a : a + most]
        unit = np.zeros((len(some), dimensions))
        at = {name: k for k, name in enumerate(some)}
        for r in learned.filter(F.col("lang").isin(some)).toLocalIterator():  # at most ``most`` vectors
            unit[at[r.lang], r.at] = r.value
        unit /= np.maximum(np.sqrt((unit**2).sum(axis=1)), 1)[:, None]
        found = found.mapInArrow(_compare(some, unit, dimensions), "doc_id long, text string, lang_pred string, score double")
    return found.select("doc_id", "lang_pred", F.greatest("score", F.lit(0.0)).alias("score"))


def _compare(names: list[str], unit: np.ndarray, dimensions: int):
    def run(batches):
        for batch in (part.slice(a, TEXTS) for part in slices(batches, "text", SLICE) for a in range(0, part.num_rows, TEXTS)):
            texts = batch.column(1).to_pylist()
            total, letters = bundle(texts, list(range(len(texts))), len(texts), dimensions)
            langs, scores = batch.column(2).to_pylist(), pc.fill_null(batch.column(3), -1.0).to_numpy(zero_copy_only=False).copy()
            if names:
                near, cosine = nearest(total, names, unit)
                for k in np.flatnonzero(letters & (cosine > scores)):
                    langs[k], scores[k] = near[k], cosine[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "text", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, by the languages of the rows outside the held-out fold.

    The score is the cosine with the predicted language's vector, 0 where it is
    negative. Null and empty texts, and those without a letter, are ``und`` with 0, as
    are all if nothing is learned. Rows without a lang or a text teach nothing; repeated
    rows count as often as they come and are predicted one by one; equal texts get equal
    rows but for their ids. A null id is the empty text in the choice of the fold. Ties
    go to the first language by name. Texts are read whole. Other columns are not looked at. No documents: no rows.
    """
    taught = docs.filter("lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    learned = cut(profiles(taught, dimensions))
    return predict(docs, learned, dimensions).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
