"""Toxicity: a factorization machine over hashed terms.

``score = sigmoid(bias + sum of w_i + sum over pairs of <v_i, v_j>)`` over the
distinct terms of a text. The pair factors learn what terms mean together, such
as an insult with a group's name, which no sum of single weights can. Training
takes a bounded sample of labelled rows; scoring is a scan with the model, whose
size is fixed by its parameters.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_slices, cut, id_and_text, slices, utf8, words

#: Rows that the model is fitted on at most: those with the smallest hash of their id.
TRAIN_ROWS = 16_000
#: Bytes of the distinct terms of these rows at most, 4 for each; the first rows whose whole texts fit are taken.
TRAIN_BYTES = 256 << 20
BITS = 18
#: Bytes of the beginnings of words that are terms too.
STEMS = (4, 6)
FACTORS = 4
#: A term needs so many training texts to get factors, and so a part in pairs. One whose count of toxic texts is within
#: so many deviations of what is expected means nothing alone: it gets no weight, and its factors learn slowly, against noise.
LEAST_TEXTS = 4
LEAST_DEVIATION = 3.0
SLOW = 300.0
#: Pairs of terms begin together that are toxic so much more often than either alone tells (in nats: once in 10^8 by chance), among
#: terms whose count of toxic texts is at least so many deviations from what is expected; their product begins at these log odds.
LEAST_SURE, LEAST_LIFT, PAIR_LOG_ODDS = 18.4, -0.5, 4.5
#: Pairs that are counted, and that begin together, at most.
MOST_PAIRS, MOST_STARTS = 1 << 24, 32
#: Passes over the training texts. Both were chosen by four folds of the training rows alone.
EPOCHS = 25
THRESHOLD = 0.3
#: The share of toxic texts that is expected before any label is seen.
PRIOR = 0.1


def terms(data: bytes, bits: int = BITS) -> np.ndarray:
    """Distinct hashed words of a whole text, and the beginnings of longer ones, which stand for their stems."""
    found = set(words(data.translate(_LETTERS)))
    stems = {b"%d:%b" % (n, w[:n]) for n in STEMS for w in found if len(w) > n}
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, chain(found, stems)), np.uint64, len(found) + len(stems))
    return np.unique(hashed >> np.uint64(64 - bits)).astype(np.int64)


#: ASCII other than letters and digits separates terms.
_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass
class FactorizationMachine:
    bias: float
    slot: np.ndarray  # by hashed term: its row below, 0 for terms without weights
    w: np.ndarray
    v: np.ndarray

    def scores(self, lists: list[np.ndarray]) -> np.ndarray:
        """Probabilities; a text without known terms gets the bias."""
        size = np.array([len(x) for x in lists])
        rows = self.slot[np.concatenate([*lists, np.zeros(0, np.int64)])]
        doc = np.repeat(np.arange(len(lists)), size)
        known = rows > 0
        rows, doc = rows[known], doc[known]
        n = len(lists)
        z = self.bias + np.bincount(doc, self.w[rows], n)
        for f in range(self.v.shape[1]):
            x = self.v[rows, f]
            z += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_odds(rate):
    return np.log(rate / (1 - rate))


def divergence(rate, expected):
    """Of a share from what is expected, in nats for each text."""
    p, q = np.clip(rate, 1e-12, 1 - 1e-12), expected
    return p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q))


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, texts: np.ndarray, toxic: np.ndarray, share: float, most: int = MOST_PAIRS) -> list[tuple[int, int]]:
    """Pairs of terms that are toxic together far more often than the two alone tell, the surest first.

    ``texts`` and ``toxic`` count the texts of each term. Pairs are counted in the toxic texts, the shortest first, up to ``most`` of them,
    among terms that are not less often toxic than others; those that come together there no more often than by chance are passed over.
    The texts of a pair that is taken count for no later one.
    """
    lift = (toxic - texts * share) / np.sqrt(np.maximum(texts * share * (1 - share), 1e-9))
    likely = lift >= LEAST_LIFT
    likely[0] = False
    n = len(texts)
    pairs_of = lambda x: (x[:, None] * n + x[None, :])[np.triu_indices(len(x), 1)]
    short, keys, left = sorted((np.sort(x[likely[x]]) for x, y in zip(rows, labels) if y), key=len), [], most
    for x in short:
        left -= len(x) * (len(x) - 1) // 2
        if left < 0:
            break
        keys.append(pairs_of(x))
    found, together = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_counts=True)
    rate = (toxic + share) / (texts + 1)
    together_alone = lambda f: 1 / (1 + np.exp(-np.clip(log_odds(rate[f // n]) + log_odds(rate[f % n]) - log_odds(share), -30, 30)))
    by_chance = toxic[found // n] * toxic[found % n] / max(1.0, labels.sum())
    found = found[(together - by_chance >= 3 * np.sqrt(by_chance)) & (-together * np.log(together_alone(found)) >= LEAST_SURE)]
    if not len(found):
        return []
    involved = np.zeros(n, bool)
    involved[np.concatenate([found // n, found % n])] = True
    doc, pair = [], []
    for k, x in enumerate(rows):
        here = np.sort(x[involved[x]])
        at = np.searchsorted(found, own := pairs_of(here)) if len(here) ** 2 <= most else np.zeros(0, np.int64)
        hit = np.flatnonzero(found[np.minimum(at, len(found) - 1)] == own) if len(at) else at
        doc.append(np.full(len(hit), k))
        pair.append(at[hit])
    doc, pair = np.concatenate(doc), np.concatenate(pair)
    expected = together_alone(found)
    chosen, open_doc = [], np.ones(len(rows), bool)
    for _ in range(MOST_STARTS):
        still = open_doc[doc]
        both = np.bincount(pair[still], minlength=len(found))
        bad = np.bincount(pair[still], labels[doc[still]], len(found))
        # How unlikely so many toxic texts are, by a bound on the tail of the binomial distribution.
        sure = np.where(bad > both * expected, both * divergence(bad / np.maximum(both, 1), expected), 0.0)
        best = int(sure.argmax())
        if sure[best] < LEAST_SURE:
            break
        chosen.append((int(found[best] // n), int(found[best] % n)))
        open_doc[doc[pair == best]] = False
    return chosen


def start_factors(v: np.ndarray, pairs: list[tuple[int, int]]) -> None:
    """Let the factors of the pairs begin where their product is ``PAIR_LOG_ODDS``; a term of several pairs has one direction."""
    size, free = np.sqrt(PAIR_LOG_ODDS), list(range(v.shape[1]))
    held: set[int] = set()
    rng = np.random.default_rng(len(pairs))
    for i, j in pairs:
        if i in held and j in held:
            continue
        if i not in held and j not in held:
            if free:
                v[i] = size * np.eye(v.shape[1])[free.pop(0)]
            else:
                v[i] = rng.normal(size=v.shape[1])
                v[i] *= size / np.linalg.norm(v[i])
            v[j] = v[i]
        elif i in held:
            v[j] = v[i]
        else:
            v[i] = v[j]
        held |= {i, j}


def fit(lists: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-3, batch: int = 64, seed: int = 7, bits: int = BITS, factors: int = FACTORS, least: int = LEAST_TEXTS, deviation: float = LEAST_DEVIATION, slow: float = SLOW) -> FactorizationMachine:
    """AdaGrad on the logistic loss, over distinct texts, in batches that are drawn once. The same input gives the same model; no rows give the probability ``PRIOR``."""
    first: dict = {}
    for k, (x, y) in enumerate(zip(lists, labels)):
        first.setdefault((xxhash.xxh3_128_digest(x), y), k)
    lists, labels = [lists[k] for k in first.values()], labels[list(first.values())]
    texts, toxic = np.zeros(1 << bits, np.int64), np.zeros(1 << bits)
    for x, y in zip(lists, labels):
        texts[x] += 1
        toxic[x] += y
    share = (labels.sum() + PRIOR) / (len(labels) + 1)
    used = np.flatnonzero(texts >= least)
    alone = np.append(False, (np.abs(toxic - texts * share) >= deviation * np.sqrt(texts * share * (1 - share)))[used])
    slot = np.zeros(1 << bits, np.int32)
    slot[used] = np.arange(1, len(used) + 1)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(used) + 1), rng.normal(0, 0.01, (len(used) + 1, factors))
    bias, gw, gv, gb = float(np.log(share / (1 - share))), np.full(len(w), 1e-2), np.where(alone, 1e-2, slow)[:, None] * np.ones(factors), 1e-2
    parts = []
    placed = [np.unique(x[x > 0]) for x in (slot[x] for x in lists)]
    start_factors(v, telling_pairs(placed, labels, np.append(0, texts[used]), np.append(0.0, toxic[used]), share))
    order = rng.permutation(len(lists))
    for a in range(0, len(order), batch):
        rows = [placed[i] for i in order[a : a + batch]]
        near, local = np.unique(np.concatenate(rows), return_inverse=True)
        parts.append((labels[order[a : a + batch]], np.repeat(np.arange(len(rows)), [len(x) for x in rows]), near, local))
    for _ in range(epochs):
        for k in rng.permutation(len(parts)):
            truth, doc, near, local = parts[k]
            x = v[near][local]
            total = np.stack([np.bincount(doc, x[:, f], len(truth)) for f in range(factors)], 1)
            z = bias + np.bincount(doc, w[near][local], len(truth)) + 0.5 * ((total**2).sum(1) - np.bincount(doc, (x * x).sum(1), len(truth)))
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - truth
            each = g[doc]
            dw = np.bincount(local, each, len(near)) + decay * w[near]
            gw[near] += dw * dw
            w[near] -= rate * alone[near] * dw / np.sqrt(gw[near])
            part = each[:, None] * (total[doc] - x)
            dv = np.stack([np.bincount(local, part[:, f], len(near)) for f in range(factors)], 1) + decay * v[near]
            gv[near] += dv * dv
            v[near] -= 0.3 * rate * dv / np.sqrt(gv[near])
            gb += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(gb)
    return FactorizationMachine(bias, slot, w, v)


def held_out(doc_id) -> F.Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2 never serve learning; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """Fit on at most ``rows`` labelled documents outside the held-out fold. Unlabelled and null-labelled rows serve nothing; of several labels of an id the largest counts."""
    truth = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").alias("toxic"))
    truth = truth.filter(~held_out(F.col("of"))).orderBy(F.xxhash64("of"), "of").limit(rows)
    sample = id_and_text(docs).join(F.broadcast(truth), F.col("doc_id") == F.col("of"))  # at most ``rows`` ids

    def run(batches):
        for batch in slices(batches):
            lists = [terms(t).astype(np.int32).tobytes() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(2), pa.int32()), pa.array(lists, pa.binary())], ["doc_id", "toxic", "terms"])

    found = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "doc_id long, toxic int, terms binary")
    found = cut(found.withColumns({"hash": F.xxhash64("terms"), "size": F.length("terms")}))
    # A repeated id may give more rows than ids; the bound holds for them as well. Sizes alone meet in the window, then the lists that fit.
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.col("hash")
    so_far = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sizes = found.select("doc_id", "hash", "size").distinct().orderBy(*order).limit(rows)
    fits = sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= TRAIN_BYTES).select("doc_id", "hash")
    first = found.join(F.broadcast(fits), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])  # at most ``rows`` pairs of numbers

    def learn(batches):
        lists, truth = [], []
        for batch in batches:
            lists += [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(1)]
            truth += batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(lists, np.array(truth, np.float64)))], pa.binary())], ["model"])

    # The bounded sample lies in one partition; the driver gets the model alone.
    models = first.repartition(1).sortWithinPartitions(*order).select("toxic", "terms").mapInArrow(learn, "model binary").collect()
    return pickle.loads(models[0].model) if models else fit([], np.zeros(0))


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; null text is empty. The rows of one text get one score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            p = shared.value.scores([terms(t) for t in utf8(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_score(docs: DataFrame, model: FactorizationMachine, column: str = "toxicity") -> DataFrame:
    """``docs`` with the score as a further column. Null text is empty; rows and their other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(by_slices(texts, lambda part: shared.value.scores([terms(t) for t in part])), pa.float64())

    return docs.withColumn(column, probability(F.coalesce(F.col("text"), F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` by a model of its labelled rows.

    Null and empty texts and texts without known terms get the score of the bias.
    Repeated rows and null ids stay, and equal texts score alike. Labels that are null,
    of no document or of the held-out fold serve nothing; without others all scores
    are ``PRIOR``. Other columns of both tables are not looked at. No documents: no rows.
    """
    return score(docs, train(docs, labels))
