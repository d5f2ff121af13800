"""LM scoring: prediction by partial matching.

A trie of byte contexts up to ``ORDER`` holds how often each symbol followed
each context in the training texts. A text's code length is found with escape
method C and symbol exclusion: a symbol that a context has not seen escapes to
the next shorter one, where symbols that the longer one has seen do not count.
Texts end with a symbol of their own, so that scores are of whole texts.

A pretrained trie does not change while it scores, so the cost of each symbol after
the ``ORDER`` before it, a gram, is known beforehand. The trie is counted over all
training texts and kept whole, as a table, and so are the costs of all grams that
the texts to score have. The costs of the most frequent grams, ``FAST_GRAMS`` at
most, are broadcast; a text's other grams meet theirs in a join, a row for each
distinct one. What is broadcast changes the time and no score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, slices, utf8, words

ORDER = 5
#: Grams whose costs go to all tasks, at most; 12 bytes each.
FAST_GRAMS = 1 << 20
#: Symbols: 1 to 256 are bytes, 257 is the end, 0 is before the start.
SYMBOLS, END, BITS = 257, 257, 9
COUNT_SLICE, SCORE_SLICE = 6 << 20, 1 << 20
#: Words whose counts go to all tasks: those that are more than one in so many training tokens, so fewer than that.
FREQUENT = 1 << 18
END_WORD = xxhash.xxh3_64_intdigest(b" end")


def in_training(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 7 is not 2; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def symbol_stream(texts: list[bytes], order: int) -> np.ndarray:
    """``order`` zeros, the symbols and the end of each text."""
    size = np.array([len(t) for t in texts]) + order + 1
    stream = np.zeros(int(size.sum()), np.int64)
    starts = np.concatenate([[0], size.cumsum()])[:-1]
    real = np.ones(len(stream), bool)
    pads = (starts[:, None] + np.arange(order)).ravel()
    real[pads] = False
    ends = starts + size - 1
    stream[ends] = END
    body = real.copy()
    body[ends] = False
    stream[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    return stream


def grams(texts: list[bytes], order: int) -> np.ndarray:
    """Each symbol of each text with the ``order`` symbols before it, packed in 9 bits each, the newest lowest."""
    s = symbol_stream(texts, order)
    found = s[order:].copy()
    for k in range(1, order + 1):
        found |= s[order - k : len(s) - k] << (BITS * k)
    return found[s[order:] > 0]


def gram_counts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams(texts, order), return_counts=True)


def distinct(of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of each text, and how often they come. ``of``: the text of each key, in ascending order."""
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return of[first], keys[first], np.diff(np.append(first, len(keys)))


def text_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams of each text: the text's number, the gram and how often it comes."""
    spare = 63 - BITS * (order + 1)
    if spare < 1:
        return distinct(np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts]), grams(texts, order))
    parts = []
    for a in range(0, len(texts), 1 << spare):  # a text's number fits in the bits that its grams leave
        some = texts[a : a + (1 << spare)]
        number = np.repeat(np.arange(len(some)), [len(t) + 1 for t in some])
        both, times = np.unique(number << (63 - spare) | grams(some, order), return_counts=True)
        parts.append((a + (both >> (63 - spare)), both & ((1 << (63 - spare)) - 1), times))
    return tuple(np.concatenate(c) for c in zip(*parts))


def count_corpus(docs: DataFrame, order: int) -> DataFrame:
    """``kind, key, n``: grams (0) and words (1, with the end of each text) of the training texts, summed in each task before they meet; grams of the other texts count 0."""
    def run(batches):
        for batch in slices(batches, "text", COUNT_SLICE):
            texts = utf8(batch.column(1))
            trained = batch.column(2).to_pylist()
            parts = []
            if others := [t for t, x in zip(texts, trained) if not x]:
                unlearned = gram_counts(others, order)[0]
                parts.append((0, unlearned, np.zeros(len(unlearned), np.int64)))
            if texts := [t for t, x in zip(texts, trained) if x]:
                found = [w for t in texts for w in words(t)]
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
                found_words, m = np.unique(np.append(hashes, np.full(len(texts), END_WORD, np.uint64)), return_counts=True)
                parts += [(0, *gram_counts(texts, order)), (1, found_words.view(np.int64), m)]
            for kind, k, c in parts:
                for a in range(0, len(k), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[part]), kind, np.int8)), pa.array(k[part], pa.int64()), pa.array(c[part], pa.int64())], ["kind", "key", "n"])

    texts = id_and_text(docs).select("doc_id", "text", in_training(F.col("doc_id")).alias("trained"))
    return texts.mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _by_order(values: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("order") + 1)


def trie(grams: DataFrame, order: int) -> DataFrame:
    """``order, context, symbol, n``: all contexts of all orders, with what followed them."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(order)))
    rows = grams.filter("n > 0").withColumn("order", levels)
    mask = _by_order([(1 << BITS * k) - 1 for k in range(order + 1)])
    rows = rows.select("order", F.shiftright("key", BITS).bitwiseAND(mask).alias("context"), F.col("key").bitwiseAND((1 << BITS) - 1).cast("int").alias("symbol"), "n")
    top = _by_order([1 << BITS * max(0, k - 1) for k in range(order + 1)])
    rows = rows.filter((F.col("order") == 0) | (F.col("context") >= top))  # what reaches before the start is no context of this order
    return cut(rows.groupBy("order", "context", "symbol").agg(F.sum("n").alias("n")))


def gram_costs(grams: DataFrame, rows: DataFrame, order: int) -> DataFrame:
    """``key, cost, n``: the log10 probability of each gram of ``grams`` by the whole trie, and how often training has it.

    A gram of the trie has its share in its context. Any other escapes through
    its shorter contexts; of these a symbol counts if the longer has not seen it,
    and all that the longer has seen the shorter has too. Contexts and keys of
    different orders differ, as a context begins with a symbol above 0.
    """
    whole = F.col("context") * (1 << BITS) + F.col("symbol")
    rows = rows.withColumn("key", whole)
    of_context = rows.groupBy("order", "context").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    shared = rows.join(of_context, ["order", "context"])
    seen = shared.filter(F.col("order") == order).select("key", F.log10(F.col("n") / (F.col("all") + F.col("kinds"))).cast("float").alias("cost"), "n")

    # Grams of the order itself that training lacks, and those at the starts of texts, at each order that they reach. The contexts of
    # orders 0 and 1 are few, whatever the corpus, and most grams escape to them: they are broadcast, and only longer ones meet in a shuffle.
    low = min(1, order)
    start = F.col("key") < (1 << BITS * order)
    wanted = grams.filter((F.col("n") == 0) | start).select("key", F.col("n").alias("own"))
    reached = F.filter(F.array(*map(F.lit, range(low + 1, order + 1))).cast("array<int>"), lambda k: F.col("key") >= F.element_at(F.array(*[F.lit(1 << BITS * k) for k in range(order + 1)]), k + 1))
    levels = wanted.select("key", "own", F.explode_outer(reached).alias("order"))
    part = F.col("key").bitwiseAND(_by_order([(1 << BITS * (k + 1)) - 1 for k in range(order + 1)]))
    levels = levels.select(F.col("key").alias("of"), "own", "order", part.alias("key"), F.shiftright(part, BITS).alias("context"))
    # How often the next shorter context had the symbols that a context has seen.
    needed = rows.join(levels.select("context").distinct(), "context", "left_semi").filter(F.col("order") > low)
    shorter = F.col("key").bitwiseAND(_by_order([(1 << BITS * k) - 1 for k in range(order + 1)]))
    upper = needed.select("context", shorter.alias("key")).join(rows.select("key", "n"), "key").groupBy("context").agg(F.sum("n").alias("above"))
    met = levels.join(rows.filter(F.col("order") > low).select("key", "n"), "key", "left").join(of_context.filter(F.col("order") > low).drop("order"), "context", "left").join(upper, "context", "left")
    at = lambda c, k: F.max(F.when(F.col("order") == k, F.col(c))).alias(f"{c}{k}")
    wide = met.groupBy("of").agg(F.max("own").alias("own"), *[at(c, k) for c in ("n", "all", "kinds", "above") for k in range(low + 1, order + 1)])
    few = cut(rows.filter(F.col("order") <= low).join(of_context, ["order", "context"]))  # 257 + 257 * 257 rows at most
    for k in range(low + 1):
        here = F.col("of").bitwiseAND((1 << BITS * (k + 1)) - 1)
        wide = wide.withColumn("_key", F.when(F.lit(k == 0) | (F.col("of") >= 1 << BITS * k), here)).withColumn("_context", F.shiftright("_key", BITS))
        of_order = few.filter(F.col("order") == k)
        above = of_order.select("context", F.col("key").bitwiseAND((1 << BITS * k) - 1).alias("key")).join(few.filter(F.col("order") == k - 1).select("key", "n"), "key").groupBy("context").agg(F.sum("n").alias("above"))
        contexts = of_order.select("context", "all", "kinds").distinct().join(above, "context", "left")
        wide = wide.join(F.broadcast(of_order.select(F.col("key").alias("_key"), F.col("n").alias(f"n{k}"))), "_key", "left")
        wide = wide.join(F.broadcast(contexts.select(F.col("context").alias("_context"), F.col("all").alias(f"all{k}"), F.col("kinds").alias(f"kinds{k}"), F.col("above").alias(f"above{k}"))), "_context", "left").drop("_key", "_context")
    spare = rows.filter("order = 0").select("symbol").distinct().count()
    unseen = cost = F.lit(1.0 / max(1, SYMBOLS - spare))  # given the escape of the context; by the longest context there is
    for k in range(order + 1):
        n, total, kinds = (F.col(f"{c}{k}") for c in ("n", "all", "kinds"))
        if k:
            left, others = F.col(f"all{k - 1}") - F.col(f"above{k}"), F.col(f"kinds{k - 1}") - kinds
            unseen = F.when(left + others == 0, unseen).when(F.col(f"n{k - 1}").isNotNull(), F.col(f"n{k - 1}") / (left + others)).otherwise(others / (left + others) * unseen)
        cost = F.when(total.isNull(), cost).otherwise(F.when(n.isNotNull(), n / (total + kinds)).otherwise(kinds / (total + kinds) * unseen))
    return seen.unionByName(wide.select(F.col("of").alias("key"), F.log10(cost).cast("float").alias("cost"), F.col("own").alias("n")))


def fast_grams(costs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Keys and costs of the most frequent grams, ``most`` at most, and how often a gram must come to be among them."""
    step = F.floor(F.log2("n") * 8)
    sizes = costs.filter("n > 0").groupBy(step.alias("step")).agg(F.count("*").alias("size")).collect()  # a few hundred
    least, room = 1 << 40, most
    for r in sorted(sizes, key=lambda r: -r.step):
        if (room := room - r["size"]) < 0:
            break
        least = r.step
    table = costs.filter((F.col("n") > 0) & (step >= least)).select("key", "cost").toArrow()
    keys = table.column("key").to_numpy().astype(np.int64)
    by_key = np.argsort(keys)
    return keys[by_key], table.column("cost").to_numpy()[by_key], least


def score(docs: DataFrame, counts: DataFrame, costs: DataFrame, order: int, most_grams: int) -> DataFrame:
    """Scores of every row by the costs of its grams, and by the counts of its words.

    Frequent words and grams are looked up in the scan; the rest of a text's words
    and grams meet their counts or costs in a join, a row for each distinct one of a text.
    """
    spark = docs.sparkSession
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counts.filter(F.col("n") > total // FREQUENT).toArrow()
    by_word = np.argsort(frequent.column("word").to_numpy().astype(np.int64))
    gram_keys, gram_cost, least = fast_grams(costs, most_grams)
    shared = spark.sparkContext.broadcast((gram_keys, gram_cost, frequent.column("word").to_numpy().astype(np.int64)[by_word], frequent.column("n").to_numpy().astype(np.int64)[by_word]))
    floor = float(total + kinds + 1)
    names = ["row", "doc_id", "kind", "word", "times", "n_tokens", "n_known", "base", "score"]
    schema = "row long, doc_id long, kind byte, word long, times long, n_tokens long, n_known long, base double, score double"

    def look_up(known, keys):
        """The places of the keys among the known ones, and which are there."""
        if not len(known):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return at, known[at] == keys

    def run(batches):
        gram_keys, gram_cost, known, n = shared.value
        value = np.log10((n + 1) / floor)
        task, number = TaskContext.get().partitionId() << 40, 0
        for batch in slices(batches, "text", SCORE_SLICE):
            texts = utf8(batch.column(1))
            found = [words(t) for t in texts]
            size = np.array([len(w) + 1 for w in found])
            hashes = np.fromiter((h for w in found for h in (*map(xxhash.xxh3_64_intdigest, w), END_WORD)), np.uint64, int(size.sum())).view(np.int64)
            doc = np.repeat(np.arange(len(texts)), size)
            at, hit = look_up(known, hashes)
            base = np.bincount(doc[hit], value[at[hit]], len(texts))
            rows = task + number + np.arange(len(texts))
            number += len(texts)
            gram_doc, gram, gram_times = text_grams(texts, order)
            gram_at, gram_hit = look_up(gram_keys, gram)
            scores = np.bincount(gram_doc[gram_hit], gram_times[gram_hit] * gram_cost[gram_at[gram_hit]].astype(np.float64), len(texts))
            none = lambda k, t: pa.nulls(k, t)
            # A text's own row; its key meets no word's, as it is null.
            yield pa.RecordBatch.from_arrays([
                pa.array(rows, pa.int64()), batch.column(0), none(len(texts), pa.int8()), none(len(texts), pa.int64()), none(len(texts), pa.int64()), pa.array(size, pa.int64()),
                pa.array(np.bincount(doc, hit, len(texts)).astype(np.int64)), pa.array(base, pa.float64()), pa.array(scores, pa.float64()),
            ], names)
            for kind, (d, k, times) in ((1, distinct(doc[~hit], hashes[~hit])), (0, (gram_doc[~gram_hit], gram[~gram_hit], gram_times[~gram_hit]))):
                for a in range(0, len(k), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    m = len(k[part])
                    yield pa.RecordBatch.from_arrays([pa.array(rows[d[part]], pa.int64()), none(m, pa.int64()), pa.array(np.full(m, kind, np.int8)), pa.array(k[part], pa.int64()), pa.array(times[part], pa.int64()), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), none(m, pa.float64())], names)

    scanned = id_and_text(docs).mapInArrow(run, schema)
    # Rows without a word are dealt by a key of their own, of a kind that nothing else has.
    key, kind = F.coalesce("word", F.xxhash64("row")), F.coalesce("kind", F.lit(2).cast("byte"))
    rest = costs.filter((F.col("n") == 0) | (F.floor(F.log2("n") * 8) < least))
    known = counts.select(F.col("word").alias("of"), F.lit(1).cast("byte").alias("of_kind"), "n", F.lit(None).cast("float").alias("cost"))
    known = known.unionByName(rest.select(F.col("key").alias("of"), F.lit(0).cast("byte").alias("of_kind"), "n", "cost"))
    met = scanned.withColumns({"key": key, "kind": kind}).join(known, (F.col("key") == F.col("of")) & (F.col("kind") == F.col("of_kind")), "left")
    n = F.when(F.col("kind") == 1, F.coalesce("n", F.lit(0)))
    parts = met.select(
        "row", "doc_id", "n_tokens",
        F.coalesce("n_known", F.when(n > 0, F.col("times")), F.lit(0)).alias("n_known"),
        F.coalesce("base", F.col("times") * F.log10((n + 1) / F.lit(floor))).alias("base"),
        F.coalesce("score", F.col("times") * F.col("cost").cast("double")).alias("score"),
    )
    summed = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return summed.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame, order: int = ORDER, most_grams: int = FAST_GRAMS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Null text is empty: its end alone. Repeated rows are scored one by one, and
    count in training as often as they come. Without training texts all symbols
    are equally likely. No rows: no rows. Scores do not depend on ``most_grams``.
    """
    counted = cut(count_corpus(docs, order))
    found = counted.filter("kind = 0").select("key", "n")
    costs = cut(gram_costs(found, trie(found, order), order))
    return score(docs, counted.filter("kind = 1").select(F.col("key").alias("word"), "n"), costs, order, most_grams)
