"""Conversation prefix trie: the Cartesian tree over the LCP array of sorted conversations.

Conversations are sequences of turn tokens of fixed width, so that sorting them as
bytes puts those with a common prefix side by side; equal ones are one class. Between
neighbours lies the number of turns that they share (LCP). A node of the trie with
several branches is a run of classes: all boundaries inside share its depth at least,
one exactly, and those at both ends share less. Each end is the nearest smaller value
of the boundaries of that depth.

The sorted classes are cut into blocks, which find the runs that end inside by a stack,
each in one pass. What stays open is the block's outline: its falling minima from the
left, its rising ones from the right, with what lies between them summed; boundaries of
one depth are merged and counted. Outlines are shorter than twice the depth of the trie.
Those of neighbouring blocks, one after the other, are a sequence of the same kind, so
the same pass goes over 64 times as many blocks at each level, until one outline is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat import places
from .common import cut

#: Bytes of a turn's token: of its digest, then the size of its text.
DIGEST, TOKEN = 16, 24
#: Classes in a block, and blocks or outlines that meet at a level.
BLOCK, FAN = 1 << 14, 64
FAMILY, MOST_HEAD = 5, 9
#: Bytes of joined ids that are hashed as one row.
CHUNK = 1 << 20
#: Rows that a task gathers before it passes them on.
BATCH = 5000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, seq, key``: each conversation's rebuilt turns as one string of tokens, and the digest of it."""
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.withColumn("token", F.concat(F.substring(said, 1, 2 * DIGEST), F.lpad(F.hex(F.octet_length("text").cast("long")), 2 * (TOKEN - DIGEST), "0")))
    placed = places(rows).select("conv_id", "place", "token")
    own = cut(placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "token")))["token"].alias("own")))
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("of"), F.slice("own", 1, MOST_HEAD - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD).cast("int")
    met = own.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("of"), "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    seq = F.unhex(F.array_join(F.concat(head, F.slice("own", F.col("h") + 1, F.size("own"))), ""))
    return met.select("conv_id", seq.alias("seq")).withColumn("key", F.unhex(F.sha2("seq", 256)))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // TOKEN
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * TOKEN : middle * TOKEN] == b[low * TOKEN : middle * TOKEN]:
            low = middle
        else:
            high = middle - 1
    return low


CLASS = "part int, pos long, seq binary, w long, least long, lcp int, next_lcp int"


def sorted_classes(sequences: DataFrame) -> DataFrame:
    """The distinct sequences in order, with what each shares with its neighbours; at the ends of all that is -1.

    Tasks compare the neighbours they hold; the first and last rows of the tasks meet afterwards, two for each task.
    """
    classes = sequences.groupBy("seq").agg(F.count("*").alias("w"), F.min("conv_id").alias("least"))
    ordered = classes.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("part", F.spark_partition_id()).select("part", "seq", "w", "least")

    def compare(batches):
        before = None  # the last row, whose next neighbour is not known yet
        pos = 0
        for batch in batches:
            out = []
            for part, seq, w, least in zip(*(c.to_pylist() for c in batch.columns)):
                lcp = None
                if before is not None:
                    lcp = shared(before[2], seq)
                    out.append((*before, lcp))
                before = (part, pos, seq, w, least, lcp)
                pos += 1
            if out:
                yield _batch(out, CLASS)
        if before is not None:
            yield _batch([(*before, None)], CLASS)

    found = cut(ordered.mapInArrow(compare, CLASS))

    def meet(batches):
        before = None
        for batch in batches:
            out = []
            for part, pos, seq, lcp, after in zip(*(c.to_pylist() for c in batch.columns)):
                if lcp is None:
                    lcp = -1 if before is None else shared(before[4], seq)
                    if before is not None:
                        out.append((*before[:3], lcp))
                if after is None:
                    before = (part, pos, lcp, None, seq)
                else:
                    out.append((part, pos, lcp, after))
            if out:
                yield _batch(out, "part int, pos long, lcp int, next_lcp int")
        if before is not None:
            yield _batch([(*before[:3], -1)], "part int, pos long, lcp int, next_lcp int")

    ends = found.filter("lcp is null or next_lcp is null").select("part", "pos", "seq", "lcp", "next_lcp")
    ends = ends.repartition(1).sortWithinPartitions("part", "pos").mapInArrow(meet, "part int, pos long, lcp int, next_lcp int")
    ends = ends.select("part", "pos", F.col("lcp").alias("true_lcp"), F.col("next_lcp").alias("true_next"))
    met = found.join(ends, ["part", "pos"], "left")
    return met.select("part", "pos", "seq", "w", "least", F.coalesce("lcp", "true_lcp").alias("lcp"), F.coalesce("next_lcp", "true_next").alias("next_lcp"))


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


def paid_until(seq: bytes) -> list[int]:
    """Bytes of the texts of the first 0, 1, 2, ... turns."""
    return [0, *np.cumsum(np.frombuffer(seq, ">u8")[2::3].astype(np.int64)).tolist()]


class Run:
    """Neighbouring classes summed up: ``w`` conversations, the ``least`` id, their bytes (``paid``), bytes of distinct turns of theirs that
    the class before does not have (``fresh``), ``leaves``; the ``first`` sequence and what it shares with the one before (``above``)."""

    __slots__ = ("w", "least", "paid", "fresh", "leaves", "first", "above")

    def __init__(self, w, least, paid, fresh, leaves, first, above):
        self.w, self.least, self.paid, self.fresh, self.leaves, self.first, self.above = w, least, paid, fresh, leaves, first, above

    def __add__(self, right: Run) -> Run:
        return Run(self.w + right.w, min(self.least, right.least), self.paid + right.paid, self.fresh + right.fresh, self.leaves + right.leaves, self.first, self.above)

    def fields(self):
        return self.w, self.least, self.paid, self.fresh, self.leaves, self.first, self.above


NODE = "depth long, key binary, parent_key binary, parent_conv_id long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
OPEN = "part int, block long, at long, value int, merged long, w long, least long, paid long, fresh long, leaves long, first binary, above int"


def chain(run: Run, above: int, depth: int, branches: int):
    """The nodes of a run of classes: below ``above`` down to ``depth``, where it has ``branches``."""
    paid = paid_until(run.first)
    known = paid[max(run.above, 0)]
    hashed = hashlib.sha256(run.first[: max(above, 0) * TOKEN])
    for d in range(above + 1, depth + 1):
        before = paid[max(d - 1, 0)]
        top = d == above + 1
        parent = hashed.digest() if top and d else None
        hashed.update(run.first[max(d - 1, 0) * TOKEN : d * TOKEN])
        yield d, hashed.digest(), parent, None if top else run.least, run.least, run.w, branches if d == depth else 1, run.leaves, run.paid - run.w * before - run.fresh - known + before


class Outline:
    """One pass over boundaries with the runs behind them: gives the nodes of runs that end inside, and keeps the outline of what does not."""

    def __init__(self):
        self.rest: list[list] = []  # falling boundaries: value, how many are merged, the run behind
        self.stack: list[list] = []  # rising ones: value, how many, the run before the first, the run behind
        self.run: Run | None = None  # what lies behind the last boundary

    def _close(self, value: int):
        """Runs deeper than a boundary end there."""
        while self.stack and self.stack[-1][0] > value:
            depth, merged, head, behind = self.stack.pop()
            whole = head + (behind + self.run if behind else self.run)
            left = self.stack[-1][0] if self.stack else self.rest[-1][0]
            # The first class may end at the node itself; then it is no branch.
            yield from chain(whole, max(left, value), depth, merged + (len(whole.first) > depth * TOKEN))
            self.run = whole

    def add(self, value: int, merged: int, run: Run):
        yield from self._close(value)
        if self.run is None:
            self.rest.append([value, merged, None])
        elif self.stack:
            if self.stack[-1][0] == value:
                top = self.stack[-1]
                top[1], top[3] = top[1] + merged, top[3] + self.run if top[3] else self.run
            else:
                self.stack.append([value, merged, self.run, None])
        else:
            last = self.rest[-1]
            if value > last[0]:
                self.stack.append([value, merged, self.run, None])
            else:
                last[2] = last[2] + self.run if last[2] else self.run
                if value == last[0]:
                    last[1] += merged
                else:
                    self.rest.append([value, merged, None])
        self.run = run

    def end(self):
        """After the last of all sequences everything ends."""
        yield from self._close(-1)

    def items(self):
        """The outline: ``value, merged, run`` from left to right. Where deeper boundaries may follow, the run behind the last of several stays apart."""
        found = [tuple(x) for x in self.rest[:-1]]
        rising = [(value, merged, behind) for value, merged, _, behind in [(*self.rest[-1][:2], None, self.rest[-1][2]), *self.stack]]
        for (value, merged, behind), after in zip(rising, [*(head for _, _, head, _ in self.stack), self.run]):
            if behind is None:
                found.append((value, merged, after))
            else:
                found += [(value, merged - 1, behind), (value, 1, after)]
        return found


#: Rows of both kinds that a pass gives: those of nodes have no ``part``, those of outlines no ``depth``.
BOTH = f"{NODE}, {OPEN}"
_NODES, _OPENS = NODE.count(",") + 1, OPEN.count(",") + 1


def pass_over(items, last: bool):
    """``items`` are ``group, part, block, value, merged, run, leaf`` in order; a leaf is the depth above its own nodes, or None."""
    out: list[tuple] = []
    now, outline, place = None, Outline(), None

    def flush():
        if last:
            yield from ((*n, *[None] * _OPENS) for n in outline.end())
        else:
            yield from ((*[None] * _NODES, *place, k, value, merged, *run.fields()) for k, (value, merged, run) in enumerate(outline.items()))

    def rows():
        nonlocal now, outline, place
        for group, part, block, value, merged, run, leaf in items:
            if group != now:
                if now is not None:
                    yield from flush()
                now, outline, place = group, Outline(), (part, block)
            yield from ((*n, *[None] * _OPENS) for n in outline.add(value, merged, run))
            if leaf is not None:
                yield from ((*n, *[None] * _OPENS) for n in chain(run, leaf, len(run.first) // TOKEN, 0))
        if now is not None:
            yield from flush()

    for row in rows():
        out.append(row)
        if len(out) == BATCH:
            yield _batch(out, BOTH)
            out = []
    if out:
        yield _batch(out, BOTH)


def trie_nodes(classes: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """The nodes of the trie, without what ends there; only the highest node of a chain names its parent by its key."""
    blocks = classes.withColumn("block", F.floor(F.col("pos") / block)).select("part", "block", "pos", "seq", "w", "least", "lcp", "next_lcp")

    def first_pass(batches):
        def items():
            for batch in batches:
                for part, number, _, seq, w, least, lcp, after in zip(*(c.to_pylist() for c in batch.columns)):
                    paid, turns = paid_until(seq), len(seq) // TOKEN
                    leaf = turns > after
                    own = turns > max(lcp, after)
                    yield (part, number), part, number, lcp, 1, Run(w, least, w * paid[-1], paid[-1] - paid[max(lcp, 0)], int(leaf), seq, lcp), max(lcp, after) if own else None

        yield from pass_over(items(), False)

    found = cut(blocks.repartition("part", "block").sortWithinPartitions("part", "block", "pos").mapInArrow(first_pass, BOTH))
    nodes = [found.filter("depth is not null")]
    parts = found.agg(F.max("part")).first()[0]
    if parts is None:
        return nodes[0].select(*(f.split()[0] for f in NODE.split(", ")))
    width, last = 1, False
    while not last:
        width *= fan
        last = parts < width
        rest = found.filter("part is not null").withColumn("group", F.floor(F.col("part") / width)).select("group", *(f.split()[0] for f in OPEN.split(", ")))

        def further(batches, last=last):
            def items():
                for batch in batches:
                    for group, part, number, _, value, merged, *run in zip(*(c.to_pylist() for c in batch.columns)):
                        yield group, part, number, value, merged, Run(*run), None

            yield from pass_over(items(), last)

        found = cut(rest.repartition("group").sortWithinPartitions("group", "part", "block", "at").mapInArrow(further, BOTH))
        nodes.append(found.filter("depth is not null"))
    all_nodes = nodes[0]
    for more in nodes[1:]:
        all_nodes = all_nodes.unionByName(more)
    return all_nodes.select(*(f.split()[0] for f in NODE.split(", ")))


def ends(sequences: DataFrame) -> DataFrame:
    """``of_key, ends_sha256``: of each distinct sequence the digest of its conversations' ids in order.

    Tasks join neighbouring ids to long strings first, wherever a group is cut; one task then hashes a group's strings as they come.
    """
    ordered = sequences.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def join(batches):
        key, first, ids, size, out = None, None, [], 0, []
        for batch in batches:
            for k, c in zip(*(x.to_pylist() for x in batch.columns)):
                if k != key or size > CHUNK:
                    if ids:
                        out.append((key, first, ",".join(ids).encode()))
                    key, first, ids, size = k, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield _batch(out, "key binary, first long, ids binary")
                out = []
        if ids:
            yield _batch([(key, first, ",".join(ids).encode())], "key binary, first long, ids binary")

    joined = ordered.mapInArrow(join, "key binary, first long, ids binary")

    def digest(batches):
        key, hashed, out = None, None, []
        row = lambda: (key, hashed.hexdigest())
        names, kinds = ["of_key", "ends_sha256"], [pa.binary(), pa.string()]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == key:
                    hashed.update(b"," + ids)
                    continue
                if key is not None:
                    out.append(row())
                key, hashed = k, hashlib.sha256(ids)
            if out:
                yield give(out)
                out = []
        if key is not None:
            yield give([row()])

    return joined.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(digest, "of_key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: a row for each node.

    Turns are ordered by ``turn`` (null first), role and text; a null role or text is
    empty. A conversation is rebuilt from the first h turns of the first of its five
    and its own after its first h, h by the crc of its id. Rows without a conversation
    are in none. Repeated rows are turns of their own. Turns are equal when role and
    text are, by 128 bits of their digest. Conversations that no turn is left of end at
    the root. Texts of any length travel as tokens of 24 bytes; a conversation's tokens
    are one value. Other columns are not looked at. No conversations: no rows, not even the root.
    """
    sequences = cut(rebuilt(turns))
    nodes = cut(trie_nodes(sorted_classes(sequences), block, fan))
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("of"), F.col("conv_id").alias("parent"))
    below = nodes.filter("parent_key is not null").join(parents, F.col("parent_key") == F.col("of")).withColumn("parent_conv_id", F.col("parent")).drop("of", "parent")
    named = nodes.filter("parent_key is null").unionByName(below)
    met = named.join(ends(sequences), F.col("key") == F.col("of_key"), "left")
    return met.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token, strlen(coalesce(text, '')) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base,
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % {MOST_HEAD} AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS side, place, token, bytes FROM c JOIN t ON t.conv_id = base AND place < h
  UNION ALL SELECT c.conv_id, 1, place, token, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND place >= h
), s AS (
  SELECT c.conv_id, list(token ORDER BY side, place) FILTER (WHERE token IS NOT NULL) AS seq, list(bytes ORDER BY side, place) FILTER (WHERE token IS NOT NULL) AS sizes
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
), m AS (
  SELECT conv_id, d, coalesce(len(seq), 0) AS n, sha256(coalesce(array_to_string(seq[1:d], ','), '')) AS key, coalesce(sizes[d], 0) AS bytes,
         CASE WHEN d > 0 THEN sha256(coalesce(array_to_string(seq[1:d - 1], ','), '')) END AS above
  FROM (SELECT *, unnest(range(coalesce(len(seq), 0) + 1)) AS d FROM s)
), v AS (
  SELECT key, d, any_value(above) AS above, any_value(bytes) AS bytes, min(conv_id) AS least, count(*) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE m.n = d), '')) AS ends_sha256
  FROM m GROUP BY key, d
), k AS (SELECT above, count(*) AS children FROM v GROUP BY above
), below AS (
  SELECT m.key, sum((v.n - 1) * v.bytes) AS saved, count(*) FILTER (WHERE k.children IS NULL) AS leaves
  FROM v JOIN m ON m.conv_id = v.least AND m.d <= v.d LEFT JOIN k ON k.above = v.key GROUP BY m.key
)
SELECT v.least AS conv_id, CAST(v.d AS BIGINT) AS depth, p.least AS parent_conv_id, v.n AS n_convs, coalesce(k.children, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN below USING (key) LEFT JOIN v p ON p.key = v.above LEFT JOIN k ON k.above = v.key
"""
