"""Chat formatting: multi-party perspective rotation, in DataFrame functions alone.

For every participant of a conversation the dialogue is rendered once, with that
speaker as the assistant and the others as named users; the mask covers what the
assistant says. A dialogue is one row for each participant, as long as it may be; only
where ``most_turns`` is given does a longer one go on in further rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What would look like a mark in a name, and what stands for it; the first is what the others begin with.
ESCAPES = (("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"), ("\r", "%0D"), ("\n", "%0A"))
#: Turn numbers whose turns are numbered together.
STEP = 64
UNNAMED = "unknown"


def places(rows: DataFrame) -> DataFrame:
    """``rows`` with the place of each turn in its conversation, from 0.

    Turns are counted by steps of turn numbers first and numbered within a step, so
    that a conversation with a third of all turns is not one task.
    """
    rows = rows.withColumn("step", F.floor(F.col("turn") / STEP))
    sizes = rows.groupBy(F.col("conv_id").alias("of"), F.col("step").alias("of_step")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("of").orderBy("of_step").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("of", "of_step", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    within = F.row_number().over(Window.partitionBy("conv_id", "step").orderBy("turn", "role", "text")) - 1
    met = rows.withColumn("within", within).join(sizes, F.col("conv_id").eqNullSafe(F.col("of")) & F.col("step").eqNullSafe(F.col("of_step")))
    return met.withColumn("place", F.col("above") + F.col("within")).drop("of", "of_step", "above", "within", "step")


def label(name: Column) -> Column:
    """A name as it stands in a mark; different names stay different."""
    for plain, escaped in ESCAPES:
        name = F.replace(name, F.lit(plain), F.lit(escaped))
    return name


def rotate_perspectives(turns: DataFrame, most_turns: int | None = None) -> DataFrame:
    """``conv_id, part, perspective, n_turns, n_targets, text, mask``.

    ``text`` has a line ``<|assistant|>`` or ``<|user:NAME|>``, the words and
    ``<|end|>`` for each turn; ``mask`` has ``start:end`` character places in
    ``text`` of the assistant's words with their end mark, joined by commas.
    ``<|`` in words becomes ``<||``, and ``|``, ``<``, ``>``, ``%`` and line ends in names
    are written as ``%`` and two hexadecimal digits, so that nothing said looks like a mark and no
    two names get one label. Participants are all of the conversation. ``part`` is 0; with
    ``most_turns`` it counts the rows of a dialogue, each of so many turns, and one in which a
    participant is silent has an empty mask. Rows of one turn number are
    ordered by role and text and repeated rows stay. A null role is ``unknown``, a null text
    empty, a null conversation a conversation of its own; a null turn sorts
    first. No turns: no rows.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(UNNAMED)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = places(rows).withColumn("part", F.floor(F.col("place") / most_turns).cast("long") if most_turns else F.lit(0).cast("long"))
    said = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "role", F.replace("text", F.lit("<|"), F.lit("<||")).alias("text")))).alias("said"))
    speakers = rows.select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    both = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    own = lambda t: t["role"] == F.col("perspective")
    head = lambda t: F.when(own(t), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), label(t["role"]), F.lit("|>\n")))
    tail = lambda t: F.concat(t["text"], F.lit("<|end|>"))
    pieces = F.transform("said", lambda t: F.struct(head(t).alias("head"), tail(t).alias("tail"), own(t).alias("own")))
    length = lambda p: F.char_length(p["head"]) + F.char_length(p["tail"]) + 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    span = lambda s, p: F.concat_ws(":", s["at"] + F.char_length(p["head"]), s["at"] + length(p) - 1)
    step = lambda s, p: F.struct((s["at"] + length(p)).alias("at"), F.when(p["own"], F.concat(s["spans"], F.array(span(s, p)))).otherwise(s["spans"]).alias("spans"))
    both = both.withColumn("pieces", pieces)
    return both.select(
        "conv_id", "part", "perspective",
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_targets"),
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["tail"])), "\n"), F.lit("\n")).alias("text"),
        F.aggregate("pieces", start, step, lambda s: F.array_join(s["spans"], ",")).alias("mask"),
    )


_LABEL = "role"
for _plain, _escaped in ESCAPES:
    _LABEL = f"replace({_LABEL}, chr({ord(_plain)}), '{_escaped}')"

ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '{UNNAMED}') AS role, coalesce(text, '') AS text FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS number FROM t
), s AS (SELECT DISTINCT conv_id AS of_conv, role AS perspective FROM t
), p AS (
  SELECT conv_id, 0 AS part, number, perspective, role = perspective AS own,
         CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user:' || {_LABEL} || '|>' || chr(10) END AS head,
         replace(text, '<|', '<||') || '<|end|>' AS tail
  FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.of_conv
), q AS (
  SELECT *, coalesce(sum(length(head) + length(tail) + 1) OVER (PARTITION BY conv_id, part, perspective ORDER BY number
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p
)
SELECT conv_id, CAST(part AS BIGINT) AS part, perspective, count(*) AS n_turns,
       CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_targets,
       string_agg(head || tail || chr(10), '' ORDER BY number) AS text,
       coalesce(string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(head) + length(tail) AS BIGINT) AS VARCHAR), ',' ORDER BY number) FILTER (WHERE own), '') AS mask
FROM q GROUP BY conv_id, part, perspective
"""
