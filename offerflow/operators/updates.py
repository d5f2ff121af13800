"""The state of a site's update, from the log of what happened to it.

An event moves a site from the state it is in. Whatever that was, a row of events in order is a table of six
moves, one for each state it may begin in, and two such tables in a row are one again. So a log is folded in
parts, by ranges of its order, and the parts of a site are put together level by level: a site that has a third of all events is many parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("absent", "initializing", "parsing", "extracting", "finished", "error")
#: By event: the states that it may meet, and where it leads. A site that is there already is not added again.
MOVES = {
    "add": {"absent": "initializing", **{s: s for s in STATES[1:]}},
    "start": {"initializing": "parsing"},
    "parsed": {"parsing": "extracting"},
    "saved": {"extracting": "extracting"},
    "done": {"extracting": "finished"},
    "failed": {s: "error" for s in ("initializing", "parsing", "extracting")},
    "reset": {s: "absent" for s in STATES},
}
#: Events of a part, and parts that are put together at a level.
STEP, LEVELS = 1024, 2
#: Ranges of an order whose events are counted at once.
RANGES = 4096

MOVE = "struct<state int, events bigint, illegal bigint, first struct<ord bigint, event string, state int>, error string, data string, says boolean, keeps boolean>"


def _table(of) -> Column:
    return F.create_map(*[x for e in MOVES for x in (F.lit(e), F.array(*[F.lit(of(e, s)) for s in STATES]))])


def _start() -> Column:
    """The table of no events: each state stays."""
    still = lambda s: F.struct(F.lit(s).alias("state"), F.lit(0).cast("long").alias("events"), F.lit(0).cast("long").alias("illegal"), F.lit(None).cast("struct<ord bigint, event string, state int>").alias("first"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("data"), F.lit(False).alias("says"), F.lit(False).alias("keeps"))
    return F.array(*map(still, range(len(STATES)))).cast(f"array<{MOVE}>")


def _then(a: Column, b: Column) -> Column:
    """Move ``b`` after move ``a``."""
    return F.struct(
        b["state"].alias("state"), (a["events"] + b["events"]).alias("events"), (a["illegal"] + b["illegal"]).alias("illegal"), F.coalesce(a["first"], b["first"]).alias("first"),
        F.when(b["says"], b["error"]).otherwise(a["error"]).alias("error"), F.when(b["keeps"], b["data"]).otherwise(a["data"]).alias("data"), (a["says"] | b["says"]).alias("says"), (a["keeps"] | b["keeps"]).alias("keeps"),
    ).cast(MOVE)


def _event(a: Column, e: Column) -> Column:
    """One event after move ``a``. What is illegal changes nothing but is counted; the first is kept with the state it met."""
    to = _table(lambda event, s: STATES.index(MOVES[event].get(s, "absent")))[e["event"]][a["state"]]
    legal = F.coalesce(_table(lambda event, s: s in MOVES[event])[e["event"]][a["state"]], F.lit(False))
    wrong = F.struct(e["ord"].alias("ord"), e["event"].alias("event"), a["state"].alias("state"))
    saves, clears = legal & (e["event"] == "saved"), legal & (e["event"] == "reset")
    says = legal & (e["event"] != "add")
    return F.struct(
        F.when(legal, to).otherwise(a["state"]).alias("state"), (a["events"] + 1).alias("events"), (a["illegal"] + F.when(legal, 0).otherwise(1)).alias("illegal"), F.coalesce(a["first"], F.when(~legal, wrong)).alias("first"),
        F.when(says, F.when(e["event"] == "failed", e["said"])).otherwise(a["error"]).alias("error"), F.when(saves, e["said"]).when(clears, None).otherwise(a["data"]).alias("data"), (a["says"] | says).alias("says"), (a["keeps"] | saves | clears).alias("keeps"),
    ).cast(MOVE)


def moves(events: DataFrame, site: str = "siteid", step: int = STEP, levels: int = LEVELS) -> DataFrame:
    """``site, moves``: where each site's events lead, for each state that it may have had before them. ``events(site, ord, event, said)``

    Events are ordered by ``ord``, then name and text. Unknown and null events are illegal.
    """
    rows = events.select(site, F.col("ord").cast("long").alias("ord"), F.coalesce("event", F.lit("")).alias("event"), "said", F.floor(F.col("ord") / step).alias("part"))
    listed = rows.groupBy(site, "part").agg(F.sort_array(F.collect_list(F.struct("ord", "event", "said"))).alias("list"))
    found = listed.select(site, "part", F.aggregate("list", _start(), lambda acc, e: F.transform(acc, lambda a: _event(a, e))).alias("moves"))
    for level in range(levels, 0, -1):
        up = F.floor(F.col("part") / step) if level > 1 else F.lit(0).cast("long")
        listed = found.groupBy(site, up.alias("up")).agg(F.sort_array(F.collect_list(F.struct("part", "moves"))).alias("list"))
        found = listed.select(site, F.col("up").alias("part"), F.aggregate("list", _start(), lambda acc, m: F.transform(acc, lambda a: _then(a, m["moves"][a["state"]]))).alias("moves"))
    return found.select(site, "moves")


def advance(states: DataFrame | None, events: DataFrame, site: str = "siteid", step: int = STEP) -> DataFrame:
    """``site, state, error, data, events, illegal, first_illegal``: the states after the events, begun from the stored ``states`` of the same columns, or from nothing.

    ``error`` is what the last failure said until the site moves on, ``data`` what was saved last until a reset, and
    ``first_illegal`` the first event that the site's state did not allow, as ``event in state``. A null site is a site of its own.
    """
    after = moves(events, site, step)
    number = F.create_map(*[x for k, s in enumerate(STATES) for x in (F.lit(s), F.lit(k))])
    name = F.array(*map(F.lit, STATES))
    if states is None:
        met = after.withColumns({"_state": F.lit(0), "_events": F.lit(0), "_illegal": F.lit(0), "_first": F.lit(None).cast("string"), "_error": F.lit(None).cast("string"), "_data": F.lit(None).cast("string")})
    else:
        stored = states.select(F.col(site).alias("_site"), number[F.col("state")].alias("_state"), F.col("events").alias("_events"), F.col("illegal").alias("_illegal"), F.col("first_illegal").alias("_first"), F.col("error").alias("_error"), F.col("data").alias("_data"))
        met = stored.join(after, F.col("_site").eqNullSafe(F.col(site)), "full").withColumn(site, F.coalesce(site, "_site")).drop("_site")
    m = F.coalesce(F.col("moves"), _start())[F.coalesce("_state", F.lit(0))]
    wrong = F.concat(m["first"]["event"], F.lit(" in "), name[m["first"]["state"]])
    return met.select(
        site, name[m["state"]].alias("state"), F.when(m["says"], m["error"]).otherwise(F.col("_error")).alias("error"), F.when(m["keeps"], m["data"]).otherwise(F.col("_data")).alias("data"),
        (F.coalesce("_events", F.lit(0)) + m["events"]).alias("events"), (F.coalesce("_illegal", F.lit(0)) + m["illegal"]).alias("illegal"), F.coalesce("_first", wrong).alias("first_illegal"),
    )


def halfway(events: DataFrame, order: str = "ord") -> int | None:
    """The least ``order``, a whole number, up to which half of the events lie at least; None if there are none.

    Events are counted by ranges of it, then within the range that holds the half, so that no task holds all values.
    """
    low, high, n = events.agg(F.min(order), F.max(order), F.count(order)).first()
    if not n:
        return None
    wanted = (n + 1) // 2
    while low < high:
        width = (high - low) // RANGES + 1
        inside = events.filter(F.col(order).between(low, high)).groupBy(F.expr(f"({order} - {low}L) div {width}L").alias("k")).count()
        for k, count in sorted(inside.collect()):  # RANGES rows at most
            if wanted <= count:
                break
            wanted -= count
        low, high = low + k * width, min(high, low + (k + 1) * width - 1)
    return low


def running(states: DataFrame) -> DataFrame:
    """Sites whose update is to be taken up again."""
    return states.filter(F.col("state").isin("initializing", "parsing", "extracting"))
