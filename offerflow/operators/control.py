"""Control decisions over servers, tasks and sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_list

# Quota columns that make a load; default load for a site; alert level; gaps that justify a move; guards in seconds.
QUOTAS = ("cpu_usage", "outgoing_bandwidth", "incomming_bandwidth", "datastore")
DEFAULT_SITE_LOAD, BUSY, LOAD_GAP, TASK_GAP, MOST_TASKS = 3.0, 50.0, 20.0, 2, 500
ENQUEUE_GUARD, LEASE = 1200, 600


def with_load(servers: DataFrame) -> DataFrame:
    """``load``, the largest of the quotas and 0, and the list of tasks."""
    tasks = decode_list(F.coalesce("sites", F.lit("")))
    return servers.withColumn("load", F.greatest(F.lit(0.0), *QUOTAS)).withColumn("tasks", tasks).withColumn("n_tasks", F.size("tasks").cast("long"))


def load_per_site(loaded: DataFrame) -> DataFrame:
    total, sites = F.sum("load"), F.sum("n_tasks")
    return loaded.agg(total.alias("total_load"), sites.alias("total_sites"), F.when((sites > 0) & (total > 10), total / sites).otherwise(DEFAULT_SITE_LOAD).alias("per_site"))


def _first(df: DataFrame, *orders) -> DataFrame:
    return df.orderBy(*orders).limit(1)


def missing_task(expected: DataFrame, loaded: DataFrame) -> DataFrame:
    """The first expected site (``site, ord``) that no server has."""
    held = loaded.select(F.explode("tasks").alias("site")).distinct()
    return _first(expected.join(held, "site", "left_anti"), "ord").select("site")


def duplicate_tasks(loaded: DataFrame) -> DataFrame:
    """Tasks that several servers have; the busier one is to let go."""
    held = loaded.select("address", "load", F.explode("tasks").alias("site"))
    return held.groupBy("site").agg(F.count("*").alias("n"), F.max_by("address", F.struct("load", "address")).alias("address")).filter("n > 1")


def free_server(loaded: DataFrame) -> DataFrame:
    """The server with the fewest tasks, if it is not busy."""
    return _first(loaded.filter(F.col("n_tasks") < MOST_TASKS), "n_tasks", "address").filter(F.col("load") < BUSY)


def busiest_server(loaded: DataFrame) -> DataFrame:
    return _first(loaded, F.desc("load"), "address")


def rebalance_candidate(loaded: DataFrame) -> DataFrame:
    """A server that could take a task from the busiest one: much less load and fewer tasks."""
    top = busiest_server(loaded).select(F.col("load").alias("top_load"), F.col("n_tasks").alias("top_tasks"), F.col("address").alias("top"), F.array_min("tasks").alias("site"))
    fits = (F.col("load") + LOAD_GAP < F.col("top_load")) & (F.col("n_tasks") + TASK_GAP < F.col("top_tasks"))
    return _first(loaded.join(F.broadcast(top), fits), "address").select("address", "top", "site")  # ``top`` is one row


def balance_decision(expected: DataFrame, loaded: DataFrame) -> DataFrame:
    """At most one ``action, server, site``: add a missing task to a free server; else remove a duplicate; else move one."""
    add = missing_task(expected, loaded).crossJoin(free_server(loaded).select("address"))  # one row each
    steps = [
        add.select(F.lit(1).alias("rank"), F.lit("add").alias("action"), F.col("address").alias("server"), "site"),
        _first(duplicate_tasks(loaded), "site").select(F.lit(2).alias("rank"), F.lit("remove").alias("action"), F.col("address").alias("server"), "site"),
        rebalance_candidate(loaded).filter(F.col("site").isNotNull()).select(F.lit(3).alias("rank"), F.lit("remove").alias("action"), F.col("top").alias("server"), "site"),
    ]
    return _first(steps[0].unionByName(steps[1]).unionByName(steps[2]), "rank").select("action", "server", "site")


def admit(now: Column) -> Column:
    """Whether a site enters the queue: not if it waits there and its last update is recent."""
    waits = (F.col("enqueuetime") > F.col("lastupdate")) & (F.unix_timestamp(now) - F.unix_timestamp("lastupdate") < ENQUEUE_GUARD)
    return ~F.coalesce(waits, F.lit(False))


def enqueue(sites: DataFrame, now: Column) -> DataFrame:
    """The sites with the time at which admitted ones enter the queue."""
    return sites.withColumn("enqueuetime", F.when(admit(now), now).otherwise(F.col("enqueuetime")))


def complete(sites: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The sites after jobs (``siteid, error``): a success stamps the time, a failure its error."""
    done = results.select("siteid", F.col("error").alias("_error"), F.lit(True).alias("_ran"))
    met = sites.join(done, "siteid", "left")
    stamped = met.withColumn("lastupdate", F.when(F.col("_ran") & F.col("_error").isNull(), now).otherwise(F.col("lastupdate")))
    return stamped.withColumn("error", F.when(F.col("_ran"), F.col("_error")).otherwise(F.col("error"))).drop("_error", "_ran")


def lease_free(now: Column) -> Column:
    """Whether a running job may be taken over."""
    return F.col("owner").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("leased") > LEASE)


def merge_report(sites: DataFrame, report: DataFrame, server: str) -> DataFrame:
    """``siteid, action``: reported sites are taken unless another server owns them; owned ones that the report lacks are obsolete."""
    owned = sites.select("siteid", F.col("updateserver").alias("owner"))
    both = owned.join(report.select("siteid", F.lit(True).alias("reported")), "siteid", "full_outer")
    other = F.col("owner").isNotNull() & (F.col("owner") != server)
    action = F.when(F.col("reported") & other, "conflict").when(F.col("reported"), "update").when(F.col("owner") == server, "obsolete")
    return both.select("siteid", action.alias("action")).filter("action is not null")


def sync_work(sites: DataFrame, servers: DataFrame) -> DataFrame:
    """Each site with each front-end server: the pairs to replicate. The product is the result itself."""
    return sites.select("siteid", "updateserver").join(servers.filter("servertype = 'user'").select("address"), F.lit(True))


def status_report(servers: DataFrame, sites: DataFrame) -> DataFrame:
    """What servers report of themselves: all columns of each of their sites, with the server's kind and quota loads.

    ``servers(address, servertype, ...quotas)``, ``sites(address, siteid, ...)``. A server without sites reports one row of loads, whose
    site is null; sites of unknown servers report nothing, and a load that was not measured is 0.
    """
    loads = [F.coalesce(F.col(q), F.lit(0.0)).alias(q) for q in QUOTAS]
    return servers.select("address", "servertype", *loads).join(sites, "address", "left")
