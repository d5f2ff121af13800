"""The entity tables as views of the star schema, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as offers: the nation is the city, the brand the site, line items give units, discount and times."""
    sold = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("sd"),
        F.min("l_shipdate").alias("starttime"), F.max("l_shipdate").alias("duetime"),
    )
    nation = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    part = read(spark, sf_dir, "part").join(nation, F.col("p_partkey") % 25 == F.col("n_nationkey"))
    rows = part.join(sold, F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.withColumn("d100", F.floor((F.lit(1000.0) * F.col("n") - F.lit(10.0) * F.col("sd")) / F.col("n"))).withColumn("cents", F.round(F.col("p_retailprice") * 100).cast("long"))
    cut = F.floor(F.col("cents") * F.col("d100") / F.lit(1000.0))
    return rows.select(
        F.concat(F.lit("http://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".example.com/deal/"), F.col("p_partkey").cast("string"), F.lit(".html?frm=feed")).alias("url"),
        F.col("p_brand").alias("siteid"), F.col("p_name").alias("title"), F.col("n_name").alias("city"), F.lower("n_name").alias("cityid"),
        F.col("p_retailprice").alias("original"), F.col("q").alias("bought"), (F.col("d100") / F.lit(100.0)).alias("discount"), (cut / F.lit(100.0)).alias("current"),
        ((F.col("cents") - cut) / F.lit(100.0)).alias("saved"), "starttime", "duetime", F.col("p_partkey").alias("ord"),
    )


OFFERS = """
WITH sold AS (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS n, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS sd,
  min(l_shipdate) AS starttime, max(l_shipdate) AS duetime FROM lineitem GROUP BY l_partkey),
base AS (SELECT *, CAST(floor((1000::DOUBLE * n - 10::DOUBLE * sd) / n) AS BIGINT) AS d100, CAST(round(p_retailprice * 100) AS BIGINT) AS cents
  FROM part JOIN nation ON p_partkey % 25 = n_nationkey JOIN sold ON l_partkey = p_partkey),
offers AS (SELECT 'http://' || lower(replace(p_brand, '#', '')) || '.example.com/deal/' || p_partkey || '.html?frm=feed' AS url, p_brand AS siteid, p_name AS title,
  n_name AS city, lower(n_name) AS cityid, p_retailprice AS original, q AS bought, d100 / 100::DOUBLE AS discount, floor(cents * d100 / 1000::DOUBLE) / 100 AS "current",
  (cents - floor(cents * d100 / 1000::DOUBLE)) / 100 AS saved, starttime, duetime, p_partkey AS ord FROM base)
"""


def stored(spark, sf_dir):
    """A stored snapshot: the offers that sold less than 900, some with other values; every seventh without an address."""
    rows = offers(spark, sf_dir).filter("bought < 900")
    return rows.withColumn("bought", F.col("bought") - F.when(F.col("ord") % 2 == 0, 1).otherwise(0)).withColumn("address", F.when(F.col("ord") % 7 != 0, F.concat(F.lit("Road "), F.col("ord").cast("string")))).withColumn("geoinfo", F.lit("12.5,45.25"))


def feed(spark, sf_dir):
    """The offers that sold more than 600, so that every offer is here or stored, and most are both."""
    return offers(spark, sf_dir).filter("bought > 600")


SNAPSHOTS = OFFERS + """, stored AS (SELECT * REPLACE (bought - CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END AS bought), CASE WHEN ord % 7 <> 0 THEN 'Road ' || ord END AS address, '12.5,45.25' AS geoinfo
  FROM offers WHERE bought < 900),
feed AS (SELECT * FROM offers WHERE bought > 600)
"""


def servers(spark, sf_dir):
    """Suppliers as servers; each of the first 20 nations is a task of one or two of them. The first has most tasks and most load."""
    s = read(spark, sf_dir, "supplier")
    tasks = read(spark, sf_dir, "nation").filter("n_nationkey < 20").select("n_name", "n_nationkey")
    held = s.select("s_suppkey").join(F.broadcast(tasks), (F.col("s_suppkey") % 10 == F.col("n_nationkey") % 10) & (F.col("s_suppkey") <= 10) | (F.col("s_suppkey") == 1) & F.col("n_nationkey").isin(3, 4, 5))
    lists = held.groupBy("s_suppkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ";").alias("sites"))
    cents = F.abs(F.floor(F.col("s_acctbal"))).cast("long")
    return s.join(lists, "s_suppkey", "left").select(
        F.concat(F.lit("server"), F.col("s_suppkey").cast("string")).alias("address"), F.when(F.col("s_suppkey") % 4 == 0, "user").otherwise("extractor").alias("servertype"), F.coalesce("sites", F.lit("")).alias("sites"),
        F.when(F.col("s_suppkey") == 1, 45).otherwise(cents % 43).cast("double").alias("cpu_usage"), (cents % 41).cast("double").alias("outgoing_bandwidth"), (cents % 37).cast("double").alias("incomming_bandwidth"), (cents % 31).cast("double").alias("datastore"), F.lit(0.0).alias("email"),
    )


SERVERS = """
WITH tasks AS (SELECT n_name, n_nationkey FROM nation WHERE n_nationkey < 20),
held AS (SELECT s_suppkey, n_name FROM supplier JOIN tasks ON (s_suppkey % 10 = n_nationkey % 10 AND s_suppkey <= 10) OR (s_suppkey = 1 AND n_nationkey IN (3, 4, 5))),
lists AS (SELECT s_suppkey, string_agg(n_name, ';' ORDER BY n_name) AS sites, count(*) AS n_tasks FROM held GROUP BY s_suppkey),
c AS (SELECT *, CAST(abs(floor(s_acctbal)) AS BIGINT) AS cents FROM supplier LEFT JOIN lists USING (s_suppkey)),
loaded AS (SELECT 'server' || s_suppkey AS address, CASE WHEN s_suppkey % 4 = 0 THEN 'user' ELSE 'extractor' END AS servertype, coalesce(sites, '') AS sites, coalesce(n_tasks, 0) AS n_tasks,
  CAST(greatest(0, CASE WHEN s_suppkey = 1 THEN 45 ELSE cents % 43 END, cents % 41, cents % 37, cents % 31) AS DOUBLE) AS load FROM c),
held2 AS (SELECT 'server' || s_suppkey AS address, n_name AS site FROM held),
expected AS (SELECT n_name AS site, n_nationkey AS ord FROM nation)
"""


def site_times(spark, sf_dir):
    """Nations as sites, with the first and last time of events of users of that number; null where there are none."""
    times = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 30).cast("int").alias("k")).agg(F.min("ts").alias("lastupdate"), F.max("ts").alias("enqueuetime"))
    return read(spark, sf_dir, "nation").join(times, F.col("n_nationkey") == F.col("k"), "left").select(F.col("n_name").alias("siteid"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("server"), (F.col("n_nationkey") % 4).cast("string"))).alias("updateserver"), F.when(F.col("n_nationkey") % 5 != 0, F.col("lastupdate")).alias("lastupdate"), "enqueuetime")


SITES = """
WITH times AS (SELECT CAST(user_id % 30 AS INTEGER) AS k, min(ts) AS lastupdate, max(ts) AS enqueuetime FROM events GROUP BY 1),
sites AS (SELECT n_name AS siteid, CASE WHEN n_nationkey % 3 <> 0 THEN 'server' || (n_nationkey % 4) END AS updateserver, CASE WHEN n_nationkey % 5 <> 0 THEN lastupdate END AS lastupdate, enqueuetime
  FROM nation LEFT JOIN times ON n_nationkey = k)
"""


def cities(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.lower("n_name").alias("cityid"), F.col("n_name").alias("name"))
