"""The driver's tables read as the domain's: visits, catalogs, predictions, raw strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Split bounds of the short (A) and the catalog-scale (B) visits.
A_TRAIN, A_VALID = "2024-01-20 23:59:59", "2024-01-25 23:59:59"
B_TRAIN, B_VALID = "1999-12-31 00:00:00", "2000-12-31 00:00:00"

A_SQL = "SELECT CAST(user_id AS VARCHAR) AS u, event_type AS p, CAST(ts AS TIMESTAMP) AS t FROM events"
B_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS u, CAST(l_suppkey AS VARCHAR) AS p, CAST(l_shipdate AS TIMESTAMP) AS t, r_name AS l1, n_name AS l2,
 round(-60 + ((l_suppkey * 37) % 1200) / CAST(10 AS DOUBLE) + ((l_linenumber % 3) - 1) * CAST(0.01 AS DOUBLE), 4) AS lat,
 round(-180 + ((l_suppkey * 101) % 3600) / CAST(10 AS DOUBLE), 4) AS lon
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON n_nationkey = (s_nationkey + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 25 JOIN region ON r_regionkey = n_regionkey"""
R_SQL = """SELECT event_id,
 CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 7 = 0 THEN '  ' || user_id || chr(9) ELSE CAST(user_id AS VARCHAR) END AS user_id,
 CASE WHEN event_id % 7 = 1 THEN chr(9) || event_type || ' ' ELSE event_type END AS poiid,
 CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '+08:00'
 WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '-0330' ELSE 'junk' END AS log_time,
 CASE event_id % 4 WHEN 0 THEN '31.5' WHEN 1 THEN '95' WHEN 2 THEN 'abc' ELSE '-12.25' END AS latitude,
 CASE event_id % 3 WHEN 0 THEN '121.5' WHEN 1 THEN 'NaN' ELSE '-180' END AS longitude,
 CASE event_id % 5 WHEN 0 THEN 'a;b;c' WHEN 1 THEN 'a;b' WHEN 2 THEN '|a;b;c' WHEN 3 THEN 'a;;c' ELSE 'a;b;c|d;e;f' END AS new_key_type
 FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _views(spark: SparkSession, sf_dir: str, names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names.split()}


def visits_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("u"), F.col("event_type").alias("p"), F.col("ts").cast("timestamp_ntz").alias("t"))


def visits_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = B_SQL.replace("VARCHAR", "STRING").replace("AS TIMESTAMP", "AS TIMESTAMP_NTZ")
    for name in ("lineitem", "orders", "supplier", "nation", "region"):
        sql = sql.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} {name} ")
    return spark.sql(sql, **_views(spark, sf_dir, "lineitem orders supplier nation region"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    at = lambda fmt: F.date_format("ts", fmt)
    pick = lambda n, *values: F.coalesce(*[F.when(e % n == i, v) for i, v in enumerate(values)])
    lit = F.lit
    plain = at("yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 97 == 0, "").when(e % 7 == 0, F.concat(lit("  "), F.col("user_id").cast("string"), lit("\t"))).otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(e % 7 == 1, F.concat(lit("\t"), "event_type", lit(" "))).otherwise(F.col("event_type")).alias("poiid"),
        pick(5, plain, at("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(plain, lit("+08:00")), F.concat(plain, lit("-0330")), lit("junk")).alias("log_time"),
        pick(4, lit("31.5"), lit("95"), lit("abc"), lit("-12.25")).alias("latitude"),
        pick(3, lit("121.5"), lit("NaN"), lit("-180")).alias("longitude"),
        pick(5, lit("a;b;c"), lit("a;b"), lit("|a;b;c"), lit("a;;c"), lit("a;b;c|d;e;f")).alias("new_key_type"),
    )


def covisit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return bought.where(F.col("l_shipdate") <= F.expr("timestamp_ntz'1999-12-31'")).select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i")).distinct()


C_SQL = "SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate <= TIMESTAMP '1999-12-31'"
C_PLACES = "SELECT p_partkey AS i, 31 + (p_partkey % 50) * CAST(0.01 AS DOUBLE) AS lat, 121 + ((p_partkey // 50) % 50) * CAST(0.01 AS DOUBLE) AS lon FROM part"


def covisit_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("i"), (31 + (k % 50) * 0.01).alias("lat"), (121 + (F.floor(k / 50) % 50) * 0.01).alias("lon"))
