"""Views of the driver's tables in the shapes that the operators read: ledgers, runs, feed logs, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as statements, one per customer: signed amounts, a running balance with gaps, hidden amounts, broken rows."""
    orders = table(spark, sf_dir, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    amount = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    rows = orders.select(
        F.col("o_custkey").cast("string").alias("statement_id"), F.row_number().over(order).alias("row_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), amount.alias("full"), "o_orderkey",
        F.sum(amount.cast("decimal(38,6)")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("running"),
    )
    broken = F.when(F.col("o_orderkey") % 97 == 0, F.col("running") + 5).otherwise(F.col("running"))
    return rows.select(
        "statement_id", "row_id", "date", F.when(F.col("o_orderkey") % 53 != 0, F.col("full")).alias("amount"), F.when(F.col("o_orderkey") % 7 != 0, broken).alias("balance"),
        F.when(F.col("o_orderkey") % 53 == 0, "redacted").when(F.col("o_orderkey") % 211 == 0, "malformed").otherwise("").alias("flags"), "o_orderkey",
    )


LEDGER = """
ledger0 AS (SELECT CAST(o_custkey AS VARCHAR) AS statement_id, CAST(row_number() OVER w AS INTEGER) AS row_id, strftime(o_orderdate, '%Y-%m-%d') AS date,
  CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS "full", o_orderkey,
  CAST(sum(CAST(CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(38,6))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
ledger AS (SELECT statement_id, row_id, date, CASE WHEN o_orderkey % 53 <> 0 THEN "full" END AS amount,
  CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 97 = 0 THEN running + 5 ELSE running END END AS balance,
  CASE WHEN o_orderkey % 53 = 0 THEN 'redacted' WHEN o_orderkey % 211 = 0 THEN 'malformed' ELSE '' END AS flags, o_orderkey FROM ledger0)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run records."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), k.cast("string").alias("run_id"),
        F.when(k % 10 < 6, "ok").when(k % 10 < 8, "needs_review").when(k % 10 == 8, "unsupported").otherwise("failed").alias("status"),
        F.when(k % 13 != 0, F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string"))).alias("detected_template"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("closest_template"),
        F.concat(F.lit("missing "), F.col("event_type")).alias("detect_detail"), F.concat(F.lit("L"), (F.col("user_id") % 17).cast("string")).alias("layout_signature"), F.col("event_type").alias("layout_hint"),
        F.concat(F.lit("f"), k.cast("string"), F.lit(".csv")).alias("source_file"), F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "medium").otherwise("high").alias("trust_level"), (k % 4 == 3).cast("int").alias("kpi_fail_count"),
        F.col("user_id").alias("user_id"), F.col("value").alias("value"),
    )


RUNS = """
runs AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CAST(event_id AS VARCHAR) AS run_id,
  CASE WHEN event_id % 10 < 6 THEN 'ok' WHEN event_id % 10 < 8 THEN 'needs_review' WHEN event_id % 10 = 8 THEN 'unsupported' ELSE 'failed' END AS status,
  CASE WHEN event_id % 13 <> 0 THEN 't' || CAST(user_id % 40 AS VARCHAR) END AS detected_template, 'c' || CAST(event_id % 5 AS VARCHAR) AS closest_template,
  'missing ' || event_type AS detect_detail, 'L' || CAST(user_id % 17 AS VARCHAR) AS layout_signature, event_type AS layout_hint,
  'f' || CAST(event_id AS VARCHAR) || '.csv' AS source_file, CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' ELSE 'high' END AS trust_level,
  CAST(event_id % 4 = 3 AS INTEGER) AS kpi_fail_count, user_id, value FROM events)"""


def feed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    k = F.col("run_id").cast("long")
    gate = F.when(k % 9 == 0, None).when(F.col("status") != "ok", F.concat(F.lit("withheld:"), F.col("status"))).when(F.col("trust_level") == "low", "withheld:low_trust").when(k % 29 == 0, "accepted:write_failed").otherwise("accepted")
    return r.select("ts", "run_id", "source_file", gate.alias("gate_result"), (gate == "accepted").alias("feed_written"), F.concat(F.lit("feed/"), (k % 3).cast("string")).alias("feed_dir"))


FEED_LOG = (
    RUNS
    + """,
feed_log AS (SELECT ts, run_id, source_file, gate_result, gate_result = 'accepted' AS feed_written, feed_dir FROM (SELECT *, CASE WHEN CAST(run_id AS BIGINT) % 9 = 0 THEN NULL
  WHEN status <> 'ok' THEN 'withheld:' || status WHEN trust_level = 'low' THEN 'withheld:low_trust' WHEN CAST(run_id AS BIGINT) % 29 = 0 THEN 'accepted:write_failed' ELSE 'accepted' END AS gate_result,
  'feed/' || CAST(CAST(run_id AS BIGINT) % 3 AS VARCHAR) AS feed_dir FROM runs))"""
)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as word boxes, one statement per order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("statement_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("int").alias("word_idx"), (F.col("l_partkey") % 500).cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"),
        (10 + F.col("l_suppkey") % 30).cast("double").alias("width"), F.lit(8.0).alias("height"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("text"),
    )


WORDS = """
words AS (SELECT CAST(l_orderkey AS VARCHAR) AS statement_id, 1 AS page, CAST(l_linenumber AS INTEGER) AS word_idx, CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS y,
  CAST(10 + l_suppkey % 30 AS DOUBLE) AS width, 8.0::DOUBLE AS height, l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS text FROM lineitem)"""
