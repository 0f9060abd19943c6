"""Registered queries over drafting and the stored feed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bands, feed
from ..storage import shared_folder
from .registry import query
from .tables import RUNS, runs, table


def column_words(spark, sf_dir) -> DataFrame:
    """A page per customer in one of five layouts: two columns of figures, three, two without headings, two under another
    table, and three of which one is never printed under."""
    k = F.col("o_custkey")
    o = table(spark, sf_dir, "orders").withColumn("layout", F.col("o_custkey") % 5)
    o = o.withColumn("no", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    shift, y = F.when(F.col("layout") == 3, 40.0).otherwise(0.0), 120.0 + 15 * F.col("no")

    def word(x, t, at=y, width=None):
        return F.struct((x if not isinstance(x, float) else shift + x).alias("x"), at.cast("double").alias("y"), (F.lit(width) if width else 5.0 * F.length(t)).cast("double").alias("width"), t.alias("text"))

    def figure(edge, t):
        return word(shift + edge - 5.0 * F.length(t), t)

    amount, balance = F.format_string("%.2f", "o_totalprice"), F.format_string("%.2f", (k + 1000).cast("double"))
    wide, two_words = F.col("layout").isin(1, 4), F.col("layout") == 1
    spent = ~two_words | (F.col("o_orderkey") % 2 == 0)
    body = F.array_compact(F.array(
        F.when(two_words, word(30.0, F.date_format("o_orderdate", "dd"))).otherwise(word(30.0, F.date_format("o_orderdate", "dd/MM/yyyy"))), F.when(two_words, word(43.0, F.date_format("o_orderdate", "MMM"))),
        word(100.0, F.lit("Order")), word(130.0, F.col("o_orderkey").cast("string")), F.when(~wide, figure(380.0, amount)), F.when(wide & spent, figure(300.0, amount)), F.when(wide & ~spent, figure(390.0, amount)), figure(480.0, balance),
    ))
    top = F.lit(100.0)
    head = lambda x, t, width: word(float(x), F.lit(t), top, float(width))
    heads = F.when(wide, F.array(head(30, "Date", 20), head(100, "Details", 35), head(245, "Withdrawals", 55), head(340, "Deposits", 40), head(430, "Balance", 35))).when(F.col("layout") != 2, F.array(head(30, "Date", 20), head(100, "Details", 35), head(330, "Amount", 30), head(430, "Balance", 35)))
    above = F.when(F.col("layout") == 3, F.array(*(word(x, F.lit(t), F.lit(60.0)) for x, t in ((160.0, "01/01/2020"), (215.0, "Upcoming"), (300.0, "9.99")))))
    empty = F.array().cast("array<struct<x:double,y:double,width:double,text:string>>")
    page = o.select("layout", k, F.explode(body).alias("w")).union(o.select("layout", "o_custkey").distinct().withColumn("w", F.explode(F.concat(F.coalesce(heads, empty), F.coalesce(above, empty)))))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("w.y", "w.x"))
    return page.select(F.concat(F.lit("layout "), F.col("layout").cast("string")).alias("layout"), k.cast("string").alias("statement_id"), F.lit(1).alias("page"), place.alias("word_idx"), "w.x", "w.y", "w.width", F.lit(8.0).alias("height"), "w.text")


@query("""WITH o AS (SELECT o_custkey % 5 AS k, CASE WHEN o_custkey % 5 = 3 THEN 40 ELSE 0 END AS s, o_orderkey, 5.0 * length(printf('%.2f', o_totalprice)) AS a, 5.0 * length(printf('%.2f', o_custkey + 1000.0)) AS b, o_orderkey % 2 = 0 AS even FROM orders),
c AS (
  SELECT k, 'date' AS field, 'date' AS kind, min(30 + s) AS lo, max(CASE WHEN k = 1 THEN 58 ELSE 80 + s END) AS hi FROM o GROUP BY k
  UNION ALL SELECT k, 'description', 'text', min(100 + s), max(130 + s + 5 * length(CAST(o_orderkey AS VARCHAR))) FROM o GROUP BY k
  UNION ALL SELECT k, 'amount', 'money', min(CASE WHEN k <> 2 THEN least(330 + s, 380 + s - a) ELSE 380 - a END), max(380 + s) FROM o WHERE k IN (0, 2, 3) GROUP BY k
  UNION ALL SELECT k, 'debit', 'money', min(least(245, 300 - a)), max(300) FROM o WHERE k = 4 OR k = 1 AND even GROUP BY k
  UNION ALL SELECT k, 'credit', 'money', min(CASE WHEN k = 1 AND NOT even THEN least(340, 390 - a) ELSE 340 END), max(CASE WHEN k = 1 AND NOT even THEN 390 ELSE 380 END) FROM o WHERE k IN (1, 4) GROUP BY k
  UNION ALL SELECT k, 'balance', 'money', min(CASE WHEN k <> 2 THEN least(430 + s, 480 + s - b) ELSE 480 - b END), max(480 + s) FROM o GROUP BY k),
n AS (SELECT *, lag(hi) OVER w AS before, lag(field) OVER w AS left_of, lead(lo) OVER w AS after FROM c WINDOW w AS (PARTITION BY k ORDER BY lo))
SELECT 'layout ' || k AS layout, field, kind, CAST(floor(CASE WHEN before IS NULL THEN lo - 3 WHEN left_of = 'description' THEN lo ELSE (before + lo) / 2 END) AS DOUBLE) AS x_min, CAST(ceil(CASE WHEN after IS NULL THEN hi + 3 WHEN field = 'description' THEN after ELSE (hi + after) / 2 END) AS DOUBLE) AS x_max FROM n""")
def layout_bands(spark, sf_dir):
    """Columns of every layout from the words of all its pages; the SQL knows which column each word belongs to."""
    return bands.suggested(column_words(spark, sf_dir))


@query(f"""WITH {RUNS}, r AS (SELECT CAST(user_id AS VARCHAR) AS feed_key, CASE WHEN ts < '2024-01-15' THEN 1 ELSE 2 END AS batch, status AS run_id, CASE WHEN trust_level = 'low' THEN 'withheld:low_trust' ELSE 'accepted' END AS gate_result, source_file FROM runs),
kept AS (SELECT * FROM r JOIN (SELECT feed_key, max(batch) AS batch FROM r GROUP BY 1) USING (feed_key, batch))
SELECT feed_key, source_file, run_id, CASE WHEN gate_result = 'accepted' AND run_id = 'needs_review' THEN 'retracted:user_reported_wrong' ELSE gate_result END AS gate_result, CASE WHEN gate_result = 'accepted' AND run_id <> 'needs_review' THEN 'transactions' ELSE 'review' END AS side FROM kept""")
def stored_feed(spark, sf_dir):
    """Two batches published and a run retracted: both sides of one snapshot."""
    r = runs(spark, sf_dir).select(F.col("user_id").cast("string").alias("feed_key"), F.col("status").alias("run_id"), F.when(F.col("trust_level") == "low", "withheld:low_trust").otherwise("accepted").alias("gate_result"), "source_file", "ts")
    folder, early = f"{shared_folder(spark)}/tallyforge-feed-{uuid.uuid4().hex}", F.col("ts") < "2024-01-15"
    for batch in (r.where(early), r.where(~early)):
        feed.publish(spark, batch.drop("ts"), folder)
    feed.retract_stored(spark, folder, "needs_review")
    rows = feed.store(spark, folder).snapshot().rows()
    return rows.withColumn("side", F.when(F.col("gate_result") == "accepted", feed.SIDES[0]).otherwise(feed.SIDES[1])).select("feed_key", "source_file", "run_id", "gate_result", "side")
