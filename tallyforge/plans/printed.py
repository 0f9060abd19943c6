"""Registered queries over what files print about themselves: header names, facts above tables, periods, bundles, places of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import facts, labels
from ..sources import delimited
from ..storage import stored
from .registry import query
from .tables import WORDS, table, words



def _lines(rows: DataFrame) -> DataFrame:
    """statement_id, line_no and text of files given as statement_id and an array of lines."""
    return rows.select("statement_id", F.posexplode("lines").alias("at", "text")).select("statement_id", (F.col("at") + 1).alias("line_no"), "text")


@query("""WITH n AS (SELECT unnest([0, 1, 2]) AS v, unnest([['Date', 'Memo', 'Amount', 'Ref', 'Ref.1'], ['Date', 'Memo', 'Amount', 'col4', 'col5'], ['Date', 'Memo', 'Amount', 'Ref', 'Ref.1', 'Ref.1.1']]) AS names),
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_id, [strftime(o_orderdate, '%Y-%m-%d'), 'Order ' || o_orderkey, printf('%.2f', o_totalprice), o_orderpriority, o_orderstatus, 'x'] AS cells FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS statement_id, CAST(row_id AS INTEGER) AS row_id, unnest(names) AS name, unnest(cells[1:len(names)]) AS cell FROM o JOIN n ON v = o_custkey % 3""")
def repeated_headers(spark, sf_dir):
    """Blank and repeated header names: each cell has a name of its own, in every file."""
    o = table(spark, sf_dir, "orders")
    head = F.when(F.col("o_custkey") % 3 == 0, "Date,Memo,Amount,Ref,Ref").when(F.col("o_custkey") % 3 == 1, 'Date,"Memo", Amount,,').otherwise('Date,Memo,Amount,Ref,Ref,"Ref.1"')
    body = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.format_string("%.2f", "o_totalprice"), "o_orderpriority", "o_orderstatus", F.when(F.col("o_custkey") % 3 == 2, "x"))
    files = o.groupBy(F.col("o_custkey").cast("string").alias("statement_id"), head.alias("head")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", body.alias("text")))).alias("rows"))
    lines = _lines(files.select("statement_id", F.concat(F.array("head"), F.transform("rows", lambda r: r["text"])).alias("lines")))
    found = delimited.read(lines, ["Date", "Memo", "Amount"], [","])
    return found.select("statement_id", "row_id", F.explode("cells").alias("name", "cell"))


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS statement_id, CASE WHEN c_custkey % 4 <> 1 THEN printf('12-3456-%07d-00', c_custkey) END AS account_number, CASE WHEN c_custkey % 4 <> 1 THEN '01/01/1992' END AS period_start, CASE WHEN c_custkey % 4 <> 1 THEN '31/12/1998' END AS period_end,
  CASE WHEN c_custkey % 4 <> 1 THEN round(c_acctbal, 2) END AS opening_balance, CASE WHEN c_custkey % 4 = 2 THEN round(c_acctbal + 1000, 2) END AS closing_balance, CASE WHEN c_custkey % 4 = 3 THEN 12 END AS stated_count FROM customer""")
def preamble_facts(spark, sf_dir):
    """Facts above the header of delimited files; labels within the table are none, and a file that begins with its header has none."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    money = lambda c: F.format_number(F.round(c, 2), 2)
    quoted = F.when(k % 2 == 0, F.concat(F.lit('"Opening balance","'), money("c_acctbal"), F.lit('"'))).otherwise(F.concat(F.lit("Opening balance: "), money("c_acctbal")))
    above = F.array_compact(F.array(
        F.lit("Example Bank"), F.format_string("Account number,12-3456-%07d-00", "c_custkey"), F.lit("Statement period,01/01/1992 to 31/12/1998"), F.lit(""), quoted,
        F.when(k % 4 == 2, F.concat(F.lit('Closing balance;"'), money(F.col("c_acctbal") + 1000), F.lit('"'))), F.when(k % 4 == 3, F.lit("Number of transactions,12")), F.lit(","),
    ))
    body = F.array(F.lit("Date,Memo,Amount"), F.lit("1995-01-01,Opening balance,9.99"), F.lit("1995-01-02,Closing balance 01/01/2001 to 02/02/2002,8.88"))
    lines = _lines(c.select(k.cast("string").alias("statement_id"), F.when(k % 4 == 1, body).otherwise(F.concat(above, body)).alias("lines")))
    lines = stored(lines, "lines")  # every label reads these again: written, so that neither work nor plan is repeated
    own = stored(facts.preamble(lines, delimited.header_line(lines, "^Date,")), "preambles")
    found = c.select(k.cast("string").alias("statement_id")).distinct().join(facts.printed(own), "statement_id", "left")
    return found.select("statement_id", "account_number", "period_start", "period_end", "opening_balance", "closing_balance", "stated_count")


@query("""WITH s AS (SELECT c_custkey AS k, i, 2 + c_custkey % 2 AS n, c_custkey % 7 AS fault, CAST(date '2020-01-01' + to_months(CAST(c_custkey % 24 + i + CASE WHEN c_custkey % 7 = 6 AND i > 0 THEN 1 ELSE 0 END AS INTEGER)) AS DATE) AS first, 1000 + c_custkey + 100 * i AS b FROM customer, range(3) t(i) WHERE i < 2 + c_custkey % 2),
d AS (SELECT *, CAST(first + INTERVAL 1 MONTH AS DATE) - 1 AS last, CASE WHEN k // 7 % 2 = 0 THEN i ELSE n - 1 - i END AS place FROM s),
e AS (SELECT *, CASE WHEN fault = 2 AND i = 1 THEN first - 5 ELSE first END AS a FROM d),
p AS (SELECT k, i, n, fault, b, last, place, a, CASE WHEN fault = 5 AND i = 1 THEN '32/13/2020' ELSE strftime(a, '%d/%m/%Y') END AS a_raw, strftime(last, '%d/%m/%Y') AS z_raw FROM e)
SELECT CAST(k AS VARCHAR) AS statement_id, CASE WHEN any_value(fault) <> 5 THEN CAST(any_value(n) AS INTEGER) END AS n_periods, any_value(fault) IN (0, 6) AS merged, CASE any_value(fault) WHEN 1 THEN 'chain' WHEN 2 THEN 'overlap' WHEN 3 THEN 'accounts' WHEN 4 THEN 'balances' WHEN 5 THEN 'unreadable' END AS reason,
  CASE WHEN any_value(fault) IN (0, 6) THEN min_by(a_raw, i) ELSE min_by(a_raw, place) END AS period_start, CASE WHEN any_value(fault) IN (0, 6) THEN max_by(z_raw, i) ELSE min_by(z_raw, place) END AS period_end,
  CASE WHEN any_value(fault) IN (0, 6) THEN format('{:,}.00', min(b)) END AS opening_balance, CASE WHEN any_value(fault) IN (0, 6) THEN format('{:,}.00', max(b) + 100) END AS closing_balance,
  CASE WHEN any_value(fault) = 6 THEN CAST(min(last) + 1 AS VARCHAR) || ' to ' || CAST(max(a) FILTER (i = 1) - 1 AS VARCHAR) ELSE '' END AS gaps FROM p GROUP BY k""")
def period_spans(spark, sf_dir):
    """Two or three printed periods per file, in date order or the other way round: one span where the money proves it, else the fault."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    s = c.select(k, F.explode(F.sequence(F.lit(0), (1 + k % 2).cast("int"))).alias("i"))
    i, fault = F.col("i"), k % 7
    shown = lambda d: F.date_format(d, "dd/MM/yyyy")
    first = F.add_months(F.lit("2020-01-01").cast("date"), (k % 24 + i + F.when((fault == 6) & (i > 0), 1).otherwise(0)).cast("int"))
    start = F.when((fault == 5) & (i == 1), "32/13/2020").otherwise(shown(F.when((fault == 2) & (i == 1), F.date_sub(first, 5)).otherwise(first)))
    amount = lambda n: F.concat(F.format_number(n.cast("long"), 0), F.lit(".00"))
    opening = 1000 + k + 100 * i + F.when((fault == 1) & (i == 1), 1).otherwise(0)
    text = F.array_compact(F.array(
        F.concat(F.lit("Statement period "), start, F.lit(" to "), shown(F.date_sub(F.add_months(first, 1), 1))), F.format_string("Account number 12-3456-%07d-00", F.when(fault == 3, 10 * k + i).otherwise(k)),
        F.concat(F.lit("Opening balance "), amount(opening)), F.lit("10/10/2020 a payment 5.00"), F.when(~((fault == 4) & (i == 1)), F.concat(F.lit("Closing balance "), amount(1000 + k + 100 * (i + 1)))),
    ))
    place = F.when(F.floor(k / 7) % 2 == 0, i).otherwise(1 + k % 2 - i)
    files = s.groupBy(k).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), text.alias("t")))).alias("s"))
    lines = _lines(files.select(k.cast("string").alias("statement_id"), F.flatten(F.transform("s", lambda x: x["t"])).alias("lines"))).withColumn("page", F.lit(1))
    return facts.spans(lines).withColumn("gaps", F.array_join("gaps", "; "))


BUNDLE = {
    "id": "bundle", "bank": "B", "statement_type": "x", "format": "pdf", "fingerprint": {"page_contains_all": ["Sample Bank"]}, "min_score": 1,
    "table": {"date_format": "%d/%m/%Y", "columns": {"date": {"x_min": 0, "x_max": 100}, "description": {"x_min": 101, "x_max": 300}, "amount": {"x_min": 301, "x_max": 400}}},
}


def bundle_words(spark, sf_dir) -> DataFrame:
    """A file per customer with a statement for the orders up to 1998 and one for those after, each on a page of its own that
    says `Page 1 of 1` and prints its period and balances; every fifth file lacks the second period and balances."""
    o = table(spark, sf_dir, "orders")
    k, late = F.col("o_custkey"), (F.year("o_orderdate") > 1998).cast("int")
    amount = F.round(F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")), 2).cast("decimal(18,2)")
    rows = o.select(k, late.alias("late"), "o_orderkey", "o_orderdate", amount.alias("amount"))
    rows = rows.withColumn("no", F.row_number().over(Window.partitionBy("o_custkey", "late").orderBy("o_orderdate", "o_orderkey")))
    word = lambda x, y, t: F.struct(F.lit(float(x)).alias("x"), y.cast("double").alias("y"), t.alias("text"))
    y = 200 + 20 * F.col("no")
    printed = rows.select("o_custkey", "late", F.explode(F.array(word(10, y, F.date_format("o_orderdate", "dd/MM/yyyy")), word(110, y, F.concat(F.lit("Order-"), F.col("o_orderkey").cast("string"))), word(310, y, F.col("amount").cast("string")))).alias("w"))
    sums = rows.groupBy("o_custkey", "late").agg(F.sum("amount").alias("total"))
    opening = F.coalesce(F.sum("total").over(Window.partitionBy("o_custkey").orderBy("late").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(18,2)")
    heads = sums.withColumn("open", opening).withColumn("close", (F.col("open") + F.col("total")).cast("decimal(18,2)"))
    full = (k % 5 != 0) | (F.col("late") == 0)
    span = F.when(F.col("late") == 0, "01/01/1992 to 31/12/1998").otherwise("01/01/1999 to 31/12/2005")
    lit = lambda v: F.lit(float(v))
    top = F.array_compact(F.array(
        word(10, lit(10), F.lit("Sample Bank")), word(10, lit(30), F.lit("Page 1 of 1")), F.when(full, word(10, lit(50), F.concat(F.lit("Statement period "), span))),
        F.when(full, word(10, lit(70), F.concat(F.lit("Opening balance "), F.col("open").cast("string")))), F.when(full, word(10, lit(90), F.concat(F.lit("Closing balance "), F.col("close").cast("string")))),
    ))
    both = printed.unionByName(heads.select("o_custkey", "late", F.explode(top).alias("w")))
    page = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("late")).cast("int")
    numbered = both.withColumn("page", page)
    at = F.row_number().over(Window.partitionBy("o_custkey", "page").orderBy("w.y", "w.x")).cast("int")
    none = F.lit(None).cast("double")
    return numbered.select(k.cast("string").alias("statement_id"), "page", at.alias("word_idx"), "w.x", "w.y", F.lit(30.0).alias("width"), F.lit(10.0).alias("height"), "w.text", F.lit(False).alias("redacted"), none.alias("ocr_conf"))


BUNDLES = """o AS (SELECT o_custkey AS k, CAST(year(o_orderdate) > 1998 AS INTEGER) AS late, o_orderkey, o_orderdate, CAST(round(CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END, 2) AS DECIMAL(18, 2)) AS amount FROM orders),
g AS (SELECT k, late, count(*) AS n, sum(amount) AS total, min(amount) > 0 OR max(amount) < 0 AS one_way FROM o GROUP BY 1, 2),
s AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY k ORDER BY late ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opening, count(*) OVER (PARTITION BY k) AS parts FROM g)"""


@query(f"""WITH {BUNDLES} SELECT CAST(k AS VARCHAR) AS statement_id, CAST(late + 1 AS INTEGER) AS statement_index, (late + 1) || '-' || (late + 1) AS pages, CASE late WHEN 0 THEN '01/01/1992' ELSE '01/01/1999' END AS period_start, n AS "rows", CAST(opening AS DOUBLE) AS opening_balance, CAST(opening + total AS DOUBLE) AS closing_balance,
  CASE WHEN n >= 2 AND one_way THEN 'low' ELSE 'medium' END AS trust_level FROM s WHERE parts = 2 AND k % 5 <> 0""")
def bundle_statements(spark, sf_dir):
    """Statements of bundles, each parsed and reconciled by itself, where an independent count confirms the cut."""
    from ..engine import convert_words

    found = convert_words(spark, bundle_words(spark, sf_dir), {"bundle": BUNDLE})
    return found.statements.select("statement_id", "statement_index", "pages", "period_start", "rows", "opening_balance", "closing_balance", "trust_level")


@query(f"""WITH {BUNDLES}, q AS (SELECT k, any_value(parts) = 2 AND k % 5 <> 0 AS split, bool_or(n >= 2 AND one_way) AS part_low, sum(n) AS n FROM s GROUP BY k),
w AS (SELECT k, count(*) >= 2 AND (min(amount) > 0 OR max(amount) < 0) AS low, sum(amount) AS total FROM o GROUP BY 1),
t AS (SELECT o.*, row_number() OVER (PARTITION BY k ORDER BY late, o_orderdate, o_orderkey) AS row_id FROM o)
SELECT CAST(k AS VARCHAR) AS statement_id, CAST(row_id AS INTEGER) AS row_id, CASE WHEN split THEN CAST(late + 1 AS INTEGER) END AS statement_index, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(amount AS DOUBLE) AS amount,
  split OR parts_of = 1 AS alone, CASE WHEN split THEN CASE WHEN part_low THEN 'low' ELSE 'medium' END WHEN parts_of = 1 AND k % 5 <> 0 OR parts_of = 1 AND late = 0 THEN CASE WHEN low THEN 'low' ELSE 'medium' END END AS trust_level
FROM t JOIN q USING (k) JOIN w USING (k) JOIN (SELECT k, any_value(parts) AS parts_of FROM s GROUP BY 1) USING (k)""")
def bundle_transactions(spark, sf_dir):
    """All rows of the same files: those of split bundles carry their statement's number; the rest was read whole. `alone` says that
    nothing of several statements is left unresolved; trust is shown where the file's own balances bear on it."""
    from ..engine import convert_words

    found = convert_words(spark, bundle_words(spark, sf_dir), {"bundle": BUNDLE})
    pages = found.lines.groupBy("statement_id").agg(F.max("page").alias("parts"), F.max((F.col("text").startswith("Opening")).cast("int")).alias("printed"))
    split = found.statements.select("statement_id").distinct().withColumn("split", F.lit(True))
    rows = found.transactions.join(pages, "statement_id").join(split, "statement_id", "left").join(found.reconciled.select("statement_id", "trust_level"), "statement_id")
    alone = F.col("split").isNotNull() | (F.col("parts") == 1)
    known = F.col("split").isNotNull() | (F.col("parts") == 1) & (F.col("printed") == 1)
    return rows.select("statement_id", "row_id", "statement_index", "date", "amount", alone.alias("alone"), F.when(known, F.col("trust_level")).alias("trust_level"))


PLACED = f"""WITH {WORDS}, v AS (SELECT statement_id, left(text, 2) AS t, x, y, width, height, row_number() OVER (PARTITION BY statement_id ORDER BY round(y / 3), x, word_idx, y, x + width, y + height, text) AS n FROM words),
r AS (SELECT a.*, b.t AS t2, b.x AS x2, b.y AS y2, b.width AS w2, b.height AS h2 FROM v a LEFT JOIN v b ON a.statement_id = b.statement_id AND b.n = a.n + 1),
q AS (SELECT statement_id, 'pair' AS field, t || '  ' || lower(t2) AS value, t AS a, t2 AS b FROM r WHERE n = 2 AND t2 IS NOT NULL UNION ALL SELECT statement_id, 'single', left(t, 1), left(t, 1), NULL FROM r WHERE n = 1 UNION ALL SELECT statement_id, 'nowhere', 'NO such words', 'zz', 'zz' FROM r WHERE n = 1),
h AS (SELECT q.statement_id, q.field, q.value, r.n, least(r.x, CASE WHEN q.b IS NULL THEN r.x ELSE r.x2 END) AS x0, least(r.y, CASE WHEN q.b IS NULL THEN r.y ELSE r.y2 END) AS y0,
  greatest(r.x + r.width, CASE WHEN q.b IS NULL THEN r.x + r.width ELSE r.x2 + r.w2 END) AS x1, greatest(r.y + r.height, CASE WHEN q.b IS NULL THEN r.y + r.height ELSE r.y2 + r.h2 END) AS y1
  FROM q JOIN r ON q.statement_id = r.statement_id AND CASE WHEN q.b IS NULL THEN contains(r.t, q.a) ELSE r.t = q.a AND r.t2 = q.b END)
SELECT q.statement_id, q.field, q.value, count(h.n) > 0 AS found, min_by(x0, h.n) AS x0, min_by(y0, h.n) AS y0, min_by(x1, h.n) AS x1, min_by(y1, h.n) AS y1, CAST(count(h.n) AS INTEGER) AS times FROM q LEFT JOIN h ON q.statement_id = h.statement_id AND q.field = h.field GROUP BY 1, 2, 3"""


@query(PLACED)
def values_located(spark, sf_dir):
    """Where values of two words, of one (within a longer word, at several places) and of none stand on their pages."""
    w = words(spark, sf_dir).withColumn("text", F.substring("text", 1, 2))
    order = Window.partitionBy("statement_id").orderBy(F.round(F.col("y") / 3), "x", "word_idx", "y", F.col("x") + F.col("width"), F.col("y") + F.col("height"), "text")
    r = w.withColumns({"n": F.row_number().over(order), "next": F.lead("text").over(order)})
    wanted = F.array_compact(F.array(
        F.when((F.col("n") == 2) & F.col("next").isNotNull(), F.struct(F.lit("pair").alias("field"), F.concat("text", F.lit("  "), F.lower("next")).alias("value"))),
        F.when(F.col("n") == 1, F.struct(F.lit("single").alias("field"), F.substring("text", 1, 1).alias("value"))), F.when(F.col("n") == 1, F.struct(F.lit("nowhere").alias("field"), F.lit("NO such words").alias("value"))),
    ))
    values = r.select("statement_id", F.explode(wanted).alias("v")).select("statement_id", "v.field", "v.value")
    return facts.located(w, values).drop("page")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END || format('{:,.2f}', round(o_totalprice, 2)) END AS money FROM orders""")
def dotted_dates(spark, sf_dir):
    """Amounts beside dates of digits and dots, in two and four figures of the year, before and after the amount; a date alone is no amount."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    amount = F.concat(F.when(k % 2 == 0, "-").otherwise(""), F.format_number(F.round("o_totalprice", 2), 2))
    long, short = F.date_format("o_orderdate", "dd.MM.yyyy"), F.date_format("o_orderdate", "d.M.yy")
    line = F.when(k % 4 == 0, F.concat(F.lit("Opening balance "), amount, F.lit(" as at "), long)).when(k % 4 == 1, F.concat(F.lit("Balance on "), short, F.lit(": "), amount)).when(k % 4 == 2, F.concat(short, F.lit(" "), amount, F.lit(" ("), long, F.lit(")"))).otherwise(F.concat(F.lit("Balance as at "), long))
    return o.select("o_orderkey", labels.value_in(line, "money").alias("money"))
