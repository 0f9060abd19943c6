"""More registered queries: reading of files and cells, checks, labels, detection, pages of words, reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..operators import detect, diagnostics, feed, geometry, labels, metadata, outputs, parse, pdf_table, profile, reconcile, retention, split
from ..operators.analytics import length_stats
from ..operators.templates import frame
from ..sources import delimited, pages
from ..streaming import intake
from .registry import ledger_headers, query
from .tables import LEDGER, RUNS, WORDS, ledger, runs, table, words


def _case(key: Column, *values: Column) -> Column:
    """The k-th value where key modulo their number is k."""
    out = F.when(F.lit(False), F.lit(None))
    for k, v in enumerate(values):
        out = out.when(key % len(values) == k, v)
    return out


# --- labels, markers and patterns ---


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN format('{:,.2f}', o_totalprice) WHEN 1 THEN '$' || CAST(o_custkey AS VARCHAR) WHEN 2 THEN NULL WHEN 3 THEN '(' || format('{:,.2f}', o_totalprice) || ') DR' ELSE '-' || format('{:,.2f}', o_totalprice) END AS money,
  CASE o_orderkey % 5 WHEN 0 THEN '31 Mar 2024' WHEN 4 THEN '1/02/2023' END AS first_date, CASE o_orderkey % 5 WHEN 4 THEN '1/02/2023..28/02/2023' END AS span, CASE o_orderkey % 5 WHEN 0 THEN '2024' WHEN 1 THEN '12' WHEN 2 THEN '2024' END AS stated FROM orders""")
def label_money(spark, sf_dir):
    """An amount has decimals or a currency sign: years, pages and counts beside a label are none."""
    o = table(spark, sf_dir, "orders")
    printed = F.format_number("o_totalprice", 2)
    line = _case(
        F.col("o_orderkey"), F.concat(F.lit("Opening balance "), printed, F.lit(" as at 31 Mar 2024")), F.concat(F.lit("closing balance $"), F.col("o_custkey").cast("string"), F.lit(" (page 12)")), F.lit("page 3, year 2024"),
        F.concat(F.lit("Total ("), printed, F.lit(") DR")), F.concat(F.lit("From 1/02/2023 to 28/02/2023 fees -"), printed),
    )
    count = F.when(F.col("o_orderkey") % 5 < 3, labels.value_in(line, "count"))
    return o.select("o_orderkey", labels.value_in(line, "money").alias("money"), labels.value_in(line, "date").alias("first_date"), labels.value_in(line, "date_range").alias("span"), count.alias("stated"))


@query("""SELECT c_custkey, c_custkey % 6 IN (0, 1, 2) AS redacted, c_custkey % 6 IN (0, 1, 2, 3) AS marked FROM customer""")
def redaction_glyphs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cell = _case(F.col("c_custkey"), F.lit("████"), F.concat(F.lit("a "), F.col("c_name"), F.lit(" ▓▒░")), F.lit("[redacted] REDACTED"), F.lit("XXXXXXXX"), F.col("c_name"), F.lit("").cast("string"))
    return c.select("c_custkey", text.is_redacted(cell).alias("redacted"), text.matches_marker(cell).alias("marked"))


@query("""SELECT c_custkey, c_custkey % 4 < 2 AS footer, CASE c_custkey % 4 WHEN 3 THEN ['12-3456-1234567-00'] WHEN 2 THEN ['01-0234-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '-001'] ELSE []::VARCHAR[] END AS accounts,
  CASE c_custkey % 4 WHEN 0 THEN 'Page 3 of 9' WHEN 1 THEN 'continued on next page' WHEN 2 THEN 'a 01-0234-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '-001 b' ELSE 'x 12-3456-1234567-00 12-3456-1234567-00' END AS folded FROM customer""")
def line_facts(spark, sf_dir):
    """Footers, distinct matches of a pattern, and folded white space."""
    c = table(spark, sf_dir, "customer")
    own = F.concat(F.lit(" a \t 01-0234-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit("-001  b "))
    line = _case(F.col("c_custkey"), F.lit("  Page 3  of 9 "), F.lit("continued on next  page"), own, F.lit("x 12-3456-1234567-00\t12-3456-1234567-00"))
    return c.select("c_custkey", text.is_footer(line).alias("footer"), text.all_matches(line, labels.DEFAULTS["account_regex"]).alias("accounts"), text.fold_ws(line).alias("folded"))


@query("""SELECT c_custkey, 'memo ' || c_name AS trimmed, c_custkey % 3 = 0 AS blank, CASE c_custkey % 3 WHEN 0 THEN [] ELSE ['Alpha', c_name] END AS phrases, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE c_name || ' ' || c_mktsegment END AS appended,
  CASE WHEN c_custkey % 3 = 0 THEN 'redacted' WHEN c_custkey % 3 = 1 THEN 'redacted,fx' ELSE '' END AS flags, c_custkey % 3 = 1 AS has_phrase FROM customer""")
def cell_texts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    lines = F.when(k == 0, F.lit(" \r\n\t")).otherwise(F.concat(F.lit(" Alpha \r\n"), F.col("c_name"), F.lit("\n\n Alpha")))
    return c.select(
        "c_custkey", text.clean_description(F.concat(F.lit("\t memo "), F.col("c_name"), F.lit(" \r\n"))).alias("trimmed"), text.is_blank(F.when(k == 0, F.lit(" \t ")).otherwise(F.col("c_name"))).alias("blank"), text.fingerprint_phrases(lines).alias("phrases"),
        text.append_cell(F.concat(F.col("c_name"), F.lit(" ")), F.when(k != 0, F.col("c_mktsegment"))).alias("appended"), text.join_flags(text.flags(("redacted", k < 2), ("fx", F.when(k == 1, F.lit(True))))).alias("flags"),
        text.has_phrase(F.when(k == 1, F.lit("one two three")).otherwise(F.lit("one three")), "two three").alias("has_phrase"),
    )


@query("""SELECT c_custkey, c_custkey % 5 < 4 AS looks_money, CASE c_custkey % 4 WHEN 0 THEN '2024-03-31' WHEN 1 THEN '2023-02-01' WHEN 2 THEN '1999-12-05' END AS tolerant, CASE c_custkey % 4 WHEN 0 THEN '2024-03-31' WHEN 1 THEN '2023-02-01' WHEN 2 THEN '1999-12-05' END AS period,
  format('{:,.2f}', abs(c_acctbal)) AS size, CASE WHEN c_acctbal < 0 THEN '-$' ELSE '$' END || format('{:,.2f}', abs(c_acctbal)) AS shown FROM customer""")
def printed_values(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cell = _case(F.col("c_custkey"), F.format_number("c_acctbal", 2), F.lit("(12.50)"), F.lit("$99 DR"), F.lit("12/03/2024"), F.lit("no figure"))
    day = _case(F.col("c_custkey"), F.lit("31st of March 2024").substr(1, 18), F.lit("01/02/2023"), F.lit("5 Dec 99"), F.lit("soon"))
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    return c.select("c_custkey", money.looks_money(cell).alias("looks_money"), iso(dates.tolerant(day)).alias("tolerant"), iso(dates.period_date(day)).alias("period"), F.format_number(F.abs("c_acctbal"), 2).alias("size"), money.shown(F.col("c_acctbal")).alias("shown"))


@query("""SELECT 'plain' AS "column", false AS currency_symbol, true AS thousands_sep, 'dot' AS decimal_mark, false AS parens_negative, true AS minus_negative, false AS dr_cr_suffix UNION ALL
  SELECT 'marked', true, true, 'dot', true, false, true UNION ALL SELECT 'comma', false, false, 'comma', false, false, false""")
def money_styles(spark, sf_dir):
    """How amounts are printed: every column of a table in one pass."""
    o = table(spark, sf_dir, "orders")
    price, k = F.format_number("o_totalprice", 2), F.col("o_orderkey")
    plain = F.concat(F.when(k % 2 == 0, F.lit("-")).otherwise(F.lit("")), price)
    marked = F.when(k % 3 == 0, F.concat(F.lit("("), price, F.lit(")"))).when(k % 3 == 1, F.concat(F.lit("$"), price)).otherwise(F.concat(price, F.lit(" CR")))
    comma = F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(","))
    return profile.money_facts(o.select(plain.alias("plain"), marked.alias("marked"), comma.alias("comma")), "plain", "marked", "comma")


# --- files ---


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'delimited' WHEN 1 THEN 'excel' WHEN 2 THEN 'pdf' WHEN 3 THEN NULL ELSE 'delimited' END AS kind, c_name AS decoded, substr(sha256(c_name), 1, 16) AS key, ['a', 'b,"c', 'd', '', ''][1:CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 2 END] AS cells,
  CASE WHEN c_custkey % 3 = 0 THEN ';' ELSE ',' END AS sniffed, c_custkey % 3 = 2 AS padding FROM customer""")
def file_bytes(spark, sf_dir):
    """Kinds by name, text by byte order mark, content keys, cells fitted to a header, sniffed delimiters, padding lines."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    path = F.concat(F.lit("/in/"), F.col("c_name"), _case(k, F.lit(".CSV"), F.lit(".xlsx"), F.lit(".pdf"), F.lit(".docx"), F.lit(".v2.tsv")))
    body = lambda mark, code: F.concat(F.unhex(F.lit(mark)), F.encode("c_name", code))
    content = _case(k, body("FFFE", "UTF-16LE"), body("FEFF", "UTF-16BE"), body("EFBBBF", "UTF-8"), body("", "UTF-8"))
    record = F.lit('a,"b,""c",d')
    line = _case(k, F.lit("a;b;c,d"), F.lit("a,b,c;d"), F.lit("a,b;c"))
    width = F.when(k % 2 == 0, 5).otherwise(2)
    return c.select(
        "c_custkey", delimited.kind_of(path).alias("kind"), delimited.decoded(content).alias("decoded"), feed.feed_key(F.sha2(F.col("c_name").cast("binary"), 256)).alias("key"), delimited.fitted(delimited.fields(record, ","), width).alias("cells"),
        delimited.sniff_delimiter(line).alias("sniffed"), delimited.is_padding(_case(k, F.lit("a,,"), F.lit("1,2"), F.lit(' , ,\t')), F.lit(",")).alias("padding"),
    )


TEMPLATE = {
    "id": "orders_csv", "bank": "Example", "statement_type": "everyday", "format": "delimited", "delimiter": [";", ","], "fingerprint": {"header_contains_all": ["Date", "Memo", "Amount"]}, "preamble": {"header_regex": "^\"?(?i:date)\"?[;,]"},
    "columns": {"date": {"source": "Date", "format": ["%Y-%m-%d", "%d/%m/%Y"]}, "description": {"source": "memo"}, "amount": {"source": "Amount"}, "balance": {"source": "Balance"}, "reference": {"source": "Ref"}}, "extras": {"clerk": {"source": "Clerk"}}, "amount_sign": "signed",
}


def csv_lines(spark, sf_dir):
    """Each customer's orders as the lines of a file: a preamble, a header, rows, a padding line; every fifth file uses
    semicolons, every third day-first dates; some memos hold a line break, some rows lack a cell or hide their amount."""
    o = table(spark, sf_dir, "orders")
    key, cut = F.col("o_custkey"), F.when(F.col("o_custkey") % 5 == 0, ";").otherwise(",")
    day = F.when(key % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    amount = F.when(F.col("o_orderkey") % 17 == 0, "[REDACTED]").otherwise(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(""), F.format_string("%.2f", "o_totalprice")))
    memo = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit('"order\n'), F.col("o_orderkey").cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('" order'), F.lit(' ""'), F.col("o_orderkey").cast("string"), F.lit('"" "')))
    tail = F.when(F.col("o_orderkey") % 13 == 0, F.lit("")).otherwise(F.concat(cut, F.lit(" "), cut, F.substring("o_orderpriority", 3, 9)))
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat_ws("", day, cut, memo, cut, amount, cut, F.lit(""), tail).alias("t")))).alias("r"))
    head = F.concat_ws("", F.lit("Example statement\n\n\"DATE\""), cut, F.lit("Memo"), cut, F.lit("Amount"), cut, F.lit("Balance"), cut, F.lit("Ref"), cut, F.lit("Clerk"))
    body = F.concat_ws("\n", head, F.array_join(F.col("r.t"), "\n"), F.concat(cut, cut, F.lit(" "), cut), F.lit(""))
    return delimited.lines(rows.select(key.cast("string").alias("statement_id"), body.alias("body")), F.col("body"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS statement_id, CAST(row_number() OVER w AS INTEGER) AS row_id, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 7 = 0 THEN 'order' || chr(10) || o_orderkey ELSE 'order "' || o_orderkey || '"' END AS description,
  CASE WHEN o_orderkey % 17 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * o_totalprice END AS amount, CASE WHEN o_orderkey % 17 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'debit' ELSE 'credit' END END AS direction,
  concat_ws(',', CASE WHEN o_orderkey % 17 = 0 THEN 'redacted' END, CASE WHEN o_orderkey % 13 = 0 THEN 'malformed' END) AS flags, CASE WHEN o_orderkey % 13 <> 0 THEN substr(o_orderpriority, 3, 9) END AS clerk,
  'csv:line=' || (3 + sum(CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) - CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) || CASE WHEN o_orderkey % 7 = 0 THEN '-' || (3 + sum(CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING)) ELSE '' END AS source_ref
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def delimited_transactions(spark, sf_dir):
    """Lines of files to the transactions table: header location, delimiter, quotes, records, cells, dates by file, flags."""
    tx, _ = parse.parse_delimited(csv_lines(spark, sf_dir), TEMPLATE)
    return tx.select("statement_id", "row_id", "date", "description", "amount", "direction", "flags", F.col("extras")["clerk"].alias("clerk"), "source_ref")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS statement_id, CAST(count(*) + count(*) FILTER (o_orderkey % 7 = 0) AS INTEGER) AS source_lines, 1 AS padding_lines, CAST(count(*) FILTER (o_orderkey % 7 = 0) AS INTEGER) AS multiline_extra FROM orders GROUP BY 1""")
def delimited_counters(spark, sf_dir):
    _, counters = parse.parse_delimited(csv_lines(spark, sf_dir), TEMPLATE)
    return counters.select("statement_id", "source_lines", "padding_lines", "multiline_extra")


# --- pages of words ---

BANDS = {"id": "orders_pdf", "format": "pdf", "table": {"date_format": "%d/%m/%Y", "columns": {"date": {"x_min": 0, "x_max": 100}, "description": {"x_min": 101, "x_max": 300}, "amount": {"x_min": 301, "x_max": 400}, "balance": {"x_min": 401, "x_max": 500}}}}


def page_words(spark, sf_dir):
    """A page per order: a heading; its row, whole or parted over two lines; a wrapped line; a total; a footer. In some, a
    sign stands below its amount; in some, words come from a poor scan."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    word = lambda x, y, t, conf=None: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), t.cast("string").alias("text"), (F.lit(None) if conf is None else conf).cast("double").alias("ocr_conf"))
    none = F.lit(None).cast("struct<x:double,y:double,text:string,ocr_conf:double>")
    down = F.when(k % 4 == 1, 110.0).otherwise(100.0)
    amount = F.struct(F.lit(310.0).alias("x"), down.alias("y"), F.format_string("%.2f", "o_totalprice").alias("text"), F.when(k % 6 == 0, 41.0).otherwise(97.0).alias("ocr_conf"))
    parts = F.array(
        word(10, 50, F.lit("Date")), word(310, 50, F.lit("Amount")), word(10, 100, F.date_format("o_orderdate", "dd/MM/yyyy")), word(110, 100, F.lit("Order")), word(150, 100, k), amount,
        F.when((k % 3 == 0) & (k % 4 != 1), word(110, 111, F.lit("wrapped"))).otherwise(none),
        F.when((k % 5 == 0) & (k % 4 != 1) & (k % 3 != 0), word(330, 111, F.lit("DR"))).otherwise(none), word(110, 200, F.lit("Closing")), word(150, 200, F.lit("balance")), word(310, 200, F.lit("99.00")), word(110, 700, F.lit("Page 1 of 1")),
    )
    rows = o.select(k.cast("string").alias("statement_id"), F.posexplode(F.array_compact(parts)).alias("word_idx", "w"))
    return rows.select("statement_id", F.lit(1).alias("page"), "word_idx", "w.x", "w.y", F.lit(30.0).alias("width"), F.lit(10.0).alias("height"), "w.text", F.lit(False).alias("redacted"), "w.ocr_conf")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS statement_id, 1 AS row_id, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Order ' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 1 THEN ' wrapped' ELSE '' END AS description,
  CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 <> 1 AND o_orderkey % 3 <> 0 THEN -o_totalprice ELSE o_totalprice END AS amount, concat_ws(',', CASE WHEN o_orderkey % 4 = 1 THEN 'row_stitched' END, CASE WHEN o_orderkey % 4 <> 1 AND o_orderkey % 3 = 0 THEN 'row_text_merged' END, CASE WHEN o_orderkey % 6 = 0 THEN 'ocr_low_conf' END) AS flags FROM orders""")
def page_transactions(spark, sf_dir):
    """Words of pages to the transactions table: rows, bands, parted rows, wrapped lines, signs below, totals left out."""
    headers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("statement_id"), F.lit(None).cast("string").alias("period_start"), F.lit(None).cast("string").alias("period_end"))
    tx, _ = pdf_table.transactions(page_words(spark, sf_dir), BANDS, headers)
    return tx.select("statement_id", "row_id", "date", "description", "amount", "flags")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS statement_id, r.kept, r.verdict, r.raw FROM orders, LATERAL (VALUES (false, 'heading_or_note', 'Date Amount'), (o_orderkey % 4 <> 1, CASE WHEN o_orderkey % 4 = 1 THEN 'amount_missing' ELSE '' END, strftime(o_orderdate, '%d/%m/%Y') || ' Order ' || o_orderkey || CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE ' ' || format('{:.2f}', o_totalprice) END),
  (false, CASE WHEN o_orderkey % 4 = 1 THEN 'date_unparsed' WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'heading_or_note' END, CASE WHEN o_orderkey % 4 = 1 THEN format('{:.2f}', o_totalprice) WHEN o_orderkey % 3 = 0 THEN 'wrapped' WHEN o_orderkey % 5 = 0 THEN 'DR' END),
  (false, 'summary_line', 'Closing balance 99.00'), (false, 'heading_or_note', 'Page 1 of 1')) r(kept, verdict, raw) WHERE r.raw IS NOT NULL""")
def page_xray(spark, sf_dir):
    """Every visual row of a page with its verdict."""
    rows = pdf_table.xray(page_words(spark, sf_dir), BANDS)
    return rows.select("statement_id", "kept", "verdict", "raw")


@query(f"""WITH {WORDS}, m AS (SELECT statement_id, page, CAST(CASE WHEN CAST(statement_id AS BIGINT) % 3 = 0 THEN 595.28 WHEN CAST(statement_id AS BIGINT) % 3 = 1 THEN 600 ELSE 1190.56 END AS DOUBLE) AS width FROM words GROUP BY 1, 2)
SELECT w.statement_id, w.word_idx, CASE WHEN m.width > 1000 THEN x * (595.28::DOUBLE / 1190.56::DOUBLE) ELSE x END AS x, y FROM words w JOIN m USING (statement_id, page) WHERE CASE WHEN m.width > 1000 THEN (x + w.width) * (595.28::DOUBLE / 1190.56::DOUBLE) ELSE x + w.width END >= 50 AND CASE WHEN m.width > 1000 THEN x * (595.28::DOUBLE / 1190.56::DOUBLE) ELSE x END <= 250 AND y <= 40""")
def framed_words(spark, sf_dir):
    """Words scaled to the template's frame, those in a region. A page within two per cent of the frame counts as equal."""
    w = words(spark, sf_dir)
    k = F.col("statement_id").cast("long") % 3
    own = w.select("statement_id", "page").distinct().select("statement_id", "page", F.when(k == 0, 595.28).when(k == 1, 600.0).otherwise(1190.56).alias("width"), F.lit(841.89).alias("height"))
    return geometry.to_frame(w, own).where(geometry.in_region(50, 250, None, 40)).select("statement_id", "word_idx", "x", "y")


@query(f"""WITH {WORDS} SELECT statement_id, page, word_idx, x * 72.0::DOUBLE / 300 AS x, y * 72.0::DOUBLE / 300 AS y, CAST(CAST(statement_id AS BIGINT) % 101 - 3 AS DOUBLE) AS ocr_conf FROM words WHERE CAST(statement_id AS BIGINT) % 101 - 3 >= 0 AND word_idx <> 3""")
def ocr_words(spark, sf_dir):
    """Rows of an OCR program as words in points; rejected and blank ones go."""
    w = words(spark, sf_dir)
    tsv = w.select("statement_id", "page", "word_idx", F.col("x").alias("left"), F.col("y").alias("top"), "width", "height", (F.col("statement_id").cast("long") % 101 - 3).cast("double").alias("conf"), F.when(F.col("word_idx") == 3, F.lit(" ")).otherwise(F.col("text")).alias("text"))
    return pages.ocr_words(tsv).select("statement_id", "page", "word_idx", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "ocr_conf")


@query(f"""WITH {WORDS} SELECT statement_id, page, round_even(avg(CAST((CAST(statement_id AS BIGINT) * word_idx) % 101 AS DOUBLE)) FILTER ((CAST(statement_id AS BIGINT) * word_idx) % 101 >= 5), 1) AS ocr_conf FROM words GROUP BY 1, 2""")
def page_confidence(spark, sf_dir):
    conf = (F.col("statement_id").cast("long") * F.col("word_idx")) % 101
    return pages.mean_confidence(words(spark, sf_dir).withColumn("ocr_conf", F.when(conf >= 5, conf).otherwise(-1).cast("double")))


@query("""SELECT doc_id, boxes, length(regexp_replace(t, '\\s', '', 'g')) = 0 OR boxes < 3 AS needs FROM (SELECT doc_id, doc_id % 7 AS boxes, CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 5 = 1 THEN 'two words' ELSE 'a page with quite enough text on it' END AS t FROM documents)""")
def ocr_routing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.when(F.col("doc_id") % 5 == 0, " ").when(F.col("doc_id") % 5 == 1, "two words").otherwise("a page with quite enough text on it")
    return d.select("doc_id", (F.col("doc_id") % 7).alias("boxes"), pages.needs_ocr(t, F.col("doc_id") % 7).alias("needs"))


# --- checks, detection, diagnostics, reports ---


@query(f"""WITH {LEDGER}, l AS (SELECT statement_id, CAST(statement_id AS BIGINT) AS s, CASE WHEN o_orderkey % 19 <> 0 THEN date END AS date, CASE WHEN CAST(statement_id AS BIGINT) % 6 = 0 THEN abs(amount) ELSE amount END AS amount, CASE WHEN CAST(statement_id AS BIGINT) % 6 > 1 THEN balance END AS balance, flags FROM ledger),
f AS (SELECT statement_id, s, count(*) AS n, count(date) AS dated, count(balance) AS nb, count(*) FILTER (amount > 0) AS ins, count(*) FILTER (amount < 0) AS outs, count(*) FILTER (flags = 'redacted') AS red FROM l GROUP BY 1, 2)
SELECT statement_id, 'amount_direction' AS name, 'fail' AS status, CASE WHEN outs = 0 THEN 'all money-in' ELSE 'all money-out' END AS actual FROM f WHERE s % 9 <> 0 AND nb = 0 AND ins + outs >= 2 AND (ins = 0 OR outs = 0) UNION ALL
SELECT statement_id, 'dates_readable', CASE WHEN dated = n THEN 'pass' ELSE 'fail' END, CAST(dated AS VARCHAR) FROM f UNION ALL SELECT statement_id, 'redaction_summary', 'na', CAST(red AS VARCHAR) FROM f UNION ALL
SELECT statement_id, 'ocr_confidence', 'na', CAST(s % 5 AS VARCHAR) FROM f WHERE s % 5 > 0 UNION ALL SELECT statement_id, 'redaction_scan', 'fail', '2' FROM f WHERE s % 7 = 0""")
def reconcile_other_checks(spark, sf_dir):
    """The checks that a plain ledger doesn't raise: one-way amounts, unread dates, hidden rows, OCR pages, open scans."""
    k = F.col("statement_id").cast("long")
    rows = ledger(spark, sf_dir).withColumns({
        "date": F.when(F.col("o_orderkey") % 19 != 0, F.col("date")).otherwise("n/a"), "amount": F.when(k % 6 == 0, F.abs("amount")).otherwise(F.col("amount")), "balance": F.when(k % 6 > 1, F.col("balance")),
    })
    heads = ledger_headers(spark, sf_dir).withColumns({"ocr_pages": (k % 5).cast("int"), "redaction_scan_incomplete": F.when(k % 7 == 0, 2).otherwise(0), "amount_sign": F.when(k % 9 != 0, "signed").otherwise("dr_cr_suffix")})
    found = reconcile.reconcile(rows, heads).select("statement_id", F.explode_outer("kpis").alias("k"))
    return found.where(F.col("k.name").isin("amount_direction", "dates_readable", "redaction_summary", "ocr_confidence", "redaction_scan")).select("statement_id", "k.name", "k.status", "k.actual")


KNOWN = {
    "plain": {"id": "plain", "bank": "A", "statement_type": "x", "format": "delimited", "fingerprint": {"header_contains_all": ["Date", "Amount"]}, "min_score": 2},
    "memo": {"id": "memo", "bank": "A", "statement_type": "x", "format": "delimited", "fingerprint": {"header_contains_all": ["date", "amount", "memo"]}, "min_score": 3},
    "split": {"id": "split", "bank": "B", "statement_type": "x", "format": "delimited", "fingerprint": {"header_contains_all": ["Date", "Debit", "Credit"]}, "min_score": 3},
    "twin": {"id": "twin", "bank": "B", "statement_type": "x", "format": "delimited", "fingerprint": {"header_contains_all": ["Credit", "Date", "Debit"]}, "min_score": 3},
    "card": {"id": "card", "bank": "C", "statement_type": "x", "format": "delimited", "fingerprint": {"header_contains_all": ["Card", "When"]}, "min_score": 2},
    "own": {"id": "own", "bank": "B", "statement_type": "x", "format": "delimited", "fingerprint": {"header_contains_all": ["Date", "Amount"]}, "min_score": 2, "origin": "user"},
}


@query("""SELECT CAST(c_custkey AS VARCHAR) AS statement_id, CASE c_custkey % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'memo' WHEN 2 THEN 'split' WHEN 3 THEN 'memo' ELSE 'card' END AS template_id, c_custkey % 5 IN (0, 1, 4) AS matched, CASE c_custkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 END AS margin,
  CASE c_custkey % 5 WHEN 0 THEN 'own' WHEN 1 THEN 'plain' WHEN 2 THEN 'twin' WHEN 3 THEN 'card' END AS runner_up, CASE WHEN c_custkey % 5 = 2 THEN ['split', 'twin'] ELSE []::VARCHAR[] END AS tied FROM customer""")
def template_detection(spark, sf_dir):
    """Every file against every template: score, then origin, then file name; equals are ambiguous."""
    c = table(spark, sf_dir, "customer")
    cells = _case(F.col("c_custkey"), *(F.array(*map(F.lit, h)) for h in (["DATE ", "amount", "note"], ["Date", "Amount", "Memo"], ["date", "debit", "credit"], ["memo", "x", "y"], ["Card", "When"])))
    files = c.select(F.col("c_custkey").cast("string").alias("statement_id"), F.lit("delimited").alias("kind"), cells.alias("header_cells"), F.lit("").alias("page_text"), F.lit("/in/a.csv").alias("path"))
    found = detect.detect(files, frame(spark, KNOWN))
    return found.select("statement_id", "template_id", "matched", "margin", "runner_up", "tied")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS statement_id, CAST(r.rank AS INTEGER) AS rank, r.id AS template_id FROM customer, LATERAL (VALUES (1, CASE c_custkey % 2 WHEN 0 THEN 'plain' ELSE 'split' END), (2, CASE c_custkey % 2 WHEN 0 THEN 'own' ELSE 'twin' END)) r(rank, id)""")
def ranked_templates(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cells = _case(F.col("c_custkey"), F.array(F.lit("date"), F.lit("amount")), F.array(F.lit("date"), F.lit("debit"), F.lit("credit")))
    files = c.select(F.col("c_custkey").cast("string").alias("statement_id"), F.lit("delimited").alias("kind"), cells.alias("header_cells"), F.lit("").alias("page_text"), F.lit("a.csv").alias("path"))
    known = {k: t for k, t in KNOWN.items() if k != "memo"}
    return detect.ranked(detect.scored(files, frame(spark, known))).where("rank <= 2").select("statement_id", "rank", "template_id")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS statement_id, CASE c_custkey % 4 WHEN 0 THEN 'no_rows' WHEN 1 THEN 'redaction' WHEN 2 THEN 'unknown_format' ELSE 'never heard of' END AS category, CASE c_custkey % 4 WHEN 1 THEN 'info' WHEN 3 THEN 'medium' ELSE 'high' END AS severity,
  CASE c_custkey % 4 WHEN 1 THEN 'none' WHEN 3 THEN 'escalate' ELSE 'template' END AS fix_owner FROM customer""")
def diagnostics_described(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("statement_id"), _case(F.col("c_custkey"), F.lit("no_rows"), F.lit("redaction"), F.lit("unknown_format"), F.lit("never heard of")).alias("category"), F.lit("x").alias("where"), F.lit("y").alias("detail"))
    return diagnostics.described(rows).select("statement_id", "category", "severity", "fix_owner")


@query(f"""WITH {RUNS} SELECT CAST(user_id AS VARCHAR) AS statement_id, ['low', 'medium', 'high'][CAST(min(CASE trust_level WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS INTEGER)] AS trust_level, min(CAST(trunc(value) AS INTEGER)) AS score, bool_and(status = 'ok') AS completeness_verified, count(*) AS statements FROM runs GROUP BY 1""")
def weakest_trust(spark, sf_dir):
    r = runs(spark, sf_dir)
    return split.weakest(r.select(F.col("user_id").cast("string").alias("statement_id"), "trust_level", F.col("value").cast("int").alias("score"), (F.col("status") == "ok").alias("completeness_verified")))


@query(f"""WITH {RUNS}, p AS (SELECT CAST(user_id AS VARCHAR) AS statement_id, count(*) AS k, bool_and(trust_level <> 'low') AS sound FROM runs GROUP BY 1) SELECT statement_id, k, k >= 2 AND k % 2 = 0 AND sound AS split FROM p""")
def committed_splits(spark, sf_dir):
    """A bundle is split only if another count agrees and every part stands up."""
    r = runs(spark, sf_dir)
    parts = r.select(F.col("user_id").cast("string").alias("statement_id"), F.col("run_id").alias("segment"), F.lit(3).alias("rows"), "trust_level")
    counted = parts.groupBy("statement_id").agg(F.count("*").alias("k")).select("statement_id", F.when(F.col("k") % 2 == 0, F.col("k")).otherwise(F.lit(0)).alias("structural"))
    return split.committed(parts, counted)


@query(f"""WITH {RUNS} SELECT CAST(user_id AS VARCHAR) AS upload_id, max_by(status, ts || run_id) AS status, max(ts) AS ts, count(*) AS steps FROM runs GROUP BY 1""")
def upload_states(spark, sf_dir):
    r = runs(spark, sf_dir)
    history = r.select(F.col("user_id").cast("string").alias("upload_id"), F.concat("ts", "run_id").alias("ts"), "status")
    return retention.current_state(history).select("upload_id", "status", F.substring("ts", 1, 19).alias("ts"), F.size(F.split("history", "; ")).cast("long").alias("steps"))


@query(f"""WITH {LEDGER}, h AS (SELECT statement_id, row_id, CASE WHEN amount < 0 THEN -amount END AS debit, CASE WHEN amount > 0 THEN amount END AS credit, CAST(NULL AS VARCHAR) AS bank, flags FROM ledger) SELECT CAST(row_id AS VARCHAR) || '/' || statement_id AS run_id, debit, credit, bank, flags FROM h""")
def feed_core_rows(spark, sf_dir):
    """The feed's thirty columns: amounts split by side, what is missing null."""
    rows = ledger(spark, sf_dir).withColumn("run_id", F.concat(F.col("row_id").cast("string"), F.lit("/"), "statement_id"))
    out = feed.core_frame(rows)
    assert len(out.columns) == 30
    return out.select("run_id", "debit", "credit", "bank", "flags")


@query(f"""WITH {LEDGER} SELECT statement_id, row_id, amount, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS debit, CASE WHEN o_orderkey % 3 <> 0 THEN 'c' END AS credit, CASE WHEN o_orderkey % 2 = 0 THEN '''=1+' || o_orderkey ELSE 'plain' END AS description, CASE WHEN o_orderkey % 5 = 0 THEN '''@x' END AS fx FROM ledger""")
def display_rows(spark, sf_dir):
    """What a reader sees: no raw columns, debit and credit beside amount, no cell that acts as a formula."""
    k = F.col("o_orderkey")
    extras = F.map_filter(F.create_map(F.lit("debit"), F.when(k % 3 == 0, k.cast("string")), F.lit("credit"), F.when(k % 3 != 0, "c"), F.lit("fx"), F.when(k % 5 == 0, "@x")), lambda _, v: v.isNotNull())
    rows = ledger(spark, sf_dir).withColumns({"description": F.when(k % 2 == 0, F.concat(F.lit("=1+"), k.cast("string"))).otherwise("plain"), "extras": extras, "amount_raw": F.lit("1")})
    return outputs.display(rows, ("debit", "credit", "fx")).select("statement_id", "row_id", "amount", "debit", "credit", "description", "fx")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS statement_id, v.field, v.value FROM customer, LATERAL (VALUES ('c_name', c_name), ('c_nationkey', CAST(c_nationkey AS VARCHAR)), ('c_mktsegment', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END)) v(field, value)""")
def stacked_headers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return outputs.stacked(c.select(F.col("c_custkey").cast("string").alias("statement_id"), "c_name", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("c_mktsegment")))


@query(f"""WITH {LEDGER}, f AS (SELECT statement_id, count(*) FILTER (flags = 'redacted') AS r, count(*) FILTER (flags = 'malformed') AS m, count(*) AS n FROM ledger GROUP BY 1) SELECT statement_id, CAST(n AS INTEGER) AS row_count, CASE WHEN r > 0 THEN r END AS redacted, CASE WHEN m > 0 THEN m END AS malformed FROM f""")
def captured_facts(spark, sf_dir):
    """Content-free facts about each statement."""
    rows = ledger(spark, sf_dir).withColumn("description", F.lit("x"))
    results = rows.groupBy("statement_id").agg(F.count("*").cast("int").alias("row_count")).select("statement_id", F.lit("t").alias("template_id"), F.lit("ok").alias("status"), F.lit("high").alias("trust_level"), "row_count")
    out = metadata.capture(rows, results, "full")
    return out.select("statement_id", "row_count", F.try_element_at("flags", F.lit("redacted")).alias("redacted"), F.try_element_at("flags", F.lit("malformed")).alias("malformed"))


@query(f"""WITH {LEDGER}, a AS (SELECT statement_id, list_sort(list_distinct(list(CASE o_orderkey % 3 WHEN 0 THEN '12-3456-1234567-00' WHEN 1 THEN '01-0234-123456-001' END) FILTER (o_orderkey % 3 < 2))) AS l FROM ledger GROUP BY 1)
SELECT statement_id, CAST(coalesce(len(l), 0) AS INTEGER) AS n_accounts, CASE WHEN len(l) > 0 THEN substr(sha256(array_to_string(l, '|')), 1, 16) END AS account_hash FROM a""")
def account_digests(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("description", _case(F.col("o_orderkey"), F.lit("to 12-3456-1234567-00"), F.lit("from 01-0234-123456-001 x"), F.lit("cash")))
    return metadata.accounts(rows, labels.DEFAULTS["account_regex"])


@query("""SELECT CAST(o_custkey AS VARCHAR) AS statement_id, CAST(o_orderkey % 2 AS INTEGER) AS page, count(*) FILTER (o_orderkey % 4 < 2) AS kept, count(*) FILTER (o_orderkey % 4 = 2) AS summary_line, 0 AS heading_or_note, count(*) FILTER (o_orderkey % 4 = 3) AS date_unparsed, 0 AS amount_missing FROM orders GROUP BY 1, 2""")
def page_coverage(spark, sf_dir):
    """Rows of each page by what became of them."""
    o = table(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderkey") % 4 < 2, "kept").when(F.col("o_orderkey") % 4 == 2, "summary_line").otherwise("date_unparsed")
    return profile.row_coverage(o.select(F.col("o_custkey").cast("string").alias("statement_id"), (F.col("o_orderkey") % 2).cast("int").alias("page"), code.alias("code")))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS statement_id, c_custkey % 3 = 1 AS backwards, CASE c_custkey % 3 WHEN 0 THEN '2023,2024' WHEN 1 THEN '2024,2023' ELSE '2022' END AS years FROM customer""")
def year_contexts(spark, sf_dir):
    """The years that a statement's dates may lie in: of its period, else of its own date; and periods that run backwards."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    heads = c.select(F.col("c_custkey").cast("string").alias("statement_id"), F.when(k == 0, "15 Dec 2023").when(k == 1, "2024-01-31").alias("period_start"), F.when(k == 0, "14 Jan 24").when(k == 1, "01/12/2023").alias("period_end"), F.lit("3 Mar 2022").alias("statement_date"))
    return pdf_table.year_context(heads).select("statement_id", F.coalesce(F.col("pe") < F.col("ps"), F.lit(False)).alias("backwards"), F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS statement_id, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS first_pages, o_orderkey % 3 = 1 AS multiple FROM orders""")
def several_statements(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    rows = o.select(F.col("o_orderkey").cast("string").alias("statement_id"), F.explode(F.when(k == 0, F.array(F.lit("opening balance"))).when(k == 1, F.array(F.lit("Page 1 of 2"), F.lit("page 1 of 3"))).otherwise(F.array(F.lit("Page 1 of 2"), F.lit("Page 12 of 20")))).alias("text"))
    return labels.multiple_statements(rows).select("statement_id", "first_pages", "multiple")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS statement_id, v.field, v.value, v.matched, v.flagged FROM customer, LATERAL (VALUES ('member', 'M' || c_custkey, true, false), ('fund', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, c_custkey % 2 = 0, c_custkey % 2 = 1), ('note', NULL, false, false)) v(field, value, matched, flagged)""")
def form_values(spark, sf_dir):
    """Key and value pairs of forms, required ones flagged where they are missing."""
    c = table(spark, sf_dir, "customer")
    own = F.array_compact(F.array(F.concat(F.lit("Member number: M"), F.col("c_custkey").cast("string")), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Fund name - "), F.col("c_mktsegment")))))
    rows = c.select(F.col("c_custkey").cast("string").alias("statement_id"), F.posexplode(own).alias("at", "text")).select("statement_id", F.lit(1).alias("page"), (F.col("at") + 1).alias("line_no"), "text")
    fields = {"member": {"any_of": ["member number"], "value": "text", "required": True}, "fund": {"any_of": ["fund name"], "value": "text", "required": True}, "note": {"any_of": ["remark"], "value": "text"}}
    return labels.form_fields(rows, fields).select("statement_id", "field", "value", "matched", "flagged")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM (SELECT o_orderstatus, o_orderpriority FROM orders INTERSECT SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1, 2""")
def common_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    both = o.drop("o_orderkey").intersect(o.where("o_orderkey % 2 = 0").drop("o_orderkey"))
    return both.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT source, min(length(text)) AS shortest, CAST(floor(median(length(text))) AS INTEGER) AS middle, max(length(text)) AS longest, round_even(avg(length(text)), 1) AS mean FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def description_lengths(spark, sf_dir):
    return length_stats(table(spark, sf_dir, "documents"), "text", "source")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS statement_id, CASE c_custkey % 4 WHEN 0 THEN 'long' WHEN 1 THEN 'short' WHEN 2 THEN 'other' END AS form, c_custkey % 4 < 2 AS matched FROM customer""")
def form_detection(spark, sf_dir):
    """The most specific form whose phrases all stand in the text; equals are left to a person."""
    c = table(spark, sf_dir, "customer")
    body = _case(F.col("c_custkey"), F.lit("Annual notice\nMember\nFund A"), F.lit("Annual notice\nMember"), F.lit("Twin\nPair"), F.lit("nothing"))
    rows = c.select(F.col("c_custkey").cast("string").alias("statement_id"), F.posexplode(F.split(body, "\n")).alias("at", "text")).select("statement_id", F.lit(1).alias("page"), F.col("at").alias("line_no"), "text")
    return labels.detect_form(rows, {"short": ["Annual notice", "Member"], "long": ["Annual notice", "Member", "Fund A"], "twin": ["Twin", "Pair"], "other": ["Pair", "Twin"]})


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS statement_id, CAST(o_totalprice AS DOUBLE) AS opening_balance, 7.0::DOUBLE AS closing_balance, strftime(o_orderdate, '%d/%m/%Y') AS period_start FROM orders""")
def header_pins(spark, sf_dir):
    """Values that a drawn box gives win over those read, but only where there are any."""
    found = pdf_table.pinned(page_words(spark, sf_dir), {"opening_balance": {"page": 1, "x_min": 305, "x_max": 400, "y_min": 100, "y_max": 115.5}, "closing_balance": {"page": 1, "x_min": 405, "x_max": 500, "y_min": 100, "y_max": 120}, "period_start": {"page": 1, "x_min": 0, "x_max": 90, "y_min": 100, "y_max": 110}})
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("statement_id"), F.lit(1.0).alias("opening_balance"), F.lit(7.0).alias("closing_balance"), F.lit("unread").alias("period_start"))
    return pdf_table.with_pins(heads, found)


@query("""SELECT o_custkey, CASE WHEN count(*) = 1 THEN 'row ' ELSE 'rows ' END || array_to_string(list_sort(list(o_orderkey))[1:10], ', ') || CASE WHEN count(*) > 10 THEN ' and ' || (count(*) - 10) || ' more' ELSE '' END AS listed FROM orders GROUP BY 1 UNION ALL
  SELECT c_custkey, 'no row identified' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def row_lists(spark, sf_dir):
    """Rows named in a check's detail: ten at most, and how many more."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("r"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).join(o, "o_custkey", "left").withColumn("r", F.coalesce("r", F.array().cast("array<bigint>")))
    return rows.select("o_custkey", reconcile.row_list(F.col("r"), F.size("r")).alias("listed"))


@query(f"""WITH {LEDGER} SELECT statement_id, concat_ws(',', 'balance_reconciliation', 'running_balance_continuity', 'transaction_count', 'dates_within_period', 'dates_readable', 'no_unparsed_rows', 'redaction_summary') AS checks, count(*) AS n FROM ledger GROUP BY 1""")
def check_order(spark, sf_dir):
    """The checks of a plain ledger in report order; those that don't apply leave no gap."""
    found = reconcile.reconcile(ledger(spark, sf_dir), ledger_headers(spark, sf_dir))
    return found.select("statement_id", F.array_join(F.transform("kpis", lambda k: k["name"]), ",").alias("checks"), "n")


@query(f"""WITH {RUNS} SELECT run_id, status || ' [statement ' || (user_id % 3 + 1) || ']' AS name FROM runs""")
def tagged_checks(spark, sf_dir):
    """Checks of a bundle's parts in one list, each with its statement's number."""
    r = runs(spark, sf_dir)
    return split.tagged(r.select("run_id", F.col("status").alias("name"), (F.col("user_id") % 3 + 1).alias("segment"))).select("run_id", "name")


def _checked(spark, sf_dir):
    """Ledgers with two plain checks each, as a reconciliation gives them."""
    k = F.col("statement_id").cast("long")
    kpi = lambda name, status: F.struct(F.lit(name).alias("name"), status.alias("status"))
    rows = ledger(spark, sf_dir)
    kpis = F.array(kpi("first", F.when(k % 3 == 0, "fail").otherwise("pass")), kpi("second", F.when(k % 2 == 0, "fail").otherwise("pass")))
    return rows, rows.groupBy("statement_id").agg(F.count("*").alias("row_count")).select("statement_id", "row_count", kpis.alias("kpis"), F.lit("low").alias("trust_level"))


@query(f"""WITH {LEDGER} SELECT statement_id, count(*) AS row_count, 'ok' AS status, CASE WHEN CAST(statement_id AS BIGINT) % 3 = 0 THEN 'first' WHEN CAST(statement_id AS BIGINT) % 2 = 0 THEN 'second' END AS failing_check FROM ledger GROUP BY 1""")
def batch_audits(spark, sf_dir):
    """One row per file with the first check that fails."""
    _, found = _checked(spark, sf_dir)
    results = found.select("statement_id", F.lit("t").alias("template_id"), F.lit("ok").alias("status"), "row_count", "trust_level")
    return metadata.batch_audit(results, found).select("statement_id", "row_count", "status", "failing_check")


@query(f"""WITH {LEDGER} SELECT statement_id, row_id, '9999-99-99' AS date_shape, regexp_replace(format('{{:.2f}}', "full"), '[0-9]', '9', 'g') AS amount_shape, 'Xxxxx ' || regexp_replace(CAST(o_orderkey AS VARCHAR), '[0-9]', '9', 'g') AS description_shape,
  CASE WHEN CAST(statement_id AS BIGINT) % 3 = 0 THEN 'fail' ELSE 'pass' END AS first FROM (SELECT l.*, z."full" FROM ledger l JOIN ledger0 z USING (statement_id, row_id))""")
def statement_audits(spark, sf_dir):
    """Masked rows beside their statement's checks."""
    rows, found = _checked(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%.2f", F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))).alias("amount_raw"))
    tx = rows.join(o, "o_orderkey").withColumns({"date_raw": F.col("date"), "description": F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))})
    return metadata.statement_audit(tx, found).select("statement_id", "row_id", "date_shape", "amount_shape", "description_shape", F.col("checks")["first"].alias("first"))


@query(f"""WITH {LEDGER} SELECT statement_id, 'Example' AS bank, CAST(count(*) AS INTEGER) AS n, CAST(min(row_id) AS INTEGER) AS first_row, bool_or(amount IS NULL) AS hidden FROM ledger GROUP BY 1""")
def json_fields(spark, sf_dir):
    """What a statement's whole record says, read back from its JSON, nulls included."""
    rows = ledger(spark, sf_dir).select("statement_id", "row_id", "date", "amount", "balance")
    heads = rows.select("statement_id").distinct().withColumn("bank", F.lit("Example"))
    found = heads.select("statement_id", F.array().cast("array<string>").alias("kpis"), F.lit("low").alias("trust_level"), F.lit(0).alias("score"), F.array().cast("array<string>").alias("reasons"), F.lit(False).alias("completeness_verified"))
    record = F.from_json("record", "header struct<bank:string>, transactions array<struct<row_id:int,amount:double>>")
    out = outputs.json_records(rows, found, heads).select("statement_id", record.alias("r"), F.col("record").contains('"amount":null').alias("hidden"))
    return out.select("statement_id", "r.header.bank", F.size("r.transactions").alias("n"), F.get("r.transactions", F.lit(0))["row_id"].alias("first_row"), "hidden")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'unsupported' WHEN c_custkey % 3 = 0 OR c_custkey % 7 = 0 THEN 'needs_review' ELSE 'ok' END AS status FROM customer""")
def run_statuses(spark, sf_dir):
    """The status of a conversion by the first rule that applies."""
    from ..engine import status

    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select("c_custkey", status(k % 10 != 0, F.when(k % 5 == 0, 0).otherwise(3), F.lit("high"), F.when(k % 3 == 0, 1).otherwise(0), F.lit(4.0), k % 7 == 0).alias("status"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS started, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2""")
def status_by_hour(spark, sf_dir):
    """Tumbling windows over run records; on a stream the same with a watermark."""
    e = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("status"))
    return intake.status_windows(e).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "status", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, no""")
def sessions_by_user(spark, sf_dir):
    return intake.user_sessions(table(spark, sf_dir, "events")).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query(f"""WITH {RUNS}, k AS (SELECT *, CAST(user_id AS VARCHAR) AS feed_key FROM runs), m AS (SELECT feed_key, max(ts || status) AS newest FROM k GROUP BY 1) SELECT feed_key, status, count(*) AS n FROM k JOIN m USING (feed_key) WHERE ts || status = newest GROUP BY 1, 2""")
def newest_runs(spark, sf_dir):
    """All rows of the newest run of each content key."""
    r = runs(spark, sf_dir).select(F.col("user_id").cast("string").alias("feed_key"), F.col("ts").alias("converted_ts"), F.col("status").alias("run_id"))
    return feed.newest_run(r).groupBy("feed_key", F.col("run_id").alias("status")).agg(F.count("*").alias("n"))


def _event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: a stream takes a file by itself for a folder


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS file, ['inbox', 'processing', 'processed', 'failed'][event_id % 4 + 1] AS state, event_id % 4 AS k, ts FROM events), m AS (SELECT max(epoch_us(ts) // 1000) - 600000 AS mark FROM e),
l AS (SELECT file, max_by(state, (epoch_us(ts) // 1000, k)) AS state, max(epoch_us(ts) // 1000) AS since FROM e GROUP BY 1)
SELECT file, CASE WHEN state IN ('inbox', 'processing') AND since + 1800000 < mark THEN 'stuck' ELSE state END AS state, since + CASE WHEN state IN ('inbox', 'processing') AND since + 1800000 < mark THEN 1800000 ELSE 0 END AS at_ms FROM l, m""")
def intake_states(spark, sf_dir):
    """A stream of file events, run until it is drained: the last state of every file, stuck ones by their timers."""
    e = _event_stream(spark, sf_dir)
    k = (F.col("event_id") % 4).cast("int")
    state = F.element_at(F.array(*map(F.lit, intake.STATES)), k + 1)
    rows = intake.drained(intake.file_states(e.select(F.col("user_id").cast("string").alias("file"), state.alias("state"), F.col("ts").cast("timestamp").alias("at"))), "states")
    last = rows.groupBy("file").agg(F.max_by("state", F.struct("at", (F.col("state") == "stuck").cast("int"))).alias("state"), F.max("at").alias("at"))
    return last.select("file", "state", F.unix_millis("at").alias("at_ms"))


@query("""WITH r AS (SELECT event_id AS k, ts, user_id FROM events), f AS (SELECT event_id AS k, ts + to_minutes(CAST((event_id % 9 - 1) * 10 AS INTEGER)) AS said, event_type AS verdict FROM events WHERE event_id % 3 = 0)
SELECT CAST(r.k AS VARCHAR) AS run_id, r.user_id, verdict, date_diff('minute', r.ts, said) AS minutes FROM r JOIN f ON r.k = f.k AND said BETWEEN r.ts AND r.ts + INTERVAL 1 HOUR""")
def runs_answered(spark, sf_dir):
    """Two streams, runs and feedback, joined within an hour of the run."""
    k = F.col("event_id")
    left = _event_stream(spark, sf_dir).select(k.cast("string").alias("run_id"), "user_id", F.col("ts").cast("timestamp").alias("at"))
    said = F.timestamp_add("MINUTE", ((k % 9 - 1) * 10).cast("int"), F.col("ts").cast("timestamp"))
    right = _event_stream(spark, sf_dir).where(k % 3 == 0).select(k.cast("string").alias("run_id"), said.alias("said_at"), F.col("event_type").alias("verdict"))
    rows = intake.drained(intake.answered(left, right), "answered")
    return rows.select("run_id", "user_id", "verdict", F.timestamp_diff("MINUTE", F.col("at"), F.col("said_at")).alias("minutes"))
