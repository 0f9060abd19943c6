"""Facts above tables, header names, several periods, bundles and places of values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_frontdoor import CSV, PAGE, page_reader

from tallyforge import engine
from tallyforge.operators import facts, split
from tallyforge.sources import delimited

LINES = "statement_id string, page int, line_no int, text string"


def test_header_names(spark):
    rows = [("Date,Memo,Amount,Ref,Ref",), ('"Date",Memo , Amount,,',), ("a,a,a.1,a",), ("",), (None,)]
    got = spark.createDataFrame(rows, "h string").select(delimited.unique_names(delimited.header_cells(F.col("h"), F.lit(","))).alias("n"))
    assert [r["n"] for r in got.collect()] == [["Date", "Memo", "Amount", "Ref", "Ref.1"], ["Date", "Memo", "Amount", "col4", "col5"], ["a", "a.1", "a.1.1", "a.2"], ["col1"], None]


def statement(*sections, first="Example"):
    out = [first]
    for period, account, opening, closing in sections:
        out += [f"Statement period {period}", f"Account number {account}", *([f"Opening balance {opening}"] if opening else []), *([f"Closing balance {closing}"] if closing else [])]
    return out


A, B = "12-3456-0000001-00", "12-3456-0000002-00"
JAN, FEB, MAR = "01/01/2024 to 31/01/2024", "01/02/2024 to 29/02/2024", "01/03/2024 to 31/03/2024"
CASES = {
    "one": (statement((JAN, A, "1.00", "2.00")), (1, False, None)),
    "joined": (statement((FEB, A, "2.00", "-3.00"), (JAN, A, "1.00", "2.00")), (2, True, None)),
    "shared": (statement((JAN, A, "1.00", "2.00"), ("31/01/2024 - 29/02/2024", A, "2.00", "3.00")), (2, True, None)),
    "gap": (statement((JAN, A, "1.00", "2.00"), (MAR, A, "2.00", "3.00")), (2, True, None)),
    "twice": (statement((JAN, A, "1.00", "2.00"), ("1 Jan 2024 to 31 Jan 2024", A, None, None)), (1, False, None)),
    "chain": (statement((JAN, A, "1.00", "2.00"), (FEB, A, "2.01", "3.00")), (2, False, "chain")),
    "overlap": (statement((JAN, A, "1.00", "2.00"), ("30/01/2024 to 29/02/2024", A, "2.00", "3.00")), (2, False, "overlap")),
    "accounts": (statement((JAN, A, "0.00", "0.00"), (FEB, B, "0.00", "0.00")), (2, False, "accounts")),
    "balances": (statement((JAN, A, "1.00", "2.00"), (FEB, A, "2.00", None)), (2, False, "balances")),
    "unreadable": (statement((JAN, A, "1.00", "2.00"), ("01/13/2024 to 45/13/2024", A, "2.00", "3.00")), (None, False, "unreadable")),
    "backwards": (statement((JAN, A, "1.00", "2.00"), ("29/02/2024 to 01/02/2024", A, "2.00", "3.00")), (None, False, "unreadable")),
    "sections": (statement((JAN, A, "1.00", "2.00"), first=f"See {MAR} and {FEB}"), (3, False, "sections")),
}


def test_spans(spark):
    rows = [(k, 1 + i // 4, i, t) for k, (lines, _) in CASES.items() for i, t in enumerate(lines)] + [("none", 1, 1, "no period"), ("null", 1, 1, None)]
    got = {r["statement_id"]: r for r in facts.spans(spark.createDataFrame(rows, LINES)).collect()}
    assert {k: (r["n_periods"], r["merged"], r["reason"]) for k, r in got.items()} == {k: want for k, (_, want) in CASES.items()}
    assert (got["joined"]["period_start"], got["joined"]["period_end"], got["joined"]["opening_balance"], got["joined"]["closing_balance"]) == ("01/01/2024", "29/02/2024", "1.00", "-3.00")
    assert got["gap"]["gaps"] == ["2024-02-01 to 2024-02-29"] and got["chain"]["period_start"] == "01/01/2024" and got["chain"]["opening_balance"] is None
    assert facts.spans(spark.createDataFrame([], LINES)).count() == 0


def test_located(spark):
    words = spark.createDataFrame(
        [("s", 1, i, float(x), float(y), 10.0, 5.0, t) for i, (x, y, t) in enumerate([(0, 0, "Opening"), (20, 1, "balance"), (40, 0, "1,200.00"), (0, 20, "balance"), (20, 20, "1,200.00"), (40, 20, None)])] + [("s", 2, 0, 1.0, 1.0, 9.0, 9.0, "Balance")],
        "statement_id string, page int, word_idx int, x double, y double, width double, height double, text string",
    )
    wanted = [("s", "run", " Balance  1,200.00"), ("s", "part", "200"), ("s", "none", "balance opening"), ("s", "blank", "  "), ("s", "null", None), ("t", "run", "x")]
    got = {(r["statement_id"], r["field"]): tuple(r)[3:] for r in facts.located(words, spark.createDataFrame(wanted, "statement_id string, field string, value string")).collect()}
    assert got == {("s", "run"): (1, True, 20.0, 0.0, 50.0, 6.0, 2), ("s", "part"): (1, True, 40.0, 0.0, 50.0, 5.0, 2), ("s", "none"): (None, False, None, None, None, None, 0), ("t", "run"): (None, False, None, None, None, None, 0)}


def test_candidates(spark):
    one = lambda n, extra=True: [f"Page 1 of {n}", *([f"Opening balance {n}.00", f"Closing balance {n}.00"] if extra else [])]
    files = {"bundle": [one(1), one(2), ["more"]], "single": [one(1), ["more"]], "alone": [one(1, False), one(1, False)], "cover": [["cover"], one(1), one(1)], "off": [one(1), one(1)]}
    rows = [(k, p + 1, i, t) for k, pages in files.items() for p, lines in enumerate(pages) for i, t in enumerate(lines)]
    rules = [(k, "page1_marker", 2) for k in files if k != "off"]
    got = split.candidates(spark.createDataFrame(rows, LINES), spark.createDataFrame(rules, "statement_id string, on string, least int")).collect()
    # a cover page is a part of its own by the marker, so three parts and two blocks of balances do not agree
    assert sorted((r["statement_id"], r["segment"], r["first_page"], r["last_page"]) for r in got) == [("bundle", 1, 1, 1), ("bundle", 2, 2, 3)]
    assert split.settings({"split": False}) is None and split.settings({}) == {"on": "page1_marker", "least": 2} == split.settings({"split": {"on": "odd", "min_statements": 1}})


@pytest.mark.parametrize("periods,want", [([JAN, FEB], ("01/01/2024", "29/02/2024", None)), ([MAR, JAN], (None, None, "no statement covers 2024-02-01 to 2024-02-29")), ([JAN, "15/01/2024 to 29/02/2024"], (None, None, "overlap")), ([JAN, "x to y"], (None, None, "unreadable"))])
def test_bundle_period(spark, periods, want):
    rows = [("s", i, *p.split(" to ")) for i, p in enumerate(reversed(periods))]
    got = split.bundle_period(spark.createDataFrame(rows, "statement_id string, segment int, period_start string, period_end string")).first()
    assert tuple(got)[1:] == want


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "good.csv").write_text('Example\nAccount number,12-3456-0000001-00\nPeriod,01/01/2024 to 31/01/2024\n"Opening balance","1,000.00"\nClosing balance;1003.00\n\nDate,Memo,Amount\n2024-01-01,Opening balance 77.00,5.00\n2024-01-02,two,-2.00\n')
    (tmp_path / "twice.csv").write_text("Date,Memo,Amount,Ref,Ref\n2024-01-01,one,5.00,a,b\n")
    (tmp_path / "blank.csv").write_text("Date,Memo,Amount,,\n2024-01-01,one,6.00,a,b\n")
    page = lambda p, a, b, c: "".join(f"{x} {y + 1000 * p} {t}\n" for x, y, t in [(10, 10, "Sample"), (60, 10, "Bank"), (310, 20, "Amount"), (10, 30, "Page 1 of 1"), (10, 40, f"Opening balance {a}"), (10, 50, f"Closing balance {b}"), (10, 100, f"0{p + 1}/02/2024"), (110, 100, "Shop"), (310, 100, c)])
    (tmp_path / "b.pdf").write_text(page(0, "10.00", "22.50", "12.50") + page(1, "22.50", "20.00", "-2.50"))

    reader = page_reader()

    def paged(content: bytes):
        rows = reader(content)
        return rows.assign(page=(rows["y"] // 1000 + 1).astype(int), y=rows["y"] % 1000)

    csv = {**CSV, "preamble": {"header_regex": "^Date,"}}
    found = engine.convert(spark, str(tmp_path), {t["id"]: t for t in (csv, PAGE)}, reader=paged)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in found.results.collect()}
    assert {n: (r["status"], r["row_count"]) for n, r in rows.items()} == {"good.csv": ("ok", 2), "twice.csv": ("ok", 1), "blank.csv": ("ok", 1), "b.pdf": ("ok", 2)}
    checks = {(r["statement_id"], k["name"]): k["status"] for r in found.reconciled.collect() for k in r["kpis"]}
    good, both = rows["good.csv"]["statement_id"], rows["b.pdf"]["statement_id"]
    assert checks[good, "balance_reconciliation"] == checks[good, "dates_within_period"] == "pass"
    assert checks[both, "balance_reconciliation [statement 1]"] == checks[both, "balance_reconciliation [statement 2]"] == "pass"
    assert [(r["statement_index"], r["pages"], r["opening_balance"], r["closing_balance"]) for r in found.statements.orderBy("statement_index").collect()] == [(1, "1-1", 10.0, 22.5), (2, "2-2", 22.5, 20.0)]
    assert [(r["row_id"], r["statement_index"], r["amount"]) for r in found.transactions.where(F.col("statement_id") == both).orderBy("row_id").collect()] == [(1, 1, 12.5), (2, 2, -2.5)]


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    found = engine.convert(spark, str(tmp_path), {PAGE["id"]: PAGE})
    assert [r["status"] for r in found.results.collect()] == ["unsupported"] and found.transactions.count() == 0


def test_preambles_are_read_once(spark, tmp_path):
    """Each label read the files anew: a plan of dozens of copies of the source, held by the driver."""
    from tallyforge.plans import printed

    spark.range(8).selectExpr("id as c_custkey", "cast(id * 100.5 as double) as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    found = printed.preamble_facts(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Example Bank") == 0
    assert sorted(r["statement_id"] for r in found.where("account_number is null").collect()) == ["1", "5"]


def test_header_facts_sort_the_lines_once(spark):
    """Each label sorted all lines of all documents to find the next line."""
    from tallyforge.operators import labels

    lines = spark.createDataFrame([("a", 1, 1, "Opening balance"), ("a", 1, 2, "12.50"), ("a", 1, 3, "plain"), ("b", 1, 1, "Closing balance 7.00"), ("c", 1, 1, "none")], "statement_id string, page int, line_no int, text string")
    found = labels.header_facts(lines)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(" not in plan
    assert {r["statement_id"]: (r["opening_balance"], r["closing_balance"]) for r in found.collect()} == {"a": ("12.50", None), "b": (None, "7.00"), "c": (None, None)}


def bundle(key, *parts):
    """Words of a file with a page for each of `parts`: opening balance, closing balance, rows."""
    out = []
    for p, (opening, closing, rows) in enumerate(parts):
        texts = [(10, 10, "Sample Bank"), (10, 30, "Page 1 of 1"), (10, 50, f"Opening balance {opening}"), (10, 70, f"Closing balance {closing}")]
        texts += [(x, 100 + 20 * i, t) for i, row in enumerate(rows) for x, t in zip((10, 110, 310), row)]
        out += [(key, p + 1, i, float(x), float(y), 30.0, 10.0, t, False, None) for i, (x, y, t) in enumerate(texts)]
    return out


def test_bundles_are_read_whole_only_where_a_part_is_empty(spark, monkeypatch):
    """Every bundle was read twice, as a whole and by its parts, and its rows were worked out again for the counters."""
    from tallyforge.operators import pdf_table
    from tallyforge.plans import printed
    from tallyforge.schema import WORDS

    good = bundle("good", ("1.00", "3.00", [("01/02/2024", "a", "2.00")]), ("3.00", "7.00", [("02/02/2024", "b", "4.00")]))
    half = bundle("half", ("1.00", "3.00", [("01/02/2024", "c", "2.00")]), ("3.00", "3.00", []))
    seen, plain = [], pdf_table.transactions
    monkeypatch.setattr(pdf_table, "transactions", lambda words, *more: seen.append({r[0] for r in words.select("statement_id").distinct().collect()}) or plain(words, *more))
    found = engine.convert_words(spark, spark.createDataFrame(good + half, WORDS), {"bundle": printed.BUNDLE})
    assert seen == [{f"{k}{split.CUT}{n}" for k in ("good", "half") for n in (1, 2)}, {"half"}]
    assert sorted((r["statement_id"], r["row_id"], r["statement_index"], r["amount"]) for r in found.transactions.collect()) == [("good", 1, 1, 2.0), ("good", 2, 2, 4.0), ("half", 1, None, 2.0)]
    assert sorted((r["statement_id"], r["statement_index"]) for r in found.statements.collect()) == [("good", 1), ("good", 2)]
    assert {r["statement_id"]: r["row_count"] for r in found.results.collect()} == {"good": 2, "half": 1}


def test_pages_in_order_pass_as_they_are(spark, monkeypatch):
    """Every row of every page became a dictionary, also where nothing can be joined or merged."""
    import random

    from tallyforge.operators import pdf_table

    r, rows = random.Random(4), []
    for p in range(60):
        for i in range(6):
            whole = p % 3 == 0 and i > 1
            cell = {"date": "01/02/2024" if whole else r.choice([None, "", "01/02/2024"]) if p % 3 else None, "amount": "5.00" if whole else r.choice([None, "7.00", "CR", " "]), "description": r.choice([None, "text", "Closing balance"]) if p % 3 else "text"}
            rows.append(("s", p, i, *(cell.get(c) for c in pdf_table.CELLS), f"raw {i}", 10.0 * i, 10.0 * i + 8, 8.0, None))
    schema = "statement_id string, page int, row int, " + ", ".join(f"{c} string" for c in pdf_table.CELLS) + ", raw string, y0 double, y1 double, h double, conf double"
    pages = spark.createDataFrame(rows, schema)
    ordered = {r["page"] for r in pages.withColumn("noise", F.lit(False)).withColumn("in_order", pdf_table.in_order()).where("in_order").collect()}
    assert {p for p in range(60) if p % 3 == 0} <= ordered
    got = sorted(map(repr, pdf_table.assembled(pages).collect()))
    monkeypatch.setattr(pdf_table, "in_order", lambda: F.lit(False))
    assert got == sorted(map(repr, pdf_table.assembled(pages).collect())) and len(got) > 200
