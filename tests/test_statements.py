"""Delimited statements end to end: reading, typing, checks, trust, detection, outputs."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge import engine
from tallyforge.operators import outputs, parse, reconcile, templates
from tallyforge.sources import delimited, excel

EVERYDAY = {
    "id": "everyday", "bank": "Test Bank", "statement_type": "everyday", "format": "delimited", "min_score": 3, "fingerprint": {"header_contains_all": ["Date", "Amount", "Payee", "Balance"]}, "delimiter": [",", "\t"],
    "preamble": {"header_regex": "^Date[,\t]Amount"}, "columns": {"date": {"source": "Date", "format": ["%Y/%m/%d", "%d/%m/%Y"]}, "amount": {"source": "Amount"}, "description": {"source": "payee"}, "balance": {"source": "Balance"}},
    "amount_sign": "signed", "extras": {"fx_amount": {"source": "Fx"}},
}
CARD = {
    "id": "card", "bank": "Test Bank", "statement_type": "card", "format": "delimited", "min_score": 3, "fingerprint": {"header_contains_all": ["Card", "Type", "Details", "When"]},
    "columns": {"date": {"source": "When", "format": "%d/%m/%Y"}, "amount": {"source": "Amount"}, "description": {"source": "Details"}, "type": {"source": "Type"}}, "amount_sign": "type_dc", "type_debit_value": "D", "type_credit_value": "C",
}


def converted(spark, tmp_path, name, content, template=EVERYDAY):
    (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    files = delimited.scan(spark, str(tmp_path / name))
    tx, counters = parse.parse_delimited(delimited.lines(files), template)
    found = reconcile.reconcile(tx, parse.header(files, template), counters)
    return [r.asDict(recursive=True) for r in tx.orderBy("row_id").collect()], found.first().asDict(recursive=True)


def statuses(found):
    return {k["name"]: k["status"] for k in found["kpis"]}


def test_preamble_quotes_padding_and_balance(spark, tmp_path):
    rows, found = converted(spark, tmp_path, "a.csv", 'Account 1\nx\nDate,Amount,Payee,Balance,Fx\n\n13/08/2025,-5.00,"Cafe, ""The"" One",95.00,\n,,,,\n14/08/2025,10.00, Shop ,105.00,8000 JPY\n')
    assert [(r["date"], r["amount"], r["description"], r["balance"], r["direction"], r["flags"]) for r in rows] == [("2025-08-13", -5.0, 'Cafe, "The" One', 95.0, "debit", ""), ("2025-08-14", 10.0, "Shop", 105.0, "credit", "fx")]
    assert [r["source_ref"] for r in rows] == ["csv:line=5", "csv:line=7"]
    assert statuses(found)["running_balance_continuity"] == "pass" and statuses(found)["no_unparsed_rows"] == "pass" and found["trust_level"] == "medium"


def test_tabs_and_the_other_date_format(spark, tmp_path):
    rows, _ = converted(spark, tmp_path, "a.tsv", "Date\tAmount\tPayee\tBalance\tFx\n2025/08/13\t1\tx\t1\t\n")
    assert rows[0]["date"] == "2025-08-13"


def test_mixed_date_formats_read_nothing(spark, tmp_path):
    rows, found = converted(spark, tmp_path, "a.csv", "Date,Amount,Payee,Balance,Fx\n2025/08/13,1,x,1,\n13/08/2025,1,y,2,\n")
    assert [r["date"] for r in rows] == [None, None] and statuses(found)["dates_readable"] == "fail" and found["trust_level"] == "low"


def test_ragged_rows_are_flagged_and_neighbours_stay(spark, tmp_path):
    rows, found = converted(spark, tmp_path, "a.csv", "Date,Amount,Payee,Balance,Fx\n13/08/2025,1,x\n14/08/2025,2,y,3,,extra\n15/08/2025,3,z,6,\n")
    assert [r["flags"] for r in rows] == ["malformed", "malformed", ""] and rows[2]["amount"] == 3.0
    assert statuses(found)["no_unparsed_rows"] == "fail"


def test_a_record_may_span_lines(spark, tmp_path):
    rows, found = converted(spark, tmp_path, "a.csv", 'Date,Amount,Payee,Balance,Fx\n13/08/2025,1,"two\nlines",1,\n14/08/2025,2,y,3,\n')
    assert rows[0]["description"] == "two\nlines" and rows[0]["source_ref"] == "csv:line=2-3" and statuses(found)["no_unparsed_rows"] == "pass"


def test_an_open_quote_is_not_silent(spark, tmp_path):
    rows, found = converted(spark, tmp_path, "a.csv", 'Date,Amount,Payee,Balance,Fx\n13/08/2025,1,"open,1,\n14/08/2025,2,y,3,\n')
    assert statuses(found)["no_unparsed_rows"] == "fail" and "malformed" in rows[0]["flags"]


def test_hidden_amounts_stay_hidden(spark, tmp_path):
    rows, found = converted(spark, tmp_path, "a.csv", "Date,Amount,Payee,Balance,Fx\n13/08/2025,[REDACTED],x,,\n14/08/2025,2,y,,\n")
    assert rows[0]["amount"] is None and rows[0]["flags"] == "redacted"


def test_broken_balance(spark, tmp_path):
    _, found = converted(spark, tmp_path, "a.csv", "Date,Amount,Payee,Balance,Fx\n13/08/2025,1,x,1,\n14/08/2025,2,y,999.99,\n15/08/2025,1,z,1000.99,\n")
    assert statuses(found)["running_balance_continuity"] == "fail" and found["trust_level"] == "low"


def test_encodings(spark, tmp_path):
    text = "Date,Amount,Payee,Balance,Fx\n13/08/2025,1,Café,1,\n"
    for name, data in (("a.csv", text.encode("utf-16")), ("b.csv", b"\xef\xbb\xbf" + text.encode()), ("c.csv", text.encode("cp1252"))):
        assert converted(spark, tmp_path, name, data)[0][0]["description"] == "Café"


def test_typed_amounts(spark, tmp_path):
    rows, found = converted(spark, tmp_path, "c.csv", "Card,Type,Amount,Details,When\n1,D,12.50,A  B,01/02/2024\n1,C,5.00,Refund,02/02/2024\n1,?,5.00,Odd,03/02/2024\n", CARD)
    assert [r["amount"] for r in rows] == [-12.5, 5.0, None] and rows[0]["description"] == "A  B" and rows[2]["flags"] == "malformed"


def test_detection_and_status_of_a_folder(spark, tmp_path):
    (tmp_path / "one.csv").write_text("Date,Amount,Payee,Balance,Fx\n13/08/2025,1,x,1,\n14/08/2025,2,y,3,\n")
    (tmp_path / "two.csv").write_text("Card,Type,Amount,Details,When\n1,D,12.50,A,01/02/2024\n1,C,1.00,B,02/02/2024\n")
    (tmp_path / "three.csv").write_text("No,Such,Layout\n1,2,3\n")
    (tmp_path / "copy.csv").write_text("No,Such,Layout\n1,2,3\n")
    found = engine.convert_delimited(spark, str(tmp_path), {"everyday": EVERYDAY, "card": CARD})
    results = {r["template_id"] if r["status"] != "unsupported" else "-": (r["status"], r["row_count"]) for r in found.results.collect()}
    assert results["everyday"] == ("ok", 2) and results["card"] == ("ok", 2) and results["-"] == ("unsupported", 0) and found.results.count() == 3
    assert {d["category"] for d in found.diagnostics.collect()} >= {"unknown_format"}


def test_template_problems():
    assert templates.problems(EVERYDAY) == [] and templates.problems(CARD) == []
    assert templates.problems({**CARD, "type_debit_value": None}) and templates.problems({**EVERYDAY, "min_score": 9}) and templates.problems({"format": "odd"})
    both = templates.merge({"a": {"id": "a", "origin": "default"}}, {"a": {"id": "a", "origin": "user"}, "b": {"id": "b", "sample": True}})
    assert both == {"a": {"id": "a", "origin": "default"}}


def test_statement_with_a_header(spark):
    tx = spark.createDataFrame([("s", 1, "2024-01-01", -10.0, None, ""), ("s", 2, "2024-01-05", 30.0, None, ""), ("t", 1, "2024-02-09", None, None, "redacted")], "statement_id string, row_id int, date string, amount double, balance double, flags string")
    head = "statement_id string, opening_balance double, closing_balance double, stated_count int, period_start string, period_end string, ocr_pages int, redaction_scan_incomplete int, amount_sign string"
    headers = spark.createDataFrame([("s", 100.0, 120.0, 2, "1 Jan 2024", "31 Jan 2024", 0, 0, "signed"), ("t", 1.0, 2.0, 5, "31/01/2024", "01/01/2024", 1, 2, "signed"), ("u", None, None, None, None, None, 0, 0, "signed")], head)
    found = {r["statement_id"]: r.asDict(recursive=True) for r in reconcile.reconcile(tx, headers).collect()}
    s, t, u = (statuses(found[k]) for k in "stu")
    assert s["balance_reconciliation"] == "pass" and s["transaction_count"] == "pass" and s["dates_within_period"] == "pass" and found["s"]["completeness_verified"]
    assert t["balance_reconciliation"] == "fail" and t["dates_within_period"] == "fail" and t["transaction_count"] == "fail" and t["redaction_scan"] == "fail" and found["t"]["trust_level"] == "low"
    assert u["transaction_count"] == "fail" and "dates_readable" not in u


def test_outputs_are_reproducible(spark, tmp_path):
    rows, found = None, None
    (tmp_path / "a.csv").write_text("Date,Amount,Payee,Balance,Fx\n13/08/2025,1,=x,1,\n")
    files = delimited.scan(spark, str(tmp_path / "a.csv"))
    tx, counters = parse.parse_delimited(delimited.lines(files), EVERYDAY)
    head = parse.header(files, EVERYDAY)
    records = outputs.json_records(tx, reconcile.reconcile(tx, head, counters), head)
    record = json.loads(records.first()["record"])
    assert record["transactions"][0]["amount"] == 1.0 and record["header"]["bank"] == "Test Bank" and record["trust"]["level"] == "medium"
    one, two = (outputs.workbooks(records).first()["content"] for _ in range(2))
    assert bytes(one) == bytes(two) and zipfile.ZipFile(io.BytesIO(bytes(one))).testzip() is None
    shown = outputs.display(tx, ("fx_amount",)).first()
    assert shown["description"] == "'=x" and "date_raw" not in shown


def test_workbook_scan(spark):
    book = outputs.workbook({"Notes": [["hello"]], "Data": [["My account"], ["Date", "", "Amount", "Amount"], [45000, "a", 1.5, 2], ["", "", "", ""], [45001, "b", 2.5, 3]]})
    files = spark.createDataFrame([("w", "excel", bytearray(book)), ("bad", "excel", bytearray(b"no zip"))], "statement_id string, kind string, content binary")
    rows = excel.repaired_dates(excel.read(files)).orderBy("row_id").collect()
    assert [r["cells"] for r in rows] == [{"Date": "2023-03-15", "col2": "a", "Amount": "1.5", "Amount.1": "2"}, {"Date": "2023-03-16", "col2": "b", "Amount": "2.5", "Amount.1": "3"}]


@pytest.mark.parametrize("line,expected", [("a;b;c", ";"), ("a,b;c", ","), ("plain", ",")])
def test_sniffed_delimiter(spark, line, expected):
    assert spark.range(1).select(delimited.sniff_delimiter(F.lit(line))).first()[0] == expected
