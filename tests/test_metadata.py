from __future__ import annotations

from tallyforge.operators import metadata


def test_capture_and_audit(spark):
    tx = spark.createDataFrame([("s", 1, "01/02/2024", "12.50", "Coffee Shop", 12.5, "fx"), ("s", 2, "x", "[REDACTED]", "acct 12-3456-7890123-00", None, "redacted")], "statement_id string, row_id int, date_raw string, amount_raw string, description string, amount double, flags string")
    results = spark.createDataFrame([("s", "t", "ok", "high", 2)], "statement_id string, template_id string, status string, trust_level string, row_count int")
    row = metadata.capture(tx, results, "full").first()
    assert row["flags"] == {"fx": 1, "redacted": 1} and row["amount_buckets"] == {"10-100": 1} and row["description_length"]["shortest"] == 11
    assert metadata.capture(tx, results, "off").count() == 0
    assert metadata.accounts(tx, r"[0-9]{2}-[0-9]{4}-[0-9]{7}-[0-9]{2,3}").first()["n_accounts"] == 1
    checked = spark.createDataFrame([("s", [("a", "pass"), ("b", "fail")], "low")], "statement_id string, kpis array<struct<name:string,status:string>>, trust_level string")
    shown = {r["row_id"]: r for r in metadata.statement_audit(tx, checked).collect()}
    assert shown[1]["description_shape"] == "Xxxxxx Xxxx" and shown[2]["amount_shape"] == "[REDACTED]" and shown[1]["checks"] == {"a": "pass", "b": "fail"}
    assert "| ok | b | 1 |" in metadata.report(metadata.batch_audit(results, checked))
