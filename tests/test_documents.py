"""Positioned words, labels, bundles, the feed, logs and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyforge.operators import draft, feed, labels, pdf_table, split
from tallyforge.sources import logs, pages
from tallyforge.streaming import intake

TEMPLATE = {
    "id": "pdf", "bank": "Test Bank", "statement_type": "everyday", "format": "pdf", "fingerprint": {"page_contains_all": ["Statement"]},
    "table": {"amount_sign": "debit_credit_cols", "date_format": "%d %b", "columns": {"date": {"x_min": 40, "x_max": 80}, "description": {"x_min": 81, "x_max": 300}, "debit": {"x_min": 350, "x_max": 400}, "credit": {"x_min": 430, "x_max": 475}, "balance": {"x_min": 500, "x_max": 550}}},
}


def page_words(spark):
    lines = [
        (306, [("01", 42), ("Apr", 56), ("Opening", 82), ("Balance", 130), ("100.00", 510)]),
        (328, [("02", 42), ("Apr", 56), ("Coffee", 82), ("4.50", 370), ("95.50", 512)]),
        (337, [("Cuba", 82), ("Street", 110)]),
        (350, [("03", 42), ("Apr", 56), ("Salary", 82), ("1,000.00", 432), ("1,095.50", 505)]),
        (372, [("04", 42), ("Apr", 56), ("Split", 82)]),
        (381, [("row", 82), ("5.00", 370), ("1,090.50", 505)]),
        (700, [("Total", 82), ("withdrawals", 120), ("9.50", 370)]),
        (720, [("Page", 82), ("1", 110), ("of", 120), ("1", 130)]),
    ]
    rows = [("s", 1, i * 100 + k, float(x), float(y), 20.0, 8.0, t) for i, (y, ws) in enumerate(lines) for k, (t, x) in enumerate(ws)]
    return spark.createDataFrame(rows, "statement_id string, page int, word_idx int, x double, y double, width double, height double, text string")


def test_words_to_transactions(spark):
    headers = spark.createDataFrame([("s", "1 April 2025", "30 April 2025")], "statement_id string, period_start string, period_end string")
    tx, counters = pdf_table.transactions(page_words(spark), TEMPLATE, headers)
    rows = [r.asDict() for r in tx.orderBy("row_id").collect()]
    assert [(r["date"], r["description"], r["amount"], r["balance"], r["flags"]) for r in rows] == [
        ("2025-04-02", "Coffee Cuba Street", -4.5, 95.5, "row_text_merged"), ("2025-04-03", "Salary", 1000.0, 1095.5, ""), ("2025-04-04", "Split row", -5.0, 1090.5, "row_stitched"),
    ]
    assert counters.first()["skipped_rows"] >= 2
    seen = {r["raw"]: r["verdict"] for r in pdf_table.xray(page_words(spark), TEMPLATE).collect()}
    assert seen["Total withdrawals 9.50"] == "summary_line"


def test_bands_from_a_page(spark):
    bands = draft.suggest_bands(page_words(spark))
    assert {"date", "description", "balance"} <= set(bands)


def test_guard_and_routing(spark):
    words = page_words(spark).withColumn("redacted", F.lit(False))
    boxes = spark.createDataFrame([("s", 1, 360.0, 320.0, 400.0, 340.0)], "statement_id string, page int, x0 double, y0 double, x1 double, y1 double")
    hidden = pages.guarded(words, boxes).where("redacted").collect()
    assert [r["text"] for r in hidden] == ["[REDACTED]"] and hidden[0]["x"] == 370.0
    rows = spark.createDataFrame([("", 0), ("A page of ordinary words here", 6), ("�" * 30, 10)], "t string, n int")
    assert [r[0] for r in rows.select(pages.needs_ocr(F.col("t"), F.col("n"))).collect()] == [True, False, True]


def test_labels(spark):
    rows = spark.createDataFrame([("s", 1, 1, "Opening balance: $1,200.50"), ("s", 1, 2, "Closing balance"), ("s", 1, 3, "$99.10 CR"), ("s", 1, 4, "Statement period 1 Jan 2024 to 31 Jan 2024"), ("s", 2, 1, "Opening balance 7.25")], "statement_id string, page int, line_no int, text string")
    first = labels.match(rows, {"any_of": ["opening balance"], "value": "money"}).first()
    assert first["value"] == "$1,200.50" and first["conflict"] and first["n"] == 2
    assert labels.match(rows, {"any_of": ["closing balance"], "value": "money"}).first()["value"] == "$99.10 CR"
    assert labels.match(rows, {"any_of": ["statement period"], "value": "date_range"}).first()["value"] == "1 Jan 2024..31 Jan 2024"
    assert labels.match(rows, {"any_of": ["opening balance"], "value": "money"}, occurrence="last").first()["value"] == "7.25"
    fields = {r["field"]: r for r in labels.form_fields(rows, {"open": {"any_of": ["opening balance"], "value": "money", "where": "page1"}, "none": {"any_of": ["iban"], "required": True}}).collect()}
    assert fields["open"]["value"] == "$1,200.50" and not fields["open"]["flagged"] and fields["none"]["flagged"]
    assert labels.multiple_statements(rows).first()["multiple"] is False


def test_bundle(spark):
    rows = split.starts(spark.createDataFrame([("s", 1, "Statement 1"), ("s", 2, "more"), ("s", 3, "Statement 2")], "statement_id string, page int, text string"), "^Statement")
    parts = split.segments(rows)
    assert [tuple(r)[1:] for r in parts.orderBy("segment").collect()] == [(1, 1, 2), (2, 3, 3)]
    scored = spark.createDataFrame([("s", 1, 4, "high", 100, True), ("s", 2, 3, "medium", 80, True)], "statement_id string, segment int, rows int, trust_level string, score int, completeness_verified boolean")
    counted = spark.createDataFrame([("s", 2)], "statement_id string, structural int")
    assert split.committed(scored, counted).first()["split"] is True
    weak = split.weakest(scored).first()
    assert (weak["trust_level"], weak["score"]) == ("medium", 80)


def test_feed_versions(spark, tmp_path):
    schema = "feed_key string, run_id string, gate_result string, amount double"
    folder = str(tmp_path / "feed")
    feed.publish(spark, spark.createDataFrame([("a", "1", "accepted", 1.0), ("b", "1", "withheld:failed", 2.0)], schema), folder)
    feed.publish(spark, spark.createDataFrame([("a", "2", "withheld:low_trust", 3.0), ("b", "2", "accepted", 4.0)], schema), folder)
    sides = {n: [(r["feed_key"], r["run_id"]) for r in feed.read(spark, folder, n).collect()] for n in ("transactions", "review")}
    assert sides == {"transactions": [("b", "2")], "review": [("a", "2")]}


def test_logs_skip_half_written_files(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text(json.dumps({"run_id": "1", "status": "ok", "ts": "2024-01-01T00:00:00", "new": 5}))
    (tmp_path / "runs" / "b.json").write_text('{"run_id": "2", "sta')
    rows = logs.read(spark, str(tmp_path)).collect()
    assert [(r["run_id"], r["status"], r["bank_hint"]) for r in rows] == [("1", "ok", None)]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.csv"):
        (tmp_path / "in" / name).write_text("Date,Amount\n1,2\n")
    got = []
    stream = intake.convert_each(intake.new_contents(intake.dropped_files(spark, str(tmp_path / "in"))), lambda df, _: got.extend(df.select("statement_id", "kind").collect()), str(tmp_path / "c1"))
    stream.awaitTermination(120)
    assert len(got) == 1 and got[0]["kind"] == "delimited"
    (tmp_path / "rows").mkdir()
    schema = "feed_key string, run_id string, converted_ts string, gate_result string"
    spark.createDataFrame([("a", "1", "t1", "accepted"), ("a", "2", "t2", "accepted")], schema).write.mode("append").json(str(tmp_path / "rows"))
    stream = intake.publish(spark.readStream.schema(schema).json(str(tmp_path / "rows")), str(tmp_path / "feed"), str(tmp_path / "c2"))
    stream.awaitTermination(120)
    assert [r["run_id"] for r in feed.read(spark, str(tmp_path / "feed"), "transactions").collect()] == ["2"]


def test_stored_feed_and_retraction(spark, tmp_path):
    folder, schema = str(tmp_path / "feed"), "feed_key string, run_id string, gate_result string, amount double"
    batch = spark.createDataFrame([("0012", "1", "accepted", 1.0), ("0012", "1", "accepted", 2.0), ("0900", "1", "withheld:failed", 3.0), ("77e1", "2", "accepted", 4.0)], schema)
    seen = lambda: {n: sorted((r["feed_key"], r["run_id"], r["amount"]) for r in side.collect()) if (side := feed.read(spark, folder, n)) is not None else [] for n in feed.SIDES}
    feed.publish(spark, batch, folder)
    first = seen()
    feed.publish(spark, batch, folder)  # again: nothing changes
    assert seen() == first and [k for k, *_ in first["transactions"]] == ["0012", "0012", "77e1"]
    assert feed.retract_stored(spark, folder, "1") == 2 and feed.retract_stored(spark, folder, "nobody") == 0
    assert seen() == {"transactions": [("77e1", "2", 4.0)], "review": [("0012", "1", 1.0), ("0012", "1", 2.0), ("0900", "1", 3.0)]}
    assert {r["gate_result"] for r in feed.read(spark, folder, "review").where("run_id = '1' and feed_key = '0012'").collect()} == {"retracted:user_reported_wrong"}


def test_roll_up_twice(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyforge.operators import retention

    rows = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-06-01"), ("b", "2023-12-01"), ("c", "2024-05-30")], "run_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    now, folder = F.lit("2024-06-02").cast("timestamp"), str(tmp_path / "archive")
    for _ in range(2):
        left = retention.roll_up(rows, "ts", folder, now, 90)
        assert sorted((r["run_id"], r["ts"].month) for r in left.collect()) == [("a", 6), ("c", 5)]
        assert spark.read.json(folder).count() == 2
    uploads = spark.createDataFrame([("u", "2024-01-01", "/x", "2024-01-01 kept"), ("v", "2024-06-01", "/y", None)], "upload_id string, ts string, path string, history string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["upload_id"]: (r["path"], r["history"]) for r in retention.purged(uploads, now).collect()}
    assert got == {"u": (None, "2024-01-01 kept; 2024-06-02 purged"), "v": ("/y", None)}
