"""A site's own words, forms and log: they change what a conversion gives."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_frontdoor import CSV, PAGE, page_reader

from tallyforge import engine, vocab
from tallyforge.functions import money, text
from tallyforge.operators import labels, profile
from tallyforge.sources import logs

FORM = {"id": "tax", "mode": "fields", "fingerprint": {"page_contains_all": ["Tax Office", "Certificate"]}, "fields": {"opening_balance": {"required": True}, "number": "Certificate number", "office": {"label": "Branch", "required": True}}}


def test_words_in_effect(spark):
    df = spark.createDataFrame([("5.00 PAID", "Gesamtsumme 5.00", "<hidden>", "Anfangssaldo 7.00", "2024|01|31")], "a string, s string, r string, l string, d string")
    own = {"dr_cr_suffix_debit": ["PAID"], "summary_line_labels": ["gesamtsumme"], "redaction_markers": ["<hidden>"], "date_formats": ["%Y|%m|%d"], "money_regex": "(["}

    def seen():
        row = df.select(money.number(F.col("a")).alias("a"), text.is_summary_line(F.col("s")).alias("s"), text.matches_marker(F.col("r")).alias("r")).first()
        lines = df.select(F.lit("x").alias("statement_id"), F.lit(1).alias("page"), F.lit(1).alias("line_no"), F.col("l").alias("text"))
        return (*row, labels.header_facts(lines).first()["opening_balance"], df.agg(profile.detect_date_format(F.col("d")).alias("f")).first()["f"])

    assert seen() == (5.0, False, False, None, None)
    with vocab.using(own, {"opening_balance": ["anfangssaldo"], "extra": {"any_of": ["x"], "value": "date"}}):
        assert seen()[:4] == (-5.0, True, True, "7.00")
        assert vocab.lexicon()["money_regex"] == vocab.DEFAULTS["money_regex"]  # one that doesn't compile is left out
        assert vocab.label_dictionary()["extra"]["value"] == "date" and vocab.lexicon()["date_formats"] == ["%Y|%m|%d"]
    assert seen() == (5.0, False, False, None, None) and vocab.lexicon() is vocab.DEFAULTS


def test_field_specs():
    got = labels.field_specs({"opening_balance": {}, "a": "A label", "b": {"label": "B", "value": "date"}, "c": {}, "d": {"any_of": "D"}})
    assert list(got) == ["opening_balance", "a", "b", "d"] and got["opening_balance"]["value"] == "money" and got["b"]["any_of"] == ["B"] and got["a"] == {"value": "text", "any_of": ["A label"]} and got["d"]["any_of"] == ["D"]


def test_conversion_with_own_words_forms_and_log(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text("Anfangssaldo,100.00\nDate,Memo,Amount\n2024-01-01,one,5.00 PAID\n")
    (source / "f.pdf").write_text("10 20 Tax Office\n10 40 Certificate number: 42\n10 60 Anfangssaldo 12.50\n")
    csv = {**CSV, "preamble": {"header_regex": "^Date,"}}
    found = engine.convert(spark, str(source), {"csv": csv, "page": PAGE}, reader=page_reader(), lexicon={"dr_cr_suffix_debit": ["PAID"]}, label_words={"opening_balance": ["anfangssaldo"]}, forms={"tax": FORM})
    rows = {r["path"].rsplit("/", 1)[1]: r for r in found.results.collect()}
    assert [r["amount"] for r in found.transactions.collect()] == [-5.0]
    assert (rows["f.pdf"]["kind"], rows["f.pdf"]["template_id"], rows["f.pdf"]["status"], rows["f.pdf"]["row_count"]) == ("form", "tax", "needs_review", 2)
    assert {(r["field"], r["value"], r["flagged"]) for r in found.fields.collect()} == {("opening_balance", "12.50", False), ("number", "42", False), ("office", None, True)}
    assert rows["a.csv"]["kind"] == "statement"
    for ts in ("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"):
        logs.append(engine.run_records(found, ts), str(tmp_path / "log"), "runs")
    logged = logs.read(spark, str(tmp_path / "log")).collect()
    assert len(logged) == 4 and {(r["kind"], r["status"], r["row_count"], r["n_fields"]) for r in logged if r["source_file"] == "f.pdf"} == {("form", "needs_review", None, 2)}
    assert len({r["run_id"] for r in logged}) == 4
