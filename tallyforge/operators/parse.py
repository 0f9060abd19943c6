"""Delimited and spreadsheet records to the transactions table, by expressions compiled from a template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..schema import coerce_core
from ..sources import delimited
from .templates import date_formats, delimiters, source

VERBATIM = ("particulars", "code", "reference", "other_party", "type")


def cell(name: str | None) -> Column:
    """A cell by its header's name, failing that by the only name that differs in case alone; null without a column."""
    if name is None:
        return F.lit(None).cast("string")
    near = F.filter(F.map_keys("cells"), lambda k: F.lower(k) == name.lower())
    return F.coalesce(F.try_element_at("cells", F.lit(name)), F.when(F.size(near) == 1, F.try_element_at("cells", F.get(near, F.lit(0)))))


def transactions(records: DataFrame, template: dict) -> DataFrame:
    """The core table, with extras, source_ref and raw, of records(statement_id, row_id, cells, field_count, ...)."""
    at = lambda f: cell(source(template, f))
    style, decimal = template.get("amount_sign", "signed"), template.get("decimal_mark", "auto")
    rows = records.withColumns({
        "date_raw": at("date"), "amount_raw": F.lit(None).cast("string") if style == "debit_credit_cols" else at("amount"), "__debit": at("debit"), "__credit": at("credit"),
        "__kind": at("type"), "description": text.clean_description(at("description")), "balance_raw": at("balance"), **{f: text.blank_to_null(at(f)) for f in VERBATIM},
    })
    formats = date_formats(template)
    if len(formats) == 1:
        rows = rows.withColumn("date", dates.parse(F.col("date_raw"), formats[0]))
    else:  # one format for the whole file: the first that reads all of it
        chosen = rows.groupBy("statement_id").agg(dates.column_format(F.col("date_raw"), formats).alias("__format"))
        rows = rows.join(chosen, "statement_id", "left")
        read = F.lit(None).cast("string")
        for f in formats:
            read = F.when(F.col("__format") == f, dates.parse(F.col("date_raw"), f)).otherwise(read)
        rows = rows.withColumn("date", read)
    value = money.amount(style, F.col("amount_raw"), F.col("__debit"), F.col("__credit"), F.col("__kind"), str(template.get("type_debit_value") or "D"), template.get("type_credit_value"), template.get("unsigned_default") or "debit", decimal)
    shown = money.debit_credit_raw(F.col("__debit"), F.col("__credit"), decimal) if style == "debit_credit_cols" else F.col("amount_raw")
    rows = rows.withColumns({"__value": value, "__shown": shown, "balance": money.number(F.col("balance_raw"), decimal)})
    extras = {k: text.blank_to_null(cell(source(template, k, "extras"))) for k in template.get("extras") or {}}
    if style == "debit_credit_cols":
        extras.setdefault("debit", text.blank_to_null(F.col("__debit")))
        extras.setdefault("credit", text.blank_to_null(F.col("__credit")))
    hidden = text.is_redacted(F.col("__shown")) | text.is_redacted(F.col("description"))
    odd = (F.col("field_count") != F.col("expected")) | (F.col("__value").isNull() & ~hidden)
    fx = extras["fx_amount"].isNotNull() if "fx_amount" in extras else F.lit(False)
    rows = rows.withColumns({
        "flags": text.join_flags(text.flags(("redacted", hidden), ("malformed", odd), ("fx", fx))), "amount": F.when(~text.is_redacted(F.col("__shown")), F.col("__value")),
        "direction": money.direction(F.col("__value")), "currency": F.lit(template.get("currency") or "NZD"), "source_ref": text.line_span(F.col("span")),
        "extras": F.create_map(*(x for k, v in extras.items() for x in (F.lit(k), v))) if extras else F.create_map().cast("map<string,string>"),
    })
    return coerce_core(rows.withColumn("raw", F.col("text")), "statement_id", "extras", "source_ref", "raw")


def parse_delimited(lines: DataFrame, template: dict) -> tuple[DataFrame, DataFrame]:
    """Transactions of all files that a template reads, and their counters for the completeness check."""
    marks = list((template.get("fingerprint") or {}).get("header_contains_all") or [])
    records = delimited.read(lines, [str(m) for m in marks], delimiters(template), (template.get("preamble") or {}).get("header_regex"))
    counters = records.groupBy("statement_id").agg(F.max("data_lines").alias("source_lines"), F.max("padding_lines").alias("padding_lines"), F.sum(F.size("span") - 1).cast("int").alias("multiline_extra"))
    return transactions(records, template), counters


def header(statements: DataFrame, template: dict) -> DataFrame:
    """A header row per statement from its template; what its preamble prints is joined by `metadata`."""
    none = lambda t: F.lit(None).cast(t)
    return statements.select("statement_id").distinct().select(
        "statement_id", F.lit(template.get("bank")).alias("bank"), F.lit(template.get("statement_type")).alias("statement_type"), F.lit(template["id"]).alias("template_id"), none("string").alias("account_number"), none("string").alias("period_start"), none("string").alias("period_end"),
        none("double").alias("opening_balance"), none("double").alias("closing_balance"), none("int").alias("stated_count"), none("int").alias("ocr_pages"), none("double").alias("ocr_min_confidence"), none("int").alias("redaction_scan_incomplete"), F.lit(template.get("amount_sign", "signed")).alias("amount_sign"),
    )
