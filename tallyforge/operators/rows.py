"""Verdicts on visual rows: is it a transaction, and if not, why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Why a row was skipped; the last two can be mended in the template.
REASONS = {
    "summary_line": "a balance or total, not a transaction",
    "heading_or_note": "no date and no amount: a heading, note or wrapped line",
    "date_unparsed": "the date could not be read: check the date format",
    "amount_missing": "no amount in the money columns: check their bands",
}
ACTIONABLE = ("date_unparsed", "amount_missing")


def has_amount(cell: Column) -> Column:
    """A figure or a redaction mark."""
    return F.coalesce(cell.rlike("[0-9]") | cell.rlike("(?i)REDACT"), F.lit(False))


def has_visible_amount(cell: Column) -> Column:
    return F.coalesce(cell.rlike("[0-9]") & ~cell.rlike("(?i)REDACT"), F.lit(False))


def keep_row(summary: Column, amount: Column, dated: Column, date_redacted: Column | None = None, keep_dateless: bool = False) -> Column:
    """A transaction has an amount and a date; with the date hidden, or where a template allows it, a visible amount is enough."""
    hidden = F.coalesce(date_redacted, F.lit(False)) if date_redacted is not None else F.lit(False)
    dated = F.coalesce(dated, F.lit(False))
    return ~summary & has_amount(amount) & (dated | ((hidden | F.lit(keep_dateless)) & has_visible_amount(amount)))


def row_code(summary: Column, amount: Column, dated: Column) -> Column:
    dated, some = F.coalesce(dated, F.lit(False)), has_amount(amount)
    return F.when(dated & some & ~summary, "").when(summary, "summary_line").when(~dated & ~some, "heading_or_note").when(~dated, "date_unparsed").otherwise("amount_missing")


def reason(code: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair)), code)
