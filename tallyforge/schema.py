"""The fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the transactions table, of the feed and of its manifest.
CORE = {
    "row_id": "int", "date": "string", "date_raw": "string", "description": "string", "amount": "double", "amount_raw": "string",
    "direction": "string", "balance": "double", "balance_raw": "string", "particulars": "string", "code": "string", "reference": "string",
    "other_party": "string", "type": "string", "currency": "string", "flags": "string",
}
FEED_CONTEXT = [
    "run_id", "converted_ts", "source_file", "source_sha256", "bank", "statement_type", "template_id", "template_version",
    "template_origin", "trust_level", "gate_result", "period_start", "period_end", "account_number", "statement_index",
]
FEED_CORE = [
    "row_id", "date", "description", "amount", "debit", "credit", "direction", "balance", "particulars", "code", "reference",
    "other_party", "type", "currency", "flags",
]
MANIFEST = [
    "feed_key", "run_id", "converted_ts", "source_file", "source_sha256", "bank", "statement_type", "template_id", "template_version",
    "template_origin", "status", "trust_level", "gate_result", "row_count", "period_start", "period_end",
]
HEADER = "statement_id string, bank string, statement_type string, template_id string, account_number string, period_start string, period_end string, opening_balance double, closing_balance double, stated_count int, ocr_pages int, ocr_min_confidence double, redaction_scan_incomplete int, amount_sign string"
WORDS = "statement_id string, page int, word_idx int, x double, y double, width double, height double, text string, redacted boolean, ocr_conf double"
PAGES = "statement_id string, page int, text string, width double, height double, ocr boolean, ocr_conf double, redacted_words int, scan_incomplete boolean"
RUN = (
    "ts string, run_id string, kind string, requested_by string, source_file string, source_sha256 string, bank_hint string, detected_template string, "
    "template_origin string, closest_template string, detect_detail string, layout_signature string, layout_hint string, template_version string, engine_version string, "
    "template_sha256 string, status string, trust_level string, row_count int, n_fields int, kpi_fail_count int, pages int, period_start string, period_end string, "
    "n_accounts int, multiple_statements boolean, message string"
)
FEEDBACK = "ts string, run_id string, verdict string, flagged boolean, comment string, requested_by string, template_id string, retracted_files int, retracted_rows int"
FEED_LOG = "ts string, run_id string, source_file string, source_sha256 string, template_id string, gate_result string, feed_written boolean, feed_file string, feed_dir string, manifest_written boolean, detail string, row_count int, engine_version string"


def coerce_core(df: DataFrame, *keys: str) -> DataFrame:
    """The sixteen columns, cast and in order; what is missing is null, flags never are."""
    out = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in CORE.items()]
    return df.select(*keys, *out).withColumn("flags", F.coalesce("flags", F.lit("")))
