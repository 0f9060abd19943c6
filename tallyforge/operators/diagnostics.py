"""Diagnostics: what stands in the way of a statement, how grave it is, and who can mend it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import MAX_PAGE_POINTS, MAX_PAGES, OCR_PAGE_MIN_CONF

# Category to severity and owner of the mending; the last is how to mend it.
CATALOGUE = {
    "unknown_format": ("high", "template", "draft a template for this layout"),
    "ambiguous_template": ("medium", "template", "merge or retire one of the templates that tie"),
    "matched_but_empty": ("high", "template", "look where the template's columns sit on the page"),
    "thin_margin": ("medium", "template", "add phrases to the fingerprint"),
    "no_rows": ("high", "template", "check the template's columns and date format"),
    "reconciliation_mismatch": ("high", "template", "compare the opening and closing balance and the signs with the statement"),
    "balance_break": ("high", "template", "look at the rows around the break"),
    "row_count": ("high", "template", "compare the number of rows with the statement"),
    "row_parse": ("high", "template", "check the delimiter, the quotes and the header rule"),
    "date_parse": ("high", "template", "declare the date format that the file uses"),
    "date_format_mismatch": ("medium", "template", "declare the format in which these dates are written"),
    "amount_parse": ("high", "template", "check the amount style and the decimal mark"),
    "amount_direction": ("high", "template", "declare the amount style"),
    "date_out_of_range": ("medium", "template", "check the statement's period and the order of day and month"),
    "unreadable": ("high", "input", "check that the file opens and is what its name says"),
    "scanned_no_ocr": ("high", "input", "bring a digital copy, or have OCR installed"),
    "multiple_statements": ("high", "input", "split the file"),
    "oversized": ("medium", "input", "split the file"),
    "oversized_page": ("medium", "input", "print the file on pages of a usual size"),
    "low_ocr_confidence": ("high", "input", "scan again, or compare the marked pages with the source"),
    "ocr_confidence_unknown": ("high", "input", "take the values as unverified"),
    "completeness_unverified": ("medium", "input", "count the rows against the statement"),
    "combined_statement": ("info", "review", "look which account each row belongs to"),
    "mixed_currency": ("info", "review", "look how other currencies are counted"),
    "redaction": ("info", "none", "hidden values stay hidden"),
    "ocr": ("info", "none", "compare amounts with the source"),
    "document_provenance": ("info", "none", "for the record"),
    "none": ("info", "none", "-"),
    "redaction_unverified": ("high", "escalate", "do not release the output"),
}
BY_CHECK = {
    "balance_reconciliation": "reconciliation_mismatch", "running_balance_continuity": "balance_break", "amount_direction": "amount_direction", "transaction_count": "row_count",
    "dates_within_period": "date_out_of_range", "dates_readable": "date_parse", "no_unparsed_rows": "row_parse", "redaction_scan": "redaction_unverified",
}
RANK = {"high": 0, "medium": 1, "info": 2}


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), F.lit(default))


def described(rows: DataFrame) -> DataFrame:
    """Rows (statement_id, category, where, detail) with severity, owner and remedy, gravest first."""
    parts = [{k: v[i] for k, v in CATALOGUE.items()} for i in range(3)]
    out = rows.withColumns({"severity": _lookup(F.col("category"), parts[0], "medium"), "fix_owner": _lookup(F.col("category"), parts[1], "escalate"), "how_to_fix": _lookup(F.col("category"), parts[2], "ask for help")})
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair)), F.col("severity"))
    return out.orderBy("statement_id", rank, "category")


def _noted(rows: DataFrame, category: str, where: str, when: Column, detail: Column) -> DataFrame:
    return rows.where(when).select("statement_id", F.lit(category).alias("category"), F.lit(where).alias("where"), detail.cast("string").alias("detail"))


def of_rows(tx: DataFrame) -> DataFrame:
    """What the rows of statements show by themselves: one aggregate, then one row per finding."""
    has = lambda flag: F.count_if(F.array_contains(F.split("flags", ","), flag))
    facts = tx.groupBy("statement_id").agg(
        has("malformed").alias("row_parse"), has("date_alt_format").alias("date_format_mismatch"), has("date_year_inferred").alias("date_out_of_range"),
        F.count_if(F.col("date").isNull() & (F.coalesce(F.trim("date_raw"), F.lit("")) != "")).alias("date_parse"), F.count_if(F.col("amount").isNull() & ~F.col("flags").contains("redacted")).alias("amount_parse"),
        F.greatest(F.count_distinct("currency") - 1, F.lit(0)).alias("mixed_currency"), has("redacted").alias("redaction"),
    )
    names = [c for c in facts.columns if c != "statement_id"]
    pairs = F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in names))
    out = facts.select("statement_id", F.explode(pairs).alias("p")).where("p.n > 0")
    return out.select("statement_id", "p.category", F.lit("rows").alias("where"), F.concat(F.col("p.n").cast("string"), F.lit(" row(s)")).alias("detail"))


def of_documents(facts: DataFrame) -> DataFrame:
    """What is known of the files: facts(statement_id and any of pages, max_page_points, ocr_pages, ocr_min_confidence,
    scanned_no_ocr, n_accounts, multiple, created, modified, producer, error)."""
    has = lambda c: F.col(c) if c in facts.columns else F.lit(None)
    ocr = F.coalesce(has("ocr_pages").cast("int"), F.lit(0))
    found = [
        _noted(facts, "oversized", "upload", has("pages").cast("int") > MAX_PAGES, has("pages")), _noted(facts, "oversized_page", "upload", has("max_page_points").cast("double") > MAX_PAGE_POINTS, has("max_page_points")),
        _noted(facts, "ocr", "pages", ocr > 0, ocr), _noted(facts, "low_ocr_confidence", "pages", has("ocr_min_confidence").cast("double") < OCR_PAGE_MIN_CONF, has("ocr_min_confidence")),
        _noted(facts, "ocr_confidence_unknown", "pages", (ocr > 0) & has("ocr_min_confidence").isNull(), F.lit("OCR ran, its confidence is not known")), _noted(facts, "scanned_no_ocr", "file", has("scanned_no_ocr").cast("int") > 0, has("scanned_no_ocr")),
        _noted(facts, "multiple_statements", "upload", F.coalesce(has("multiple").cast("boolean"), F.lit(False)), F.lit("several statements in one file")),
        _noted(facts, "combined_statement", "upload", (has("n_accounts").cast("int") > 1) & ~F.coalesce(has("multiple").cast("boolean"), F.lit(False)), has("n_accounts")),
        _noted(facts, "document_provenance", "document", F.coalesce(has("created").cast("string") != has("modified").cast("string"), F.lit(False)), F.concat_ws(" ", F.lit("written"), has("created").cast("string"), F.lit("changed"), has("modified").cast("string"), has("producer").cast("string"))),
        _noted(facts, "unreadable", "file", has("error").isNotNull(), has("error")),
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def build(reconciled: DataFrame, detection: DataFrame | None = None, tx: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """The diagnostics of all statements; a category is said once of a statement, by its first source. A statement without
    any gets the row `none`."""
    checks = reconciled.select("statement_id", F.explode_outer("kpis").alias("k")).where("k.status = 'fail'")
    base = F.regexp_replace("k.name", r"\s*\[statement \d+\]$", "")
    rows = checks.select("statement_id", _lookup(base, BY_CHECK, "reconciliation_mismatch").alias("category"), F.col("k.name").alias("where"), F.col("k.detail").alias("detail"), F.lit(0).alias("source"))
    more = [_noted(reconciled, "no_rows", "rows", F.col("n") == 0, F.lit("no row was read")), _noted(reconciled, "completeness_unverified", "completeness", ~F.col("completeness_verified") & (F.col("n") > 0), F.lit("no balance or stated count"))]
    if tx is not None:
        more.append(of_rows(tx))
    else:
        hidden = reconciled.select("statement_id", F.explode_outer("kpis").alias("k")).where("k.name = 'redaction_summary'")
        more.append(_noted(hidden, "redaction", "rows", F.col("k.actual").cast("int") > 0, F.col("k.detail")))
    if detection is not None:
        kind = F.when(F.size("tied") > 0, "ambiguous_template").when(~F.col("matched"), "unknown_format").when(F.col("margin") <= 1, "thin_margin")
        more.append(detection.select("statement_id", kind.alias("category"), F.lit("detection").alias("where"), "detail").where("category is not null"))
    if documents is not None:
        more.append(of_documents(documents))
    for k, part in enumerate(more):
        rows = rows.unionByName(part.withColumn("source", F.lit(k + 1)))
    rows = rows.unionByName(reconciled.select("statement_id", F.lit("none").alias("category"), F.lit("-").alias("where"), F.lit("no issue found").alias("detail"), F.lit(len(more) + 1).alias("source")))
    said = rows.groupBy("statement_id", "category").agg(F.min_by(F.struct("where", "detail"), F.struct("source", "where")).alias("f")).select("statement_id", "category", "f.*")
    alone = F.count("*").over(Window.partitionBy("statement_id")) == 1
    return described(said.withColumn("alone", alone).where("alone or category <> 'none'").drop("alone"))
