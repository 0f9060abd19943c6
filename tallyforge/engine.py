"""The front door: files to transactions, checks, trust, status and diagnostics, all files in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .functions.text import layout_signature
from .operators import detect, diagnostics, facts, geometry, labels, parse, pdf_table, reconcile, split
from .operators.templates import delimiters, frame
from .schema import HEADER, RUN, coerce_core
from .sources import delimited, excel, pages
from .storage import stored


@dataclass
class Result:
    """Tables of a conversion, each keyed by statement_id."""

    results: DataFrame
    transactions: DataFrame
    reconciled: DataFrame
    detection: DataFrame
    diagnostics: DataFrame
    statements: DataFrame | None = None  # those of bundles that were split
    lines: DataFrame | None = None  # the text of pages
    fields: DataFrame | None = None  # those of forms


def status(matched: Column, n: Column, level: Column, failed: Column, margin: Column, multiple: Column) -> Column:
    """ok, needs_review or unsupported, by the first rule that applies."""
    return F.when(~matched | (n == 0), "unsupported").when((failed > 0) | (level == "low") | multiple | F.coalesce(margin <= 1, F.lit(False)), "needs_review").otherwise("ok")


def _merged(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _result(detection: DataFrame, tx: DataFrame, counters: DataFrame | None, headers: DataFrame, several: DataFrame, layout: DataFrame, documents: DataFrame | None = None, parts: DataFrame | None = None) -> Result:
    """Checks, trust, status and diagnostics of what was read; with `parts` of bundles, these are taken together."""
    # read several times below: written, so that neither work nor plan is repeated
    tx, headers = stored(tx, "transactions"), stored(headers, "headers")
    reconciled, statements = stored(reconcile.reconcile(tx, headers, counters), "checks"), None
    if parts is not None:
        tx, reconciled, statements = split.combined(tx, reconciled, headers, parts)
        tx, reconciled, statements = stored(tx, "transactions"), stored(reconciled, "checks"), stored(statements, "statements")
        several = several.join(statements.select("statement_id").distinct().withColumn("__split", F.lit(True)), "statement_id", "left").withColumn("multiple", F.col("multiple") & F.col("__split").isNull()).drop("__split")
    failed = F.size(F.filter("kpis", lambda k: k["status"] == "fail"))
    results = detection.join(reconciled, "statement_id", "left").join(several, "statement_id", "left").join(layout, "statement_id", "left")
    results = results.select(
        "statement_id", "template_id", status(F.col("matched"), F.coalesce("n", F.lit(0)), F.coalesce("trust_level", F.lit("low")), F.coalesce(failed, F.lit(0)), F.col("margin"), F.coalesce("multiple", F.lit(False))).alias("status"),
        F.coalesce("trust_level", F.lit("low")).alias("trust_level"), "score", F.coalesce("n", F.lit(0)).alias("row_count"), "detail", "layout.signature", "layout.hint",
    )
    return Result(results, tx, reconciled, detection, diagnostics.build(reconciled, detection, tx, documents), statements)


def _several(lines: DataFrame, printed: DataFrame) -> DataFrame:
    """Whether a file holds several statements: first pages, labels, or periods that are no one span."""
    seen = labels.multiple_statements(lines).join(printed.select("statement_id", "n_periods", "merged"), "statement_id", "left")
    merged = F.coalesce("merged", F.lit(False))
    return seen.withColumn("multiple", (F.col("first_pages") > 1) | ~merged & ((F.col("openings") > 1) & (F.col("closings") > 1) | (F.coalesce("n_periods", F.lit(0)) > 1))).drop("n_periods", "merged")


def _forced(detection: DataFrame, force: str | None) -> DataFrame:
    if force:
        detection = detection.withColumns({"template_id": F.lit(force), "matched": F.lit(True), "margin": F.lit(None).cast("double"), "tied": F.array().cast("array<string>")})
    return stored(detection.select("statement_id", "template_id", "matched", F.col("margin").cast("double").alias("margin"), "tied", "detail"), "detection")


def _of_delimited(spark: SparkSession, files: DataFrame, templates: dict[str, dict], force: str | None) -> Result:
    """Delimited files. Each template has its own expressions; files are dealt to them by detection."""
    lines = stored(delimited.lines(files), "lines")
    heads = []
    for template in templates.values():  # a template says where the header is and how it is cut
        rule = (template.get("preamble") or {}).get("header_regex")
        marks = [str(m) for m in (template.get("fingerprint") or {}).get("header_contains_all") or []]
        own = delimited.header_line(lines, rule).where("header_no is not null")
        cut = delimited.resolve_delimiter(F.col("header"), marks, delimiters(template))
        heads.append(own.select("statement_id", F.lit(template["id"]).alias("template_id"), "header_no", delimited.header_cells(F.col("header"), cut).alias("header_cells")))
    known = frame(spark, templates)
    found = _merged(heads)
    cells = files.select("statement_id", "path", "kind").join(known, F.col("kind") == F.col("format")).join(found.drop("header_no"), ["statement_id", "template_id"], "left")
    score = detect.header_score(F.coalesce("header_cells", F.array().cast("array<string>")), F.col("header_marks"))
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    hit = F.coalesce((F.col("filename_regex") != "") & F.regexp_like(name, F.col("filename_regex")), F.lit(False)).cast("int")
    detection = _forced(detect.judged(cells.select("statement_id", "template_id", "origin_rank", "min_score", score.cast("double").alias("score"), hit.alias("filename_hit")), files), force)
    tx, counters, headers = [], [], []
    for name, template in templates.items():
        mine = detection.where((F.col("template_id") == name) & F.col("matched")).select("statement_id")
        part, count = parse.parse_delimited(lines.join(mine, "statement_id", "left_semi"), template)
        tx.append(part), counters.append(count), headers.append(parse.header(mine, template))
    above = facts.preamble(lines, detection.where("matched").join(found.select("statement_id", "template_id", "header_no"), ["statement_id", "template_id"]))
    above = stored(above, "preambles")
    printed = stored(facts.printed(above), "facts")
    tokens = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.lower("header"), "[,\t;|]"), lambda c: F.trim(c)), lambda c: c != "")))
    layout = delimited.header_line(lines).select("statement_id", layout_signature(tokens).alias("layout"))
    return _result(detection, _merged(tx), _merged(counters), facts.with_printed(_merged(headers), printed), _several(above, printed), layout)


def _of_workbooks(spark: SparkSession, files: DataFrame, templates: dict[str, dict], force: str | None) -> tuple[Result, DataFrame]:
    """Workbooks, and those that give no rows with the reason."""
    scanned = stored(excel.scanned(files), "sheets")
    none = F.lit(None).cast("int")
    records = excel.repaired_dates(scanned.where("error is null").drop("error").withColumns({"field_count": none, "expected": none, "span": F.array("row_id")}))
    heads = scanned.where("error is null").groupBy("statement_id").agg(F.map_keys(F.min_by("cells", "row_id")).alias("header_cells"))
    own = files.join(heads, "statement_id").withColumns({"kind": F.lit("excel"), "page_text": F.lit("")})
    detection = _forced(detect.detect(own.select("statement_id", "kind", "header_cells", "page_text", "path"), frame(spark, templates)), force)
    tx, headers = [], []
    for name, template in templates.items():
        mine = detection.where((F.col("template_id") == name) & F.col("matched")).select("statement_id")
        tx.append(parse.transactions(records.join(mine, "statement_id", "left_semi"), template))
        headers.append(parse.header(mine, template))
    tokens = F.array_sort(F.array_distinct(F.transform("header_cells", lambda c: F.lower(F.trim(c)))))
    above = scanned.where("error is null").groupBy("statement_id").agg(F.min_by("preamble", "row_id").alias("t")).select("statement_id", F.lit(1).alias("page"), F.posexplode(F.split("t", "\n")).alias("line_no", "text")).where("trim(text) <> ''")
    above = stored(above, "preambles")
    printed = stored(facts.printed(above), "facts")
    return _result(detection, _merged(tx), None, facts.with_printed(_merged(headers), printed), _several(above, printed), heads.select("statement_id", layout_signature(tokens).alias("layout"))), scanned.where("error is not null").select("statement_id", "error")


def _of_pages(spark: SparkSession, files: DataFrame, templates: dict[str, dict], force: str | None, reader: Callable[[bytes], pd.DataFrame]) -> Result:
    """Files of positioned words, which the plug-in `reader` gives."""
    return convert_words(spark, pages.guarded(pages.read_with(files, reader)), templates, force, files.select("statement_id", "path", "kind"))


def convert_words(spark: SparkSession, words: DataFrame, templates: dict[str, dict], force: str | None = None, files: DataFrame | None = None) -> Result:
    """Convert positioned words (see `schema.WORDS`); `files` may name their paths. Bundles are cut where that is proven."""
    words = stored(words, "words")
    if files is None:
        files = words.select("statement_id", F.lit("").alias("path"), F.lit("pdf").alias("kind")).distinct()
    text = stored(pages_text(words), "text")
    whole = text.groupBy("statement_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))), lambda s: s["text"]), "\n").alias("page_text"))
    own = files.select("statement_id", "path", "kind").join(whole, "statement_id", "left").withColumns({"header_cells": F.array().cast("array<string>"), "page_text": F.coalesce("page_text", F.lit(""))})
    detection = _forced(detect.detect(own.select("statement_id", "kind", "header_cells", "page_text", "path"), frame(spark, templates)), force)
    # parts of bundles are read under keys of their own, beside the whole files
    rules = {k: split.settings(t) for k, t in templates.items()}
    rule = F.create_map(*(x for k, r in rules.items() if r for x in (F.lit(k), F.struct(F.lit(r["on"]).alias("on"), F.lit(r["least"]).alias("least"))))) if any(rules.values()) else F.lit(None).cast("map<string,struct<on:string,least:int>>")
    wanted = detection.where("matched").select("statement_id", F.try_element_at(rule, F.col("template_id")).alias("r")).where("r is not null").select("statement_id", "r.on", "r.least")
    parts = stored(split.candidates(text, wanted), "parts")
    words_of, text_of = stored(split.dealt(words, parts), "words"), stored(split.dealt(text, parts), "text")
    chosen = detection.where("matched").select("statement_id", "template_id")
    chosen = chosen.unionByName(chosen.join(parts.select("statement_id", "part"), "statement_id").select(F.col("part").alias("statement_id"), "template_id"))
    printed = stored(facts.printed(text_of), "facts")
    ocr = words_of.groupBy("statement_id").agg(F.count_distinct(F.when(F.col("ocr_conf").isNotNull(), F.col("page"))).cast("int").alias("ocr_pages"), F.min("ocr_conf").alias("ocr_min_confidence"), F.max("page").alias("pages"))
    # a file that may be a bundle is read as a whole only where one of its parts gives nothing
    read = lambda keys: _read_words(words_of, keys, templates, printed, ocr.drop("pages"))
    tx, counters, headers = read(chosen.join(parts.select("statement_id").distinct(), "statement_id", "left_anti"))
    tx = stored(tx, "transactions")
    failed = stored(parts.join(tx.select(F.col("statement_id").alias("part")).distinct(), "part", "left_anti").select("statement_id").distinct(), "unread")
    if not failed.isEmpty():
        tx, counters, headers = (a.unionByName(b) for a, b in zip((tx, counters, headers), read(chosen.join(failed, "statement_id", "left_semi"))))
    layout = whole.select("statement_id", layout_signature(F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.substring_index("page_text", "\n", 12)), r"\s+"), lambda t: t.rlike("^[a-z]{3,}$"))))).alias("layout"))
    several = _several(text, printed)
    documents = ocr.join(several.select("statement_id", "multiple"), "statement_id")
    out = _result(detection, tx, counters, headers, several, layout, documents, parts)
    out.lines = text
    return out


def _read_words(words: DataFrame, keys: DataFrame, templates: dict[str, dict], printed: DataFrame, ocr: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transactions, counters and headers of the words under `keys` (statement_id, template_id)."""
    tx, counters, headers = [], [], []
    for name, template in templates.items():
        mine = keys.where(F.col("template_id") == name).select("statement_id")
        head = facts.with_printed(parse.header(mine, template).drop("ocr_pages", "ocr_min_confidence"), printed).join(ocr, "statement_id", "left")
        own = words.join(mine, "statement_id", "left_semi")
        pins = (template.get("table") or {}).get("metadata_regions") or {}
        if pins:
            head = pdf_table.with_pins(head, pdf_table.pinned(own, pins))
        part, count = pdf_table.transactions(own, template, head)
        tx.append(part), counters.append(count), headers.append(head)
    return _merged(tx), _merged(counters), _merged(headers)


def form_results(results: DataFrame, lines: DataFrame, forms: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """`results` with the documents that no statement template reads tried as forms, and the fields of those that are.

    A form is the one whose phrases all stand in the text, the one with the most; with two as specific, none. One without a
    value stays unsupported; a conflict or a missing required value needs review. `forms` is a bounded, driver-side set.
    """
    open_ = results.where("status = 'unsupported'").select("statement_id")
    own = stored(lines.join(open_, "statement_id", "left_semi"), "form-lines")
    phrases = {k: [str(p) for p in (f.get("fingerprint") or {}).get("page_contains_all") or []] for k, f in forms.items()}
    chosen = stored(labels.detect_form(own, phrases), "forms")
    parts = [labels.form_fields(own.join(chosen.where((F.col("form") == k) & F.col("matched")), "statement_id", "left_semi"), labels.field_specs(f.get("fields"))).withColumn("form", F.lit(k)) for k, f in forms.items()]
    fields = stored(_merged(parts), "fields")
    filled = F.count_if(F.col("value").isNotNull() & (F.col("value") != "")).alias("__values")
    sums = fields.groupBy("statement_id", "form").agg(F.count("*").alias("__n"), filled, F.count_if("conflict").alias("__conflicts"), F.count_if("flagged").alias("__flagged"))
    state = F.when(F.col("__values") == 0, "unsupported").when(F.col("__flagged") > 0, "needs_review").otherwise("ok")
    text = lambda c: F.col(c).cast("string")
    said = F.when(F.col("__conflicts") > 0, F.concat(text("__conflicts"), F.lit(" label(s) stand there with different values"))).when(F.col("__flagged") > 0, F.concat(text("__flagged"), F.lit(" required field(s) not found"))).otherwise(F.concat(text("__values"), F.lit(" of "), text("__n"), F.lit(" value(s) found")))
    is_form = F.col("form").isNotNull()
    rows = results.join(sums, "statement_id", "left")
    new = {"template_id": F.when(is_form, F.col("form")).otherwise(F.col("template_id")), "status": F.when(is_form, state).otherwise(F.col("status")), "detail": F.when(is_form, said).otherwise(F.col("detail")), "row_count": F.when(is_form, F.col("__values")).otherwise(F.col("row_count"))}
    return rows.withColumns(new | {"kind": F.when(is_form, "form").otherwise("statement")}).select(*results.columns, "kind"), fields


def run_records(found: Result, ts: str, requested_by: str = "") -> DataFrame:
    """A record of `schema.RUN` for every file of a conversion, to be appended to the log of runs."""
    failed = found.reconciled.select("statement_id", F.size(F.filter("kpis", lambda k: k["status"] == "fail")).alias("__failed"))
    printed = found.statements.groupBy("statement_id").agg(F.lit(True).alias("__split")) if found.statements is not None else None
    rows = found.results.join(failed, "statement_id", "left")
    rows = rows.join(printed, "statement_id", "left") if printed is not None else rows.withColumn("__split", F.lit(None).cast("boolean"))
    kind = F.col("kind") if "kind" in found.results.columns else F.lit("statement")
    known = {
        "ts": F.lit(ts), "run_id": F.substring(F.sha2(F.concat_ws("|", F.lit(ts), "statement_id"), 256), 1, 16), "kind": kind, "requested_by": F.lit(requested_by), "source_file": F.regexp_extract("path", r"([^/\\]+)$", 1), "source_sha256": F.col("statement_id"),
        "detected_template": F.col("template_id"), "detect_detail": F.col("detail"), "layout_signature": F.col("signature"), "layout_hint": F.col("hint"), "status": F.col("status"), "trust_level": F.col("trust_level"), "row_count": F.when(kind == "statement", F.col("row_count")),
        "n_fields": F.when(kind == "form", F.col("row_count")), "kpi_fail_count": F.coalesce("__failed", F.lit(0)), "multiple_statements": F.coalesce("__split", F.lit(False)), "message": F.col("detail"),
    }
    columns = [c.split() for c in RUN.split(", ")]
    return rows.select(*(known.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns))


def pages_text(words: DataFrame) -> DataFrame:
    """statement_id, page, line_no and text of the lines of pages of words."""
    return geometry.lines(words).select("statement_id", "page", F.col("line").cast("int").alias("line_no"), "text")


def convert(
    spark: SparkSession, path: str, templates: dict[str, dict], force: str | None = None, reader: Callable[[bytes], pd.DataFrame] | None = None, lexicon: dict | None = None, label_words: dict | None = None,
    forms: dict[str, dict] | None = None,
) -> Result:
    """Convert every file under a path, of every kind; each has a row in `results`, with the reason where nothing was read.

    `reader` turns the bytes of a page file into words (see `sources.pages.read_with`); without one such files are
    reported as unsupported. Copies of a file count once. `lexicon` and `label_words` are a site's own vocabulary and labels:
    every expression of the conversion is built from them. Pages that are no statement are tried as one of `forms`.
    """
    with vocab.using(lexicon, label_words):
        return _convert(spark, path, templates, force, reader, forms or {})


def _convert(spark: SparkSession, path: str, templates: dict[str, dict], force: str | None, reader: Callable[[bytes], pd.DataFrame] | None, forms: dict[str, dict]) -> Result:
    contents = delimited.scan(spark, path)
    files = stored(contents.select("statement_id", "path", "kind"), "files")  # bytes are read where they are parsed, once
    of = lambda kind: {k: t for k, t in templates.items() if t.get("format", "delimited") == kind}
    have = {r["kind"] for r in files.select("kind").distinct().collect()}
    parts, lost = [], [files.where("kind is null").select("statement_id", F.lit("no reader for this kind of file").alias("error"))]
    if "delimited" in have and of("delimited"):
        parts.append(_of_delimited(spark, contents.where("kind = 'delimited'"), of("delimited"), force if force in of("delimited") else None))
    if "excel" in have and of("excel"):
        part, errors = _of_workbooks(spark, contents.where("kind = 'excel'"), of("excel"), force if force in of("excel") else None)
        parts.append(part), lost.append(errors)
    if "pdf" in have and (of("pdf") or forms) and reader:
        parts.append(_of_pages(spark, contents.where("kind = 'pdf'"), of("pdf"), force if force in of("pdf") else None, reader))
    none = lambda t: F.lit(None).cast(t)
    failed = _merged(lost)
    done = _merged([failed.select("statement_id"), *(p.results.select("statement_id") for p in parts)])
    left = files.join(done, "statement_id", "left_anti").select("statement_id", F.when(F.col("kind") == "pdf", "no reader for pages, or no template of pages").otherwise("no template for this kind of file").alias("error"))
    odd = _merged([failed.withColumn("status", F.lit("failed")), left.withColumn("status", F.lit("unsupported"))])
    rows = odd.select("statement_id", none("string").alias("template_id"), "status", F.lit("low").alias("trust_level"), none("int").alias("score"), F.lit(0).cast("long").alias("row_count"), F.col("error").alias("detail"), none("string").alias("signature"), none("string").alias("hint"))
    notes = diagnostics.described(diagnostics.of_documents(odd.select("statement_id", "error")))
    if not parts:  # every file still has its row
        nothing = spark.createDataFrame([], "statement_id string").withColumns({"template_id": none("string"), "matched": none("boolean"), "margin": none("double"), "tied": none("array<string>"), "detail": none("string")})
        parts.append(_result(nothing, coerce_core(spark.createDataFrame([], "statement_id string"), "statement_id"), None, spark.createDataFrame([], HEADER), spark.createDataFrame([], "statement_id string, multiple boolean"), spark.createDataFrame([], "statement_id string, layout struct<signature:string,hint:string>")))
    results = _merged([*(p.results for p in parts), rows]).join(files.select("statement_id", "path"), "statement_id", "left")
    results, fields, lines = results.withColumn("kind", F.lit("statement")), None, next((p.lines for p in parts if p.lines is not None), None)
    if forms and lines is not None:
        results, fields = form_results(results.drop("kind"), lines, forms)
    statements = next((p.statements for p in parts if p.statements is not None), None)
    return Result(results, _merged([p.transactions for p in parts]), _merged([p.reconciled for p in parts]), _merged([p.detection for p in parts]), _merged([*(p.diagnostics for p in parts), notes]), statements, lines, fields)


def convert_delimited(spark: SparkSession, path: str, templates: dict[str, dict], force: str | None = None) -> Result:
    """Convert every delimited file under a path."""
    return _of_delimited(spark, delimited.scan(spark, path).where("kind = 'delimited'"), templates, force)
