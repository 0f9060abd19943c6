"""Positioned words to the transactions table: rows, bands, stitching, wrapped lines, dates without a year.

Rows and cells are native expressions. Stitching of split rows and merging of wrapped lines carry state down a page; they
run in one pass over sorted pages; a page bounds what is held.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import dates, money, text
from ..params import OCR_CELL_MIN_CONF
from ..schema import coerce_core
from ..storage import stored
from . import geometry, labels
from .rows import ACTIONABLE, has_amount, keep_row, row_code

CELLS = ["date", "description", "amount", "debit", "credit", "balance", "particulars", "code", "reference", "other_party", "type"]
AMOUNTS = ("amount", "debit", "credit")


def visual_rows(words: DataFrame, template: dict, pages: DataFrame | None = None) -> DataFrame:
    """Rows of each page with the text of every band, in the template's frame."""
    table = template.get("table") or {}
    if pages is not None:
        words = geometry.to_frame(words, pages, float(table.get("ref_width") or geometry.A4_WIDTH), float(table.get("ref_height") or geometry.A4_HEIGHT))
    region = {k: float(v) for k, v in (table.get("region") or {}).items() if v is not None}
    placed = geometry.rows(words.where(geometry.in_region(**region)), float(table.get("row_tol") or geometry.ROW_TOLERANCE))
    bands = {k: b for k, b in (table.get("columns") or {}).items() if b}
    out = geometry.cells(placed, bands)
    for c in CELLS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def _blank(v) -> bool:
    return v is None or (isinstance(v, float) and v != v) or not str(v).strip()


def _joined(a, b) -> str:
    return " ".join(str(v).strip() for v in (a, b) if not _blank(v))


def stitched(page: list[dict]) -> list[dict]:
    """A row with a date and no amount takes in the next one if that has an amount and no date and stands close below."""
    out, at = [], 0
    while at < len(page):
        row = dict(page[at])
        nxt = page[at + 1] if at + 1 < len(page) else None
        amount = lambda r: any(re.search(r"[0-9]|REDACT", str(r[c]), re.I) for c in AMOUNTS if not _blank(r[c]))
        if nxt and not _blank(row["date"]) and not amount(row) and _blank(nxt["date"]) and amount(nxt) and nxt["y0"] - row["y1"] <= 1.2 * max(row["h"] or 0, 1):
            for c in CELLS:
                if c == "description":
                    row[c] = _joined(row[c], nxt[c])
                elif _blank(row[c]):
                    row[c] = nxt[c]
            row["raw"], row["y1"], row["stitched"] = _joined(row["raw"], nxt["raw"]), max(row["y1"], nxt["y1"]), True
            row["conf"] = min((c for c in (row["conf"], nxt["conf"]) if not _blank(c)), default=None)
            at += 1
        out.append(row)
        at += 1
    return out


def sign_markers() -> frozenset[str]:
    """The words that give an amount its sign, in the vocabulary in effect."""
    return frozenset(w.upper() for c in ("dr_cr_suffix_credit", "dr_cr_suffix_debit") for w in vocab.lexicon()[c])


def signed_below(row: dict, last: dict, markers: frozenset[str]) -> bool:
    """A line of nothing but sign markers gives them to the figures above in the same bands, if those have none yet."""
    words = str(row["raw"] or "").upper().split()
    if not words or not markers.issuperset(words):
        return False
    moved, marked = False, r"(^|[^A-Za-z])(" + "|".join(map(re.escape, sorted(markers))) + r")\s*$"
    for c in (*AMOUNTS, "balance"):
        if not _blank(row[c]) and not _blank(last[c]) and re.search("[0-9]", str(last[c])) and not re.search(marked, str(last[c]).strip().upper()):
            last[c], moved = _joined(last[c], row[c]), True
    return moved


def continued(page: list[dict], markers: frozenset[str]) -> list[dict]:
    """Lines without date and figures that follow a transaction closely: a sign goes to its amount, other text to its
    own column, and what has none to the description."""
    last, last_y = None, 0.0
    own = ("particulars", "code", "reference", "other_party", "type")
    for row in page:
        if row["txn"]:
            last, last_y = row, row["y1"]
            continue
        close = last is not None and -max(last["h"] or 0, 1) <= row["y0"] - last_y <= 0.9 * max(last["h"] or 0, 1)
        plain = _blank(row["date"]) and not any(re.search("[0-9]", str(row[c])) for c in (*AMOUNTS, "balance") if not _blank(row[c]))
        if close and signed_below(row, last, markers):
            row["attached"], last_y = True, row["y1"]
        elif close and plain and not row["noise"]:
            for c in own:
                if not _blank(row[c]):
                    last[c] = _joined(last[c], row[c])
            rest = row["raw"] if all(_blank(row[c]) for c in own) else _joined(row["description"], " ".join(str(row[c]) for c in (*AMOUNTS, "balance") if not _blank(row[c])))
            last["description"] = _joined(last["description"], rest)
            last["merged"], row["attached"], last_y = True, True, row["y1"]
        else:
            last = None
    return page


def assembled(rows: DataFrame, merge: bool = True) -> DataFrame:
    """Visual rows with split rows joined and wrapped lines merged, page by page."""
    schema = "statement_id string, page int, row int, " + ", ".join(f"{c} string" for c in CELLS) + ", raw string, y0 double, y1 double, h double, conf double, stitched boolean, merged boolean, attached boolean"

    kinds = {"page": pa.int32(), "row": pa.int32(), **{c: pa.float64() for c in ("y0", "y1", "h", "conf")}, **{c: pa.bool_() for c in ("stitched", "merged", "attached")}}
    columns = [part.split()[0] for part in schema.split(", ")]
    markers = sign_markers()

    def finished(page: list[dict]) -> list[dict]:
        page = stitched([dict(r, stitched=False, merged=False, attached=False) for r in page])
        for r in page:
            r["txn"] = not _blank(r["date"]) and any(not _blank(r[c]) for c in AMOUNTS) and not r["noise"]
        return continued(page, markers) if merge else page

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come page by page; a page may go on in the next batch. Those of pages in order are handed on as they are."""
        page: list[dict] = []
        for batch in itertools.chain(batches, [None]):
            done: list[dict] = []
            if batch is not None and pc.any(batch.column("in_order")).as_py():
                plain, batch = batch.filter(batch.column("in_order")), batch.filter(pc.invert(batch.column("in_order")))
                none = pa.array([False] * plain.num_rows, pa.bool_())
                yield pa.RecordBatch.from_arrays([none if kinds.get(c) == pa.bool_() else plain.column(c).cast(kinds.get(c, pa.string())) for c in columns], columns)
            for r in batch.to_pylist() if batch is not None else [None]:
                if page and (r is None or (r["statement_id"], r["page"]) != (page[-1]["statement_id"], page[-1]["page"])):
                    done += finished(page)
                    page = []
                if r is not None:
                    page.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], kinds.get(c, pa.string())) for c in columns], columns)

    noise = text.is_summary_line(F.col("raw")) | text.is_summary_line(F.col("description")) | text.is_footer(F.col("raw"))
    names = ["statement_id", "page", "row", *CELLS, "raw", "y0", "y1", "h", "conf"]
    dealt = rows.select(*names, F.coalesce(noise, F.lit(False)).alias("noise")).withColumn("in_order", in_order())
    return dealt.repartition("statement_id", "page").sortWithinPartitions("statement_id", "page", "row").mapInArrow(run, schema)


def in_order() -> Column:
    """Whether a row's page surely has nothing to join or merge: lines without a date, then nothing but whole transactions."""
    page = Window.partitionBy("statement_id", "page")
    figure = lambda c: F.coalesce(F.col(c).rlike("[0-9]"), F.lit(False))
    undated = F.coalesce(F.col("date") == "", F.lit(True))
    whole = F.coalesce(F.col("date").rlike("[0-9A-Za-z]"), F.lit(False)) & (figure("amount") | figure("debit") | figure("credit")) & ~F.col("noise")
    above, below = F.max(F.when(~whole, F.col("row"))).over(page), F.min(F.when(whole, F.col("row"))).over(page)
    return F.bool_and(undated | whole).over(page) & F.coalesce(above < below, F.lit(True))


def year_context(headers: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """statement_id, ps, pe, years and inferred: the years of the period, else of the statement's date, else the only year
    that the pages print."""
    ps, pe = dates.period_date(F.col("period_start")), dates.period_date(F.col("period_end"))
    printed = dates.period_date(F.col("statement_date")) if "statement_date" in headers.columns else F.lit(None).cast("date")
    rows = headers.select("statement_id", ps.alias("ps"), pe.alias("pe"), printed.alias("sd"))
    rows = rows.withColumn("years", F.array_distinct(F.array_compact(F.array(F.year("ps"), F.year("pe")))))
    rows = rows.withColumn("years", F.when(F.size("years") > 0, F.col("years")).otherwise(F.array_compact(F.array(F.year("sd")))))
    if pages is None:
        return rows.withColumn("inferred", F.lit(False)).drop("sd")
    found = pages.select("statement_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b(?:19|20)[0-9]{2}\b"), F.lit(0))).alias("y")).where(F.col("y").cast("int").between(1990, 2100))
    only = found.groupBy("statement_id").agg(F.collect_set(F.col("y").cast("int")).alias("ys")).where(F.size("ys") == 1)
    rows = rows.join(only, "statement_id", "left").withColumn("inferred", (F.size("years") == 0) & F.col("ys").isNotNull())
    return rows.withColumn("years", F.when(F.col("inferred"), F.col("ys")).otherwise(F.col("years"))).drop("sd", "ys")


def pinned(words: DataFrame, pins: dict[str, dict], kinds: dict[str, str] | None = None) -> DataFrame:
    """statement_id and the value of each pin: the text in a drawn box (page, x_min, x_max, y_min, y_max) as a typed value.

    Pins are a template's literals: each word is held against all boxes in one pass.
    """
    kinds = {"opening_balance": "money", "closing_balance": "money"} | (kinds or {})
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    word = F.struct(F.floor(F.col("y") / 3).alias("line"), "x", "word_idx", "text")
    cells = {}
    for name, b in pins.items():
        inside = (F.col("page") == int(b.get("page", 1))) & cx.between(float(b["x_min"]), float(b["x_max"])) & cy.between(float(b["y_min"]), float(b["y_max"]))
        cells[name] = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, word))), lambda w: w["text"]), " ")
    found = words.groupBy("statement_id").agg(*(c.alias(n) for n, c in cells.items()))
    return found.select("statement_id", *(labels.value_in(F.col(n), kinds.get(n, "text")).alias(n) for n in pins))


def with_pins(headers: DataFrame, pins: DataFrame) -> DataFrame:
    """Headers with the pinned values where there are any; a value that was read is never replaced by nothing."""
    names = [c for c in pins.columns if c != "statement_id"]
    own = pins.select("statement_id", *(F.col(c).alias(f"__{c}") for c in names))
    out = headers.join(own, "statement_id", "left")
    kind = dict(headers.dtypes)
    for c in names:
        value = money.number(F.col(f"__{c}")) if kind.get(c) == "double" else F.col(f"__{c}")
        out = out.withColumn(c, F.coalesce(value, F.col(c)) if c in kind else value)
    return out.drop(*(f"__{c}" for c in names))


def leading(x: Column, parts: int) -> Column:
    """The first words of a cell: as many as the date format has."""
    return F.array_join(F.slice(F.split(F.trim(x), r"\s+"), 1, parts), " ")


def transactions(words: DataFrame, template: dict, headers: DataFrame, pages: DataFrame | None = None, forced: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """Transactions of positioned words, and the counters of what was skipped and why."""
    table = template.get("table") or {}
    style = table.get("amount_sign") or template.get("amount_sign") or "signed"
    decimal = template.get("decimal_mark") or table.get("decimal_mark") or "auto"
    fmt = table.get("date_format") or "%d/%m/%Y"
    rows = assembled(visual_rows(words, template, pages), table.get("merge_continuation", True) is not False).where("not attached")
    rows = rows.join(year_context(headers, pages), "statement_id", "left")
    first = leading(F.col("date"), len(fmt.split()))
    if "%Y" in fmt or "%y" in fmt:
        day = dates.strict(first, fmt)
        inferred, unresolved = F.lit(False), F.lit(False)
    else:
        day = dates.with_year(first, F.col("years"), F.col("ps"), F.col("pe"), fmt)
        inferred, unresolved = F.coalesce("inferred", F.lit(False)) & day.isNotNull(), (F.size("years") < 1) & dates.strict(F.concat_ws(" ", first, F.lit("2000")), f"{fmt} %Y").isNotNull()
    # only where the declared format reads no date of the whole document: day and month by name, the year from the period
    two = leading(F.col("date"), 2)
    named = F.coalesce(*(dates.with_year(two, F.col("years"), F.col("ps"), F.col("pe"), f) for f in ("%d %b", "%b %d")))
    rows = rows.withColumn("__main", day).withColumn("__none", ~F.max(F.col("__main").isNotNull()).over(Window.partitionBy("statement_id")))
    other = F.when(F.col("__none") & (F.size("years") > 0), named)
    day = F.coalesce("__main", other)
    cell = F.concat_ws(" ", "debit", "credit") if style == "debit_credit_cols" else F.col("amount")
    summary = text.is_summary_line(F.col("description")) | text.is_summary_line(F.col("raw"))
    hidden_date = text.is_redacted(F.col("date"))
    rows = rows.withColumns({"__other": F.col("__main").isNull() & other.isNotNull(), "__day": day, "__cell": cell, "__summary": summary, "__inferred": inferred, "__unresolved": F.coalesce(unresolved, F.lit(False))})
    band = F.lit(False)
    for f in forced or []:
        band |= (F.col("page") == int(f["page"])) & (F.col("y1") >= float(f.get("y_min", "-inf"))) & (F.col("y0") <= float(f.get("y_max", "inf")))
    dated = F.col("__day").isNotNull() | F.col("__unresolved")
    keep = keep_row(F.col("__summary"), F.col("__cell"), dated, hidden_date, bool(table.get("keep_dateless_rows")))
    rows = rows.withColumns({"kept": keep | band, "forced": band & ~keep, "verdict": F.when(keep | band, "kept").otherwise(row_code(F.col("__summary"), F.col("__cell"), dated))})
    rows = stored(rows, "rows")  # transactions and counters both read these: rows and dates are worked out once
    counters = rows.groupBy("statement_id").agg(
        F.lit(None).cast("int").alias("source_lines"), F.lit(None).cast("int").alias("multiline_extra"), F.count_if(~F.col("kept")).cast("int").alias("skipped_rows"), F.count("*").cast("int").alias("visual_rows"), F.count_if(F.col("verdict").isin(*ACTIONABLE)).cast("int").alias("actionable")
    )
    value = money.amount(style, F.col("amount"), F.col("debit"), F.col("credit"), F.col("type"), str(template.get("type_debit_value") or table.get("type_debit_value") or "D"), template.get("type_credit_value") or table.get("type_credit_value"), template.get("unsigned_default") or table.get("unsigned_default") or "debit", decimal)
    hidden = text.is_redacted(F.col("__cell"))
    kept = rows.where("kept").withColumn("__value", value)
    order = Window.partitionBy("statement_id").orderBy("page", "row")
    any_hidden = hidden | text.is_redacted(F.col("description")) | text.is_redacted(F.col("date"))
    flags = text.flags(
        ("redacted", any_hidden), ("malformed", F.col("__value").isNull() & ~any_hidden), ("date_unresolved", F.col("__unresolved") & F.col("__day").isNull()), ("date_year_inferred", F.col("__inferred")),
        ("no_date", F.col("__day").isNull() & ~F.col("__unresolved")), ("forced", F.col("forced")), ("row_stitched", F.col("stitched")), ("row_text_merged", F.col("merged")),
        ("ocr_low_conf", F.col("conf") < OCR_CELL_MIN_CONF), ("date_alt_format", F.col("__other")),
    )
    out = kept.select(
        "statement_id", F.row_number().over(order).alias("row_id"), F.date_format("__day", "yyyy-MM-dd").alias("date"), F.col("date").alias("date_raw"), text.clean_description(F.col("description")).alias("description"),
        F.when(~hidden, F.col("__value")).alias("amount"), F.col("__cell").alias("amount_raw"), F.when(~hidden, money.direction(F.col("__value"))).alias("direction"), money.number(F.col("balance"), decimal).alias("balance"), F.col("balance").alias("balance_raw"),
        *(text.blank_to_null(F.col(c)).alias(c) for c in ("particulars", "code", "reference", "other_party", "type")),
        F.lit(template.get("currency") or "NZD").alias("currency"), text.join_flags(flags).alias("flags"), F.concat(F.lit("pdf:p"), F.col("page").cast("string")).alias("source_ref"), "raw",
    )
    return coerce_core(out, "statement_id", "source_ref", "raw"), counters


def xray(words: DataFrame, template: dict, pages: DataFrame | None = None) -> DataFrame:
    """Every visual row with its verdict, for a look at what a template reads."""
    table = template.get("table") or {}
    style = table.get("amount_sign") or "signed"
    rows = visual_rows(words, template, pages)
    cell = F.concat_ws(" ", "debit", "credit") if style == "debit_credit_cols" else F.col("amount")
    fmt = table.get("date_format") or "%d/%m/%Y"
    full = fmt if "%Y" in fmt or "%y" in fmt else f"{fmt} %Y"
    first = leading(F.col("date"), len(fmt.split()))
    dated = dates.strict(first if full == fmt else F.concat_ws(" ", first, F.lit("2000")), full).isNotNull()
    summary = text.is_summary_line(F.col("description")) | text.is_summary_line(F.col("raw"))
    return rows.withColumns({"kept": keep_row(summary, cell, dated), "verdict": row_code(summary, cell, dated), "has_amount": has_amount(cell)})
