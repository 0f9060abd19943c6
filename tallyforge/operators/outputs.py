"""Outputs: display tables, CSV, full JSON records, and workbooks that come out byte for byte the same."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import neutralise

DROPPED = ("date_raw", "amount_raw", "balance_raw")
TEXT = ("description", "particulars", "code", "reference", "other_party", "type")
EPOCH = (1980, 1, 1, 0, 0, 0)


def display(tx: DataFrame, extras: tuple[str, ...] = (), key: str = "statement_id") -> DataFrame:
    """What a reader sees: no raw columns, debit and credit after amount, other extras last, no cell that acts as a formula."""
    names = [c for c in tx.columns if c not in DROPPED and c not in ("extras", "source_ref", "raw")]
    out = []
    for c in names:
        out.append(neutralise(F.col(c)).alias(c) if c in TEXT else F.col(c))
        if c == "amount":
            out += [F.try_element_at("extras", F.lit(e)).alias(e) for e in ("debit", "credit") if e in extras]
    out += [neutralise(F.try_element_at("extras", F.lit(e))).alias(e) for e in extras if e not in ("debit", "credit")]
    return tx.select(*out).orderBy(key, "row_id") if key in tx.columns else tx.select(*out)


def write_csv(shown: DataFrame, folder: str) -> None:
    """One folder of CSV per statement; null cells are empty."""
    shown.write.mode("overwrite").partitionBy("statement_id").option("header", "true").option("nullValue", "").option("emptyValue", "").csv(folder)


def json_records(tx: DataFrame, reconciled: DataFrame, headers: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """statement_id and record: all that is known of a statement, nulls included. A statement's rows are one record by contract."""
    core = [c for c in tx.columns if c not in ("statement_id", "source_ref", "raw", "extras")]
    rows = tx.groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct(*core))).alias("transactions"))
    if "source_ref" in tx.columns:
        proof = tx.groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "source_ref", "raw"))).alias("provenance"))
        rows = rows.join(proof, "statement_id")
    out = headers.withColumn("header", F.struct(*[c for c in headers.columns if c != "statement_id"])).select("statement_id", "header").join(rows, "statement_id", "left")
    out = out.join(reconciled.select("statement_id", "kpis", F.struct(F.col("trust_level").alias("level"), "score", "reasons", "completeness_verified").alias("trust")), "statement_id", "left")
    if diagnostics is not None:
        out = out.join(diagnostics.groupBy("statement_id").agg(F.collect_list(F.struct(*[c for c in diagnostics.columns if c != "statement_id"])).alias("diagnostics")), "statement_id", "left")
    return out.select("statement_id", F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("record"))


def stacked(headers: DataFrame) -> DataFrame:
    """A header as rows of field and value."""
    names = [c for c in headers.columns if c != "statement_id"]
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in names))
    return headers.select("statement_id", F.explode(pairs).alias("p")).select("statement_id", "p.field", "p.value")


def checks_table(reconciled: DataFrame) -> DataFrame:
    """Checks in report order, then the trust."""
    checks = reconciled.select("statement_id", F.posexplode_outer("kpis").alias("at", "k")).select("statement_id", "at", "k.name", "k.status", "k.expected", "k.actual", "k.discrepancy", "k.detail")
    none = F.lit(None).cast("string")
    level = reconciled.select("statement_id", F.lit(100).alias("at"), F.lit("trust").alias("name"), F.col("trust_level").alias("status"), none.alias("expected"), F.col("score").cast("string").alias("actual"), none.alias("discrepancy"), F.array_join("reasons", "; ").alias("detail"))
    return checks.unionByName(level)


def _column(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def workbook(tables: dict[str, list[list]]) -> bytes:
    """A workbook with a sheet per table, first row its header. The same tables give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:

        def put(name: str, text: str) -> None:
            info = zipfile.ZipInfo(name, EPOCH)
            info.compress_type = zipfile.ZIP_DEFLATED
            book.writestr(info, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)

        main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        sheets = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(tables)))
        put("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{sheets}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(tables)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{office}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(tables))) + "</Relationships>")
        for i, rows in enumerate(tables.values()):
            lines = []
            for r, row in enumerate(rows):
                cells = []
                for c, value in enumerate(row):
                    place = f"{_column(c)}{r + 1}"
                    if isinstance(value, bool) or value is None or value != value:
                        value = "" if value is None or value != value else str(value)
                    cells.append(f'<c r="{place}"><v>{value!r}</v></c>' if isinstance(value, (int, float)) else f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>')
                lines.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
            put(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(records: DataFrame) -> DataFrame:
    """statement_id and content of a workbook for each JSON record: Transactions, Summary, Checks, Provenance, Diagnostics."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        def rows(items: list[dict] | None) -> list[list]:
            items = items or []
            head = list(items[0]) if items else []
            return [head, *([item.get(h) for h in head] for item in items)]

        for batch in batches:
            out = []
            for record in batch["record"]:
                r = json.loads(record)
                summary = [{"field": k, "value": v} for k, v in (r.get("header") or {}).items()]
                out.append(workbook({"Transactions": rows(r.get("transactions")), "Summary": rows(summary), "Checks": rows(r.get("kpis")), "Provenance": rows(r.get("provenance")), "Diagnostics": rows(r.get("diagnostics")), "Metadata": rows([r.get("trust") or {}])}))
            yield pd.DataFrame({"statement_id": batch["statement_id"], "content": out})

    return records.mapInPandas(run, "statement_id string, content binary")
