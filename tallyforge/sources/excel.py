"""Workbooks: cells of the sheet that looks like a statement, read with the standard library on the executors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import excel_serial

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
LOOK = 30


def sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """Name and rows of text cells of each sheet of a workbook."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{{{NS['m']}}}t")) for item in root.findall("m:si", NS)]
        # a sheet's part is what the workbook's relations say, not what its number suggests
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{NS['m']}}}sheet"):
            target = links.get(sheet.get(f"{{{NS['r']}}}id"), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if "worksheets/" not in part or part not in book.namelist():
                continue
            rows: list[list[str]] = []
            for row in ElementTree.fromstring(book.read(part)).iter(f"{{{NS['m']}}}row"):
                cells: dict[int, str] = {}
                for at, cell in enumerate(row.findall("m:c", NS)):
                    letters = re.match(r"[A-Z]+", cell.get("r", ""))
                    place = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0]))) - 1 if letters else at
                    value = cell.find("m:v", NS)
                    text = "".join(t.text or "" for t in cell.iter(f"{{{NS['m']}}}t")) if cell.get("t") == "inlineStr" else value.text if value is not None and value.text else ""
                    cells[place] = shared[int(text)] if cell.get("t") == "s" and text.isdigit() and int(text) < len(shared) else text
                number = int(row.get("r") or len(rows) + 1)
                rows += [[] for _ in range(number - 1 - len(rows))]
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            out.append((sheet.get("name", part), rows))
    return out


def header_row(rows: list[list[str]]) -> int | None:
    """The first of the upper rows that names a date and an amount."""
    for i, row in enumerate(rows[:LOOK]):
        low = " ".join(row).lower()
        if "date" in low and re.search(r"amount|debit|credit|balance|withdraw|deposit", low):
            return i
    return None


def chosen(book: list[tuple[str, list[list[str]]]]) -> tuple[str, int, list[list[str]]] | None:
    """The sheet with a header and the most rows below it. All of its rows count, however many."""
    found = [(name, at, rows) for name, rows in book if (at := header_row(rows)) is not None]
    return max(found, key=lambda s: len(s[2]) - s[1], default=None)


def unique_names(names: list[str]) -> list[str]:
    """Blank headers get a number, repeated ones a suffix."""
    out: list[str] = []
    for i, name in enumerate(names):
        name = name.strip() or f"col{i + 1}"
        base, k = name, 1
        while name in out:
            name, k = f"{base}.{k}", k + 1
        out.append(name)
    return out


def scanned(files: DataFrame) -> DataFrame:
    """Rows (statement_id, row_id, cells, text, preamble) of workbooks; one that gives none has a single row with its error."""
    kind = "statement_id string, row_id int, cells map<string,string>, text string, preamble string, error string"

    def failed(key: str, why: str) -> pd.DataFrame:
        return pd.DataFrame({"statement_id": [key], "row_id": [None], "cells": [None], "text": [None], "preamble": [None], "error": [why]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, content in zip(batch["statement_id"], batch["content"]):
                try:
                    sheet = chosen(sheets(content))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as fault:
                    yield failed(key, f"the workbook can't be read: {type(fault).__name__}")
                    continue
                if sheet is None:
                    yield failed(key, "no sheet has a header with a date and an amount")
                    continue
                _, at, rows = sheet
                names = unique_names(rows[at])
                body = [r for r in rows[at + 1 :] if any(c.strip() for c in r)]
                if not body:
                    yield failed(key, "no row stands below the header")
                    continue
                preamble = "\n".join(" ".join(r) for r in rows[:at])
                wide = [(r + [""] * len(names))[: len(names)] for r in body]
                yield pd.DataFrame({"statement_id": key, "row_id": range(1, len(body) + 1), "cells": [dict(zip(names, r)) for r in wide], "text": ["\t".join(r) for r in body], "preamble": preamble, "error": None})

    return files.where("kind = 'excel'").select("statement_id", "content").mapInPandas(run, kind)


def read(files: DataFrame) -> DataFrame:
    """Records (statement_id, row_id, cells, field_count, expected, text, span) and preamble of workbooks."""
    none = F.lit(None).cast("int")
    return scanned(files).where("error is null").drop("error").withColumns({"field_count": none, "expected": none, "span": F.array("row_id")})


def repaired_dates(records: DataFrame, share: float = 0.6) -> DataFrame:
    """Day numbers in columns named as dates become ISO dates where most of a file's filled cells are day numbers."""
    cells = records.select("statement_id", F.explode("cells").alias("name", "value")).where(F.lower("name").contains("date") & (F.trim("value") != ""))
    serial = cells.groupBy("statement_id", "name").agg(F.avg(excel_serial(F.col("value")).isNotNull().cast("int")).alias("s")).where(F.col("s") >= share)
    named = serial.groupBy("statement_id").agg(F.collect_set("name").alias("__dates"))
    fixed = F.transform_values("cells", lambda k, v: F.when(F.array_contains("__dates", k) & excel_serial(v).isNotNull(), F.date_format(excel_serial(v), "yyyy-MM-dd")).otherwise(v))
    return records.join(named, "statement_id", "left").withColumn("cells", F.when(F.col("__dates").isNull(), F.col("cells")).otherwise(fixed)).drop("__dates")
