"""One front door for every kind of file: each has a result, unreadable ones a reason."""

from __future__ import annotations

from tallyforge import engine
from tallyforge.operators.outputs import workbook
from tallyforge.sources import excel

CSV = {"id": "csv", "bank": "B", "statement_type": "x", "format": "delimited", "fingerprint": {"header_contains_all": ["Date", "Memo", "Amount"]}, "min_score": 3, "columns": {"date": {"source": "Date", "format": "%Y-%m-%d"}, "description": {"source": "Memo"}, "amount": {"source": "Amount"}}}
SHEET = {**CSV, "id": "sheet", "format": "excel"}
PAGE = {
    "id": "page", "bank": "B", "statement_type": "x", "format": "pdf", "fingerprint": {"page_contains_all": ["Sample Bank", "Amount"]}, "min_score": 2,
    "table": {"date_format": "%d/%m/%Y", "columns": {"date": {"x_min": 0, "x_max": 100}, "description": {"x_min": 101, "x_max": 300}, "amount": {"x_min": 301, "x_max": 400}}},
}


def page_reader():
    """A stand-in for a page program: x, y and text on each line of the file."""

    def reader(content: bytes):
        import pandas as pd

        rows = [line.split(" ", 2) for line in content.decode().splitlines()]
        return pd.DataFrame({"page": 1, "word_idx": range(len(rows)), "x": [float(r[0]) for r in rows], "y": [float(r[1]) for r in rows], "width": 30.0, "height": 10.0, "text": [r[2] for r in rows], "redacted": False, "ocr_conf": None})

    return reader


def folder(tmp_path):
    (tmp_path / "a.csv").write_text("Date,Memo,Amount\n2024-01-01,one,5.00\n2024-01-02,two,-2.00\n")
    (tmp_path / "b.xlsx").write_bytes(workbook({"Notes": [["nothing"]], "Rows": [["Date", "Memo", "Amount"], ["2024-01-05", "x", 7.5], ["2024-01-06", "y", -1]]}))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "c.docx").write_bytes(b"text")
    (tmp_path / "d.pdf").write_text("10 20 Sample\n60 20 Bank\n310 50 Amount\n10 100 01/02/2024\n110 100 Shop\n310 100 12.50\n310 110 DR\n")
    return str(tmp_path)


def test_every_file_has_a_result(spark, tmp_path):
    found = engine.convert(spark, folder(tmp_path), {t["id"]: t for t in (CSV, SHEET, PAGE)}, reader=page_reader())
    rows = {r["path"].rsplit("/", 1)[1]: r for r in found.results.collect()}
    assert len(rows) == 5 and {n: rows[n]["row_count"] for n in ("a.csv", "b.xlsx", "d.pdf")} == {"a.csv": 2, "b.xlsx": 2, "d.pdf": 1}
    assert rows["a.csv"]["template_id"] == "csv" and rows["b.xlsx"]["template_id"] == "sheet" and rows["d.pdf"]["template_id"] == "page"
    assert rows["bad.xlsx"]["status"] == rows["c.docx"]["status"] == "failed" and "BadZipFile" in rows["bad.xlsx"]["detail"]
    amounts = sorted(r["amount"] for r in found.transactions.collect())
    assert amounts == [-12.5, -2.0, -1.0, 5.0, 7.5]
    notes = {r["statement_id"]: r["category"] for r in found.diagnostics.where("category = 'unreadable'").collect()}
    assert set(notes) == {rows["bad.xlsx"]["statement_id"], rows["c.docx"]["statement_id"]}


def test_pages_without_a_reader_are_reported(spark, tmp_path):
    found = engine.convert(spark, folder(tmp_path), {"csv": CSV, "sheet": SHEET})
    rows = {r["path"].rsplit("/", 1)[1]: r for r in found.results.collect()}
    assert rows["d.pdf"]["status"] == "unsupported" and "reader" in rows["d.pdf"]["detail"]


def test_sheets_follow_their_relations(spark):
    import io
    import zipfile

    book = io.BytesIO(workbook({"First": [["Date", "Amount"], ["2024-01-01", 1], ["2024-01-02", 2]], "Second": [["x"]]}))
    swapped = io.BytesIO()
    with zipfile.ZipFile(book) as old, zipfile.ZipFile(swapped, "w") as new:
        for name in old.namelist():
            text = old.read(name).decode()
            if name.endswith("workbook.xml.rels"):
                text = text.replace("sheet1.xml", "sheetX.xml").replace("sheet2.xml", "sheet1.xml").replace("sheetX.xml", "sheet2.xml")
            new.writestr(name, text)
    assert [(n, len(r)) for n, r in excel.sheets(swapped.getvalue())] == [("First", 1), ("Second", 3)]
