"""Delimited files: bytes to lines, records and fields, as set operations over all files at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"csv": "delimited", "tsv": "delimited", "tdv": "delimited", "txt": "delimited", "xlsx": "excel", "xlsm": "excel", "pdf": "pdf"}


def kind_of(path: Column) -> Column:
    """The reader for a file name; null where there is none."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), suffix)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """One row per file content: statement_id (sha256), path, kind, content. Copies of a file count once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    out = files.select(F.sha2("content", 256).alias("statement_id"), "path", kind_of(F.col("path")).alias("kind"), "content")
    return out.groupBy("statement_id").agg(F.min_by(F.struct("path", "kind", "content"), "path").alias("f")).select("statement_id", "f.*")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of a file's bytes: UTF-16 or UTF-8 by its mark, valid UTF-8, else Windows-1252."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        for mark, code in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
            if data.startswith(mark):
                return data[len(mark) :].decode(code, "replace")
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return data.decode("cp1252", "replace")

    return content.map(one)


def lines(files: DataFrame, text: Column | None = None) -> DataFrame:
    """statement_id, line_no (from 1) and text of each line, whatever its ending."""
    split = F.split(text if text is not None else decoded("content"), r"\r\n|\r|\n", -1)
    rows = files.select("statement_id", F.posexplode(split).alias("at", "text"))
    return rows.select("statement_id", (F.col("at") + 1).alias("line_no"), "text")


def header_line(rows: DataFrame, header_regex: str | None = None) -> DataFrame:
    """The header's line number per file: the first that matches, or without a rule the first that isn't blank."""
    hit = F.col("text").rlike(header_regex) if header_regex else F.trim(F.regexp_replace("text", r"\s+", " ")) != ""
    return rows.groupBy("statement_id").agg(F.min(F.when(hit, F.col("line_no"))).alias("header_no"), F.min_by("text", F.when(hit, F.col("line_no"))).alias("header"))


def resolve_delimiter(header: Column, marks: list[str], candidates: list[str]) -> Column:
    """The first delimiter whose cells hold all marks, failing that the first."""
    out = F.lit(candidates[0])
    for d in reversed(candidates):
        cells = F.transform(F.split(F.lower(header), _quoted(d), -1), lambda c: F.trim(F.regexp_replace(c, '"', "")))
        out = F.when(F.size(F.array_except(F.array(*(F.lit(m.lower()) for m in marks)), cells)) == 0, F.lit(d)).otherwise(out)
    return out


def _quoted(delimiter: str) -> str:
    return "\\Q" + delimiter + "\\E"


def is_padding(text: Column, delimiter: Column) -> Column:
    """A line of delimiters alone."""
    return F.regexp_replace(F.replace(text, delimiter, F.lit("")), r"\s", "") == ""


def records(rows: DataFrame, key: str = "statement_id") -> DataFrame:
    """Logical records of lines (key, line_no, text): a quote left open takes the next lines in.

    Returns key, rec_no, text and span (its line numbers). The parity of quotes before a line says whether it begins a
    record; both running sums are windows over one file.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    before = F.coalesce(F.sum(quotes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = rows.withColumn("__new", (before % 2 == 0).cast("int"))
    numbered = marked.withColumn("rec_no", F.sum("__new").over(order))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return numbered.groupBy(key, "rec_no").agg(parts.alias("p")).select(key, "rec_no", F.array_join(F.col("p.text"), "\n").alias("text"), F.col("p.line_no").alias("span"))


def field_count(text: Column, delimiter: str) -> Column:
    """Cells of a record: delimiters outside quotes, and one."""
    bare = F.regexp_replace(text, '"[^"]*"', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))) / len(delimiter) + 1


def fields(text: Column, delimiter: str) -> Column:
    """The cells of a record. Quotes are read and doubled quotes are one; with a quote left open the text is cut blindly."""
    outside = _quoted(delimiter) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    plain = lambda c: F.replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))
    read = F.transform(F.split(text, outside, -1), lambda c: F.when(c.rlike(r'(?s)^\s*".*"\s*$'), plain(c)).otherwise(c))
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    return F.when(quotes % 2 == 0, read).otherwise(F.split(text, _quoted(delimiter), -1))


def fitted(cells: Column, width: Column) -> Column:
    """Short rows filled up with empty cells, long ones cut to the header's width."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def unique_names(cells: Column) -> Column:
    """Header names: a blank one is colN by its place, a repeat gets the first suffix .1, .2, ... that no earlier name has."""
    filled = F.transform(cells, lambda c, i: F.coalesce(F.nullif(c, F.lit("")), F.concat(F.lit("col"), (i + 1).cast("string"))))

    def step(done: Column, c: Column) -> Column:
        others = F.transform(F.sequence(F.lit(1), F.size(done) + 1), lambda k: F.concat(c, F.lit("."), k.cast("string")))
        free = F.get(F.array_except(others, done), F.lit(0))
        return F.array_append(done, F.when(F.array_contains(done, c), free).otherwise(c))

    return F.aggregate(filled, F.array().cast("array<string>"), step)


def header_cells(header: Column, delimiter: Column) -> Column:
    """The header's cells as they stand, trimmed and without quotes."""
    return F.transform(F.split(header, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")), -1), lambda c: F.trim(F.regexp_replace(c, '"', "")))


def read(rows: DataFrame, marks: list[str], candidates: list[str], header_regex: str | None = None) -> DataFrame:
    """Records of every file of `rows` (lines) under one template.

    statement_id, row_id, cells (map of header name to cell, names made unique), field_count, expected, text, span, header_no, data_lines,
    padding_lines.
    """
    head = header_line(rows, header_regex).where("header_no is not null").withColumn("delimiter", resolve_delimiter(F.col("header"), marks, candidates))
    head = head.withColumn("names", unique_names(header_cells(F.col("header"), F.col("delimiter"))))
    body = rows.join(head, "statement_id").where("line_no > header_no").where(F.regexp_replace("text", r"\s", "") != "")
    body = body.withColumn("padding", is_padding(F.col("text"), F.col("delimiter")))
    counts = body.groupBy("statement_id").agg(F.count_if(~F.col("padding")).cast("int").alias("data_lines"), F.count_if("padding").cast("int").alias("padding_lines"))
    recs = records(body.where(~F.col("padding")).select("statement_id", "line_no", "text"))
    out = recs.join(head, "statement_id").join(counts, "statement_id")
    parts = []
    for d in candidates:  # a delimiter is a literal of the parser, so each has its own plan
        part = out.where(F.col("delimiter") == d)
        cells = fitted(fields(F.col("text"), d), F.size("names"))
        parts.append(part.select("statement_id", F.col("rec_no").cast("int").alias("row_id"), F.map_from_arrays("names", cells).alias("cells"), field_count(F.col("text"), d).cast("int").alias("field_count"), F.size("names").alias("expected"), "text", "span", "header_no", "data_lines", "padding_lines"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def tabular(rows: DataFrame, delimiter: str = ",", most: int = 200) -> DataFrame:
    """Whether a file looks like a table: two neighbouring lines, of the first `most`, with the same two or more cells."""
    n = field_count(F.col("text"), delimiter)
    order = Window.partitionBy("statement_id").orderBy("line_no")
    own = rows.where(F.col("line_no") <= most).withColumn("n", n).withColumn("same", (F.lag("n").over(order) == F.col("n")) & (F.col("n") >= 2))
    return own.groupBy("statement_id").agg(F.coalesce(F.bool_or("same"), F.lit(False)).alias("tabular"))


def sniff_delimiter(line: Column, candidates: tuple[str, ...] = (",", "\t", ";", "|")) -> Column:
    """The most frequent candidate of a line, on a tie the first listed."""
    count = lambda d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
    best = F.greatest(*(count(d) for d in candidates))
    out = F.when(count(candidates[0]) == best, F.lit(candidates[0]))
    for d in candidates[1:]:
        out = out.when(count(d) == best, F.lit(d))
    return out
