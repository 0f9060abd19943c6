"""Profiles and coverage of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import dates, money
from ..functions.text import is_blank, mask_value, trim_ws

#: The date formats that are tried, in this order; the last five take their year from the statement.
FORMATS = (
    "%d/%m/%Y", "%d/%m/%y", "%Y-%m-%d", "%d-%m-%Y", "%d-%m-%y", "%d.%m.%Y", "%d.%m.%y", "%Y/%m/%d", "%m/%d/%Y", "%d %b %Y", "%d %B %Y", "%d %b %y", "%d-%b-%Y", "%b %d, %Y", "%B %d, %Y",
    "%d %b", "%d %B", "%b %d", "%B %d", "%d/%m",
)


def long_cells(df: DataFrame, *columns: str) -> DataFrame:
    """column and value of every cell; the columns are folded into one array, so the table is read once."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def detect_date_format(value: Column) -> Column:
    """Aggregate: the first known format that reads all filled cells; null if there is none or no cell."""
    return dates.fitting(value, dates.distinct_formats([*FORMATS, *vocab.lexicon()["date_formats"]]), unless_empty=True)


def column_profiles(df: DataFrame, *columns: str) -> DataFrame:
    """column, rows, filled, fill_rate, distinct, kind and modal shape of each column, over all its rows.

    Cells are counted first, so each different value is parsed once; then by shape, then by column. Every step combines
    before it shuffles.
    """
    cells = long_cells(df, *columns).select("column", F.when(~is_blank(F.col("value")), trim_ws(F.col("value"))).alias("v"))
    v, n = F.col("v"), F.col("n")
    values = cells.groupBy("column", "v").agg(F.count("*").alias("n"))
    formats = dates.distinct_formats([*FORMATS, *vocab.lexicon()["date_formats"]])
    reads = dates.readable(v, formats)
    values = values.select("column", "v", "n", mask_value(v).alias("shape"), F.when(v.isNotNull(), reads).alias("reads"), F.when(v.isNotNull(), money.looks_money(v)).alias("money"), v.rlike("^[0-9]+$").alias("digits"))
    shapes = values.groupBy("column", "shape").agg(
        F.sum("n").alias("n"), F.count("v").alias("distinct"), F.sum(F.when(F.col("money"), n).otherwise(0)).alias("money"), F.bool_and("digits").alias("digits"), F.max(F.length("v")).alias("longest"),
        *(F.bool_and(F.get("reads", F.lit(i))).alias(f"r{i}") for i in range(len(formats))),
    )
    shown = F.when(F.col("shape").isNotNull(), F.struct(-F.col("n"), F.col("shape")))
    out = shapes.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("shape").isNotNull(), n)), F.lit(0)).alias("filled"), F.sum("distinct").alias("distinct"), F.sum("money").alias("money"), F.bool_and("digits").alias("digits"),
        F.max("longest").alias("longest"), F.min_by("shape", shown).alias("shape"), *(F.bool_and(f"r{i}").alias(f"r{i}") for i in range(len(formats))),
    )
    out = out.withColumn("date_format", F.coalesce(*(F.when(F.col(f"r{i}"), fmt) for i, fmt in enumerate(formats))))
    kind = F.when(F.col("filled") == 0, "empty").when(F.col("date_format").isNotNull(), "date").when(F.col("digits"), "integer").when(F.col("money") >= 0.8 * F.col("filled"), "money").when((F.col("distinct") <= 8) & (F.col("longest") <= 12), "indicator").otherwise("text")
    short = F.when(F.length("shape") > 48, F.concat(F.substring("shape", 1, 45), F.lit("..."))).otherwise(F.col("shape"))
    return out.select("column", "rows", "filled", F.bround(F.col("filled") / F.col("rows"), 3).alias("fill_rate"), "distinct", kind.alias("kind"), short.alias("example_shape"), "date_format")


def money_facts(df: DataFrame, *columns: str) -> DataFrame:
    """How the amounts of columns are printed."""
    cells = long_cells(df, *columns).where(~is_blank(F.col("value")))
    v, up = F.col("value"), F.upper(trim_ws(F.col("value")))
    mark = F.regexp_extract(v, r"([.,])[^.,]*$", 1)
    some = lambda rx, c=v: F.bool_or(c.rlike(rx))
    return cells.groupBy("column").agg(
        some(r"[^0-9A-Za-z.,'()+\s-]").alias("currency_symbol"), some("[0-9][,' ][0-9]{3}").alias("thousands_sep"), F.mode(F.when(mark == ".", "dot").when(mark == ",", "comma"), deterministic=True).alias("decimal_mark"),
        some(r"\([0-9., ]+\)").alias("parens_negative"), some("^-|-$", trim_ws(v)).alias("minus_negative"), some(r"(DR|CR|OD)\s*$", up).alias("dr_cr_suffix"),
    )


def field_coverage(df: DataFrame, fields: dict[str, bool]) -> DataFrame:
    """field, populated, empty and verdict; `fields` says which are mapped. One pass over the rows."""
    counts = df.agg(F.count("*").alias("__n"), *(F.count_if(~is_blank(F.col(f).cast("string"))).alias(f) for f in fields))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("populated"), (F.col("__n") - F.col(f)).alias("empty"), F.lit(m).alias("mapped")) for f, m in fields.items()))
    out = counts.select(F.explode(rows).alias("r")).select("r.*")
    verdict = F.when(~F.col("mapped"), "not mapped").when(F.col("populated") == 0, "mapped but empty").when(F.col("empty") == 0, "complete").otherwise("partial")
    return out.select("field", "populated", "empty", verdict.alias("verdict"))


def row_coverage(rows: DataFrame, buckets: tuple[str, ...] = ("kept", "summary_line", "heading_or_note", "date_unparsed", "amount_missing")) -> DataFrame:
    """Rows of each page by what became of them."""
    return rows.groupBy("statement_id", "page").pivot("code", list(buckets)).agg(F.count(F.lit(1))).fillna(0, list(buckets))


def top_token(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """The most frequent token of each group, on a tie the smallest."""
    counts = df.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "token")
    return counts.withColumn("__at", F.row_number().over(order)).where("__at = 1").drop("__at")
