"""Money, dates and text, value by value."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import dates, money, text


def values(spark, cells, expression):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, x string")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_number(spark):
    cells = ["1,234.56", "$12.00", "(12.50)", "12.00-", "-3", "1.234,56", "1234,5", "1,234", "12.00 DR", "9.10 OD", "5.00 CR", "", None, "abc", "1.2.3", "+7", ".5"]
    assert values(spark, cells, money.number) == [1234.56, 12.0, -12.5, -12.0, -3.0, 1234.56, 1234.5, 1234.0, -12.0, -9.1, 5.0, None, None, None, None, 7.0, 0.5]


def test_number_with_a_declared_mark(spark):
    assert values(spark, ["1.234", "1,5", "1,2,3"], lambda x: money.number(x, "comma")) == [1234.0, 1.5, None]
    assert values(spark, ["1,234.5", "1,5"], lambda x: money.number(x, "dot")) == [1234.5, 15.0]


def test_styles(spark):
    assert values(spark, ["2500.00 CR", "3.10DR", "5.00", "x"], money.suffixed) == [2500.0, -3.1, None, None]
    assert values(spark, ["2.00", "3.00 CR", ""], money.unsigned) == [-2.0, 3.0, None]
    assert values(spark, ["D", " c ", "x", None], lambda k: money.typed(F.lit("4.00"), k, "D", "C")) == [-4.0, 4.0, None, None]
    assert values(spark, ["D", "x"], lambda k: money.typed(F.lit("4.00"), k)) == [-4.0, 4.0]
    assert values(spark, ["3.00", "", None], lambda d: money.debit_credit(d, F.lit("10.00"))) == [7.0, 10.0, 10.0]
    assert values(spark, ["", None], lambda d: money.debit_credit(d, F.lit(" "))) == [None, None]
    with pytest.raises(ValueError):
        money.amount("other")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-10**9, 10**9), min_size=1, max_size=20))
def test_printed_amounts_read_back(spark, cents):
    shapes = [lambda v: f"{v:,.2f}", lambda v: f"(${-v:,.2f})" if v < 0 else f"${v:,.2f}", lambda v: f"{abs(v):,.2f}" + ("-" if v < 0 else "")]
    for shape in shapes:
        assert values(spark, [shape(c / 100) for c in cents], money.number) == [c / 100 for c in cents]


def test_dates(spark):
    cells = ["01/08/2025", "1/8/2025", "31/02/2025", "01/08/25", "", None, "01/08/1985"]
    assert values(spark, cells, lambda x: dates.parse(x, "%d/%m/%Y")) == ["2025-08-01", "2025-08-01", None, None, None, None, None]
    assert values(spark, ["3rd of March 2024", "Wed 3 Mar 2024", "03Mar2024", "3 Sept 2024"], lambda x: dates.parse(x, "%d %b %Y")) == ["2024-03-03", "2024-03-03", "2024-03-03", "2024-09-03"]
    assert values(spark, ["05/06/95", "05/06/25", "05/06/75"], lambda x: dates.parse(x, "%d/%m/%y")) == ["1995-06-05", "2025-06-05", None]


def test_excel_serial(spark):
    assert [str(v) for v in values(spark, ["45000.9", "12", "x"], dates.excel_serial)] == ["2023-03-15", "None", "None"]


def test_text(spark):
    assert values(spark, ["\t a  b \r\n"], text.clean_description) == ["a  b"]
    assert values(spark, ["Ab-9 é$", "[redacted]"], text.mask_text) == ["Xx-9 x$", "[REDACTED]"]
    assert values(spark, ["Ab-9é#"], text.mask_value) == ["AA-9AA"]
    assert values(spark, ["=1+1", "-5", "ok"], text.neutralise) == ["'=1+1", "-5", "ok"]
    assert values(spark, ["Opening Balance 10.00", "12 Mar 2024 Total fees 3.00 DR", "Card payment total wine"], text.is_summary_line) == [True, True, False]
    assert values(spark, ["Page 2 of 3", "carried forward to next page", "Coffee"], text.is_footer) == [True, True, False]
    spans = spark.range(1).select(text.line_span(F.array(F.lit(5))), text.line_span(F.array(F.lit(5), F.lit(6))), text.line_span(F.array(F.lit(5), F.lit(8)))).first()
    assert list(spans) == ["csv:line=5", "csv:line=5-6", "csv:line=5,8"]
