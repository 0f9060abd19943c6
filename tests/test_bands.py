"""Bands of layouts: odd tables, fallbacks by place, figures without dates, words given twice."""

from __future__ import annotations

from tallyforge.operators import bands

SCHEMA = "layout string, statement_id string, page int, word_idx int, x double, y double, width double, height double, text string"


def page(layout, rows, statement="s"):
    """Words at (x, y, text), five points a character."""
    return [(layout, statement, 1, i, float(x), float(y), 5.0 * len(t), 8.0, t) for i, (x, y, t) in enumerate(rows)]


def found(spark, rows):
    out = {}
    for r in bands.suggested(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault(r["layout"], {})[r["field"]] = (r["x_min"], r["x_max"])
    return out


def table(*edges, y=100.0, date="01/02/2024"):
    return [(30, y, date), (100, y, "Shop"), *((e - 20, y, "1.25") for e in edges)]


def test_odd_tables(spark):
    assert found(spark, []) == {}
    nothing = page("none", [(30, 100, "A"), (60, 100, "note")]) + page("no-date", [(100, 100, "Shop"), (300, 100, "9.99")]) + page("no-figure", [(30, 100, "01/02/2024"), (100, 100, "Shop")])
    four = page("four", table(200, 300, 400, 500))
    lost = [(None, "s", 1, 0, 1.0, 1.0, 1.0, 1.0, "1.25"), ("one", "s", 1, 50, None, 100.0, 20.0, 8.0, "9.99"), ("one", "s", 1, 51, 700.0, 100.0, 20.0, 8.0, None)]
    one = page("one", table(300))
    got = found(spark, nothing + four + lost + one + one)
    assert got == {"one": {"date": (27.0, 90.0), "description": (90.0, 280.0), "amount": (280.0, 303.0)}}


def test_roles_by_place_where_headings_fail(spark):
    heads = lambda *names: [(x, 50, n) for x, n in zip((30, 100, 280, 380, 480), names)]
    rows = page("twice", heads("Date", "Details", "Amount", "Amount", "Balance") + table(300, 400, 500)) + page("only-balance", heads("Date", "Details", "Balance") + table(300))
    rows += page("named", heads("Date", "Details", "Credit", "Debit", "Balance") + table(300, 400, 500))
    got = found(spark, rows)
    assert {k: [f for f, _ in sorted(v.items(), key=lambda p: p[1])] for k, v in got.items()} == {
        "twice": ["date", "description", "debit", "credit", "balance"], "only-balance": ["date", "description", "amount"], "named": ["date", "description", "credit", "debit", "balance"],
    }


def test_layout_is_measured_over_all_its_statements(spark):
    wide = [(30, 100, "01/02/2024"), (100, 100, "A-long-description"), (255, 100, "12,345.67")]
    rows = page("x", table(300), "a") + page("x", wide, "b") + page("x", [(30, 100, "3"), (38, 100, "Feb"), (56, 100, "2024"), (100, 100, "Shop"), (280, 100, "1.25")], "c")
    got = found(spark, rows)["x"]
    assert got == {"date": (27.0, 90.0), "description": (90.0, 255.0), "amount": (255.0, 303.0)}
    own = bands.suggested(spark.createDataFrame(rows, SCHEMA))
    assert bands.template_columns(own, "x")["amount"] == {"x_min": 255.0, "x_max": 303.0} and bands.template_columns(own, "y") == {}
