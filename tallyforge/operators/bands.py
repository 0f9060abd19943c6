"""Bands of columns for every layout at once, from where its statements print dates, figures and headings.

Rows of a page are told apart first: the heading row names the most column words, and transactions below it have a date
and a figure. Positions are counted in whole points before they are grouped by layout, so a layout that most statements
share is a few thousand rows, and gaps between its positions part it into columns. Nothing comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.dates import MONTHS
from ..params import ROW_TOLERANCE
from . import geometry

#: The column words that say what a column of figures holds.
ROLES = {"amount": ("amount",), "balance": ("balance",), "debit": ("debit", "withdrawal", "withdrawals", "payment", "payments"), "credit": ("credit", "deposit", "deposits")}
#: What columns of figures hold, by their number, where headings don't say it.
BY_PLACE = {1: ("amount",), 2: ("amount", "balance"), 3: ("debit", "credit", "balance")}
MONEY = r"^[-+(]?[$€£¥]?[0-9][0-9,]*\.[0-9]{2}\)?-?(?:DR|CR|OD)?$"
DATE = r"^(?:[0-9]{1,2}|[0-9]{1,2}[/-][0-9]{1,2}(?:[/-](?:[0-9]{4}|[0-9]{2}))?|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})$"
EDGE = 3.0


def role(word: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in ROLES.items():
        out = out.when(word.isin(*words), F.lit(name))
    return out


def marked(words: DataFrame) -> DataFrame:
    """Words with their row, and whether it is the page's heading or a transaction of its table."""
    placed = geometry.rows(words, ROW_TOLERANCE, "layout")
    word = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
    placed = placed.withColumns({
        "x1": F.col("x") + F.col("width"), "bin": F.round(F.col("x") + F.col("width") / 2).cast("int"), "word": F.when(word.isin(*vocab.lexicon()["header_keywords"]), word),
        "money": F.upper(F.trim("text")).rlike(MONEY), "dated": F.trim("text").rlike(DATE),
        "date_part": F.trim("text").rlike(rf"(?i)^(?:(?:{MONTHS})[a-z]*\.?,?|(?:19|20)[0-9]{{2}}|'?[0-9]{{2}})$"),
    })
    page = Window.partitionBy("statement_id", "page", "layout")
    row = Window.partitionBy("statement_id", "page", "layout", "row")
    placed = placed.withColumns({"named": F.size(F.collect_set("word").over(row)), "both": F.max("money").over(row) & F.max("dated").over(row)})
    placed = placed.withColumn("most", F.max("named").over(page))
    placed = placed.withColumn("head_row", F.min(F.when((F.col("named") == F.col("most")) & (F.col("most") >= 2), F.col("row"))).over(page))
    below = F.col("both") & (F.col("row") > F.coalesce("head_row", F.lit(-1)))
    placed = placed.withColumn("below", below).withColumn("some", F.max("below").over(page))
    shown = F.when(F.col("some"), F.col("below")).otherwise(F.col("both"))
    return placed.withColumns({"transaction": shown, "heading": F.coalesce(F.col("row") == F.col("head_row"), F.lit(False))})


def _counted(words: DataFrame, *more: str) -> DataFrame:
    """Positions of words in whole points, with the reach of the words at each."""
    return words.groupBy("layout", *more, "bin").agg(F.min("x").alias("lo"), F.max("x1").alias("hi"))


def _columns(bins: DataFrame, gap: float) -> DataFrame:
    return geometry.clusters(bins, "bin", gap, "layout").groupBy("layout", "cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _dates(shown: DataFrame, gap: float) -> DataFrame:
    """The leftmost column of dates by their left edges; a date in several words goes on as long as a printed space is
    between them."""
    row = Window.partitionBy("statement_id", "page", "layout", "row").orderBy("x", "word_idx")
    space = 0.75 * F.coalesce(F.nullif(F.lag("height").over(row), F.lit(0.0)), F.lit(10.0))
    goes_on = F.col("date_part") & (F.lag("dated").over(row) | F.lag("date_part").over(row)) & (F.col("x") - F.lag("x1").over(row) <= space)
    chained = shown.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("chain", F.sum("new").over(row))
    first = F.struct("x", "word_idx")
    chains = chained.groupBy("statement_id", "page", "layout", "row", "chain").agg(F.min_by("dated", first).alias("dated"), F.round(F.min("x")).cast("int").alias("bin"), F.min("x").alias("x"), F.max("x1").alias("x1"))
    return _columns(_counted(chains.where("dated")), gap).where("cluster = 1").select("layout", "lo", "hi")


def suggested(words: DataFrame, gap: float = 18.0) -> DataFrame:
    """layout, field, kind, x_min and x_max of each column of each layout of words(layout, statement_id, page, word_idx, x, y,
    width, height, text).

    A column of figures has the role that the heading above it names, and reaches as far as both. A heading that names a
    role no figure was printed under is a column too. Where a heading is missing, named twice or only a balance, roles go
    by place, for up to three columns. Bands tile the table: bounds lie midway between neighbours, but the description
    ends where figures begin. A layout without transactions, dates or a role for its columns has no rows; words with a
    null layout or position are left out; a repeated word changes nothing; other columns are ignored.
    """
    words = words.select("layout", "statement_id", "page", "word_idx", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")), "text").dropna(subset=["layout", "x", "y", "width", "text"])
    found = marked(words)
    shown = found.where("transaction")
    figures = _columns(_counted(shown.where("money")), gap)
    dates = _dates(shown, gap)
    heads = _counted(found.where("heading and some and word is not null"), "word").groupBy("layout", "word", "bin").agg(F.min("lo").alias("h_lo"), F.max("hi").alias("h_hi")).withColumn("role", role(F.col("word")))
    over = lambda lo, hi: (F.col("h_hi") >= lo) & (F.col("h_lo") <= hi)
    # a layout has few columns and its headings are words of a list: each side of these joins is small for every layout
    top = figures.join(heads.select(F.col("layout").alias("l"), "h_lo", "h_hi", "role"), (F.col("layout") == F.col("l")) & over(F.col("lo"), F.col("hi")), "left")
    top = top.groupBy("layout", "cluster").agg(F.least(F.min("lo"), F.min("h_lo")).alias("lo"), F.greatest(F.max("hi"), F.max("h_hi")).alias("hi"), F.collect_set("role").alias("roles"))
    column = F.struct("lo", "hi", F.when(F.size("roles") == 1, F.get("roles", F.lit(0))).alias("role"))
    tables = top.groupBy("layout").agg(F.array_sort(F.collect_list(column)).alias("money"))
    empty = heads.where("role is not null").groupBy("layout", "role").agg(F.min("h_lo").alias("lo"), F.max("h_hi").alias("hi")).groupBy("layout").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "role"))).alias("heads"))
    heading = heads.groupBy("layout").agg(F.collect_list(F.struct("h_lo", "h_hi")).alias("spans"))
    tables = tables.join(empty, "layout", "left").join(heading, "layout", "left").join(dates, "layout")

    all_named = F.forall("money", lambda m: m["role"].isNotNull())
    unprinted = F.filter(F.coalesce("heads", F.array()), lambda h: ~F.exists("money", lambda m: (m["role"] == h["role"]) | (m["hi"] >= h["lo"]) & (m["lo"] <= h["hi"])))
    tables = tables.withColumn("money", F.when(all_named & (F.size(unprinted) > 0), F.array_sort(F.concat("money", unprinted))).otherwise(F.col("money")))
    roles = F.transform("money", lambda m: m["role"])
    good = F.forall(roles, lambda r: r.isNotNull()) & (F.size(F.array_distinct(roles)) == F.size(roles)) & F.exists(roles, lambda r: r.isin("amount", "debit", "credit"))
    by_place = F.when(F.lit(False), F.array().cast("array<string>"))
    for n, names in BY_PLACE.items():
        by_place = by_place.when(F.size("money") == n, F.array(*map(F.lit, names)))
    tables = tables.withColumn("roles", F.when(good, roles).otherwise(by_place)).where("roles is not null")

    at_date = F.filter(F.coalesce("spans", F.array()), lambda h: (h["h_hi"] >= F.col("lo")) & (h["h_lo"] <= F.col("hi")))
    tables = tables.withColumns({"d_lo": F.least("lo", F.array_min(F.transform(at_date, lambda h: h["h_lo"]))), "d_hi": F.greatest("hi", F.array_max(F.transform(at_date, lambda h: h["h_hi"]))), "first": F.get("money", F.lit(0))["lo"]})
    between = _counted(shown).join(tables.select("layout", "d_hi", "first"), "layout").where("bin > d_hi and bin < first")
    text = between.groupBy("layout").agg(F.struct(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.lit("description").alias("field"), F.lit("text").alias("kind")).alias("text"))
    field = lambda lo, hi, name, kind: F.struct(lo.alias("lo"), hi.alias("hi"), name.alias("field"), F.lit(kind).alias("kind"))
    figures = F.transform(F.arrays_zip("money", "roles"), lambda m: field(m["money"]["lo"], m["money"]["hi"], m["roles"], "money"))
    tables = tables.join(text, "layout", "left")
    columns = tables.select("layout", F.array_sort(F.array_compact(F.concat(F.array(field(F.col("d_lo"), F.col("d_hi"), F.lit("date"), "date"), F.col("text")), figures))).alias("c"))

    def bound(left: Column, right: Column) -> Column:
        lo, hi = left["hi"], right["lo"]
        return F.when((left["field"] == "description") & (lo <= hi), hi).otherwise((lo + hi) / 2)

    tiled = F.transform("c", lambda c, i: F.struct(
        c["field"].alias("field"), c["kind"].alias("kind"),
        F.floor(F.when(i == 0, c["lo"] - EDGE).otherwise(bound(F.get("c", i - 1), c))).cast("double").alias("x_min"),
        F.ceil(F.when(i == F.size("c") - 1, c["hi"] + EDGE).otherwise(bound(c, F.get("c", i + 1)))).cast("double").alias("x_max"),
    ))
    return columns.select("layout", F.inline(tiled))


def template_columns(found: DataFrame, layout: str) -> dict[str, dict]:
    """The bands of one layout as a template holds them."""
    rows = found.where(F.col("layout") == layout).orderBy("x_min").collect()
    return {r["field"]: {"x_min": r["x_min"], "x_max": r["x_max"]} for r in rows}
