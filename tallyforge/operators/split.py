"""Bundles: one file with several statements, cut at page markers and accepted only if every part stands up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from . import facts, labels

LEVELS = ["low", "medium", "high"]
#: What may begin a statement: its first page's number, or the label of an opening balance.
MARKERS = {"page1_marker": labels.FIRST_PAGE, "opening_label": r"(?i)opening balance|balance brought forward"}
CUT = "\u0002"


def settings(template: dict) -> dict | None:
    """How a template's bundles are cut: on (of MARKERS) and least (statements, 2 or more); None where `split: false` forbids it."""
    own = template.get("split", True)
    if own is False:
        return None
    own = own if isinstance(own, dict) else {}
    on = str(own.get("on", "page1_marker")).lower()
    return {"on": on if on in MARKERS else "page1_marker", "least": max(2, int(own.get("min_statements") or 2))}


def candidates(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Parts of files that may be bundles: statement_id, segment, first_page, last_page, k and part (the part's own key).

    `lines` are statement_id, page, line_no and text; `wanted` has statement_id, on and least (see `settings`). Pages before
    the first marker belong to the first statement. The number of parts must be confirmed by a count that the marker did not
    make: distinct printed periods, or opening and closing labels (first pages, where the label is the marker). Rows of a
    running balance continue across any cut, so nothing read from the parts could confirm it.
    """
    marks = [F.when(F.col("on") == on, F.col("text").rlike(rx)) for on, rx in MARKERS.items()]
    hit = F.max(F.coalesce(*marks, F.lit(False))).alias("hit")
    numbered = lines.join(wanted, "statement_id").groupBy("statement_id", "on", "least", "page").agg(hit)
    first = F.min("page").over(Window.partitionBy("statement_id"))
    parts = segments(numbered.withColumn("is_start", F.col("hit") | (F.col("page") == first)))
    size = F.count("*").over(Window.partitionBy("statement_id"))
    seen = labels.multiple_statements(lines)
    periods = facts.ordered(facts.printed_periods(lines)).groupBy("statement_id").agg(F.max("n").cast("long").alias("n_periods"))
    counts = wanted.join(seen, "statement_id", "left").join(periods, "statement_id", "left")
    labelled = F.when((F.col("openings") > 1) & (F.col("closings") > 1), F.least("openings", "closings"))
    by_page = F.col("on") == "page1_marker"
    other = F.array_compact(F.array(F.col("n_periods"), F.when(by_page, labelled).otherwise(F.col("first_pages").cast("long"))))
    out = parts.withColumn("k", size).join(counts.select("statement_id", "least", other.alias("other")), "statement_id")
    return out.where((F.col("k") >= F.col("least")) & F.array_contains("other", F.col("k"))).select("statement_id", "segment", "first_page", "last_page", "k", F.concat("statement_id", F.lit(CUT), F.col("segment").cast("string")).alias("part"))


def dealt(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """`rows` (statement_id, page, ...) and beside them those of every part under the part's key, pages counted from 1."""
    own = rows.join(parts.select("statement_id", "first_page", "last_page", "part"), "statement_id").where(F.col("page").between(F.col("first_page"), F.col("last_page")))
    own = own.withColumns({"statement_id": F.col("part"), "page": (F.col("page") - F.col("first_page") + 1).cast(dict(rows.dtypes)["page"])})
    return rows.unionByName(own.select(*rows.columns))


def whole_key(part):
    """The file that a part's key belongs to; a file's own key is itself."""
    return F.substring_index(part, CUT, 1)


def bundle_period(statements: DataFrame) -> DataFrame:
    """statement_id, period_start, period_end and why: one period for a bundle whose statements join up in date order, as they
    print it, else null and the reason (unreadable, backwards, overlap, or the days that none covers)."""
    rows = statements.select("statement_id", "period_start", "period_end", dates.tolerant(F.col("period_start")).alias("s"), dates.tolerant(F.col("period_end")).alias("e"), "segment")
    order = Window.partitionBy("statement_id").orderBy("s", "e", "segment")
    before = F.lag("e").over(order)
    hole = F.when(F.col("s") > F.date_add(before, 1), F.concat(F.date_add(before, 1).cast("string"), F.lit(" to "), F.date_sub("s", 1).cast("string")))
    rows = rows.withColumns({"no": F.row_number().over(order), "over": F.col("s") < before, "hole": hole})
    seen = rows.groupBy("statement_id").agg(
        F.bool_or(F.col("s").isNull() | F.col("e").isNull()).alias("odd"), F.bool_or(F.col("e") < F.col("s")).alias("back"), F.bool_or("over").alias("over"), F.array_sort(F.collect_list("hole")).alias("holes"),
        F.min_by("period_start", "no").alias("a"), F.max_by("period_end", "no").alias("z"),
    )
    why = F.when(F.col("odd"), "unreadable").when(F.col("back"), "backwards").when(F.col("over"), "overlap").when(F.size("holes") > 0, F.concat(F.lit("no statement covers "), F.array_join("holes", "; ")))
    return seen.withColumn("why", why).select("statement_id", F.when(F.col("why").isNull(), F.col("a")).alias("period_start"), F.when(F.col("why").isNull(), F.col("z")).alias("period_end"), "why")


def combined(tx: DataFrame, checked: DataFrame, headers: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transactions and checks of files and of bundles' parts, read under keys as `dealt` gives them, in one row set per file.

    A bundle is split if every part gave rows; then its parts' rows (statement_index, row_id counted through) and checks (each
    with its statement's number) take the place of the whole file's, and its trust is that of the weakest part. Else the parts
    go, and the file stays as it was read whole. Third: the statements of split bundles, one row each.
    """
    summary = parts.join(checked.select(F.col("statement_id").alias("part"), "kpis", "trust_level", "score", "completeness_verified", F.col("n").alias("rows")), "part", "left")
    sound = summary.groupBy("statement_id").agg(F.bool_and(F.coalesce(F.col("rows") > 0, F.lit(False))).alias("split")).where("split").select("statement_id")
    kept = summary.join(sound, "statement_id", "left_semi")
    heads = headers.select(F.col("statement_id").alias("part"), "period_start", "period_end", "opening_balance", "closing_balance", "account_number")
    pages = F.concat_ws("-", F.col("first_page").cast("string"), F.col("last_page").cast("string"))
    statements = kept.join(heads, "part", "left").select("statement_id", "segment", pages.alias("pages"), "period_start", "period_end", "opening_balance", "closing_balance", "account_number", "rows", "trust_level", "score", "completeness_verified", "kpis")
    own = tx.withColumnRenamed("statement_id", "part").join(kept.select("part", "statement_id", F.col("segment").alias("statement_index")), "part").drop("part")
    alone = tx.where(~F.contains("statement_id", F.lit(CUT))).join(sound, "statement_id", "left_anti").withColumn("statement_index", F.lit(None).cast("int"))
    rows = alone.unionByName(renumbered(own).select(*alone.columns))
    period = bundle_period(statements)
    level = weakest(kept)
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("segment", "kpis"))), lambda s: F.transform(s["kpis"], lambda k: k.withField("name", F.concat(k["name"], F.lit(" [statement "), s["segment"].cast("string"), F.lit("]"))))))
    said = F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("segment", "pages"))), lambda s: s["pages"]))
    sums = statements.groupBy("statement_id").agg(listed.alias("kpis"), said.alias("pages"), F.sum("rows").cast("long").alias("n"))
    reasons = F.array_compact(F.array(
        F.concat(F.lit("split into "), F.col("statements").cast("string"), F.lit(" statements (pages "), F.col("pages"), F.lit("), each reconciled by itself")), F.lit("an independent count confirms the number of statements"),
        F.when(F.col("why").isNotNull(), F.concat(F.lit("no single period for the file: "), F.col("why"))), F.concat(F.lit("trust is that of the weakest statement: "), F.col("trust_level")),
    ))
    out = sums.join(level, "statement_id").join(period, "statement_id").withColumn("reasons", reasons)
    left = checked.where(~F.contains("statement_id", F.lit(CUT))).join(sound, "statement_id", "left_anti")
    return rows, left.unionByName(out.select(*(F.col(c).cast(t) for c, t in left.dtypes))), statements.drop("kpis", "completeness_verified").withColumnRenamed("segment", "statement_index")


def starts(pages: DataFrame, marker: str) -> DataFrame:
    """Pages (statement_id, page, text) with whether each begins a statement."""
    return pages.withColumn("is_start", F.coalesce(F.col("text").rlike(marker), F.lit(False)))


def segments(pages: DataFrame) -> DataFrame:
    """statement_id, segment, first_page and last_page: from each start to the page before the next."""
    order = Window.partitionBy("statement_id").orderBy("page")
    last = F.max("page").over(Window.partitionBy("statement_id"))
    rows = pages.withColumn("__np", last).where("is_start")
    return rows.select("statement_id", F.row_number().over(order).alias("segment"), F.col("page").alias("first_page"), (F.coalesce(F.lead("page").over(order), F.col("__np") + 1) - 1).alias("last_page"))


def assigned(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (statement_id, page, ...) with the segment that their page belongs to."""
    joined = rows.join(parts, "statement_id").where(F.col("page").between(F.col("first_page"), F.col("last_page")))
    return joined.drop("first_page", "last_page")


def renumbered(rows: DataFrame) -> DataFrame:
    """row_id counted anew through the statements of a bundle."""
    order = Window.partitionBy("statement_id").orderBy("statement_index", "row_id")
    return rows.withColumn("row_id", F.row_number().over(order))


def committed(parts: DataFrame, counted: DataFrame, least: int = 2) -> DataFrame:
    """Whether each bundle may be split: enough segments, another count that agrees, and every segment parsed and reconciled.

    `parts` has statement_id, segment, rows and trust_level; `counted` has statement_id and structural (an independent count).
    """
    whole = parts.groupBy("statement_id").agg(F.count("*").alias("k"), F.bool_and((F.col("rows") > 0) & (F.col("trust_level") != "low")).alias("sound"))
    return whole.join(counted, "statement_id", "left").select("statement_id", "k", F.coalesce((F.col("k") >= least) & (F.col("structural") == F.col("k")) & F.col("sound"), F.lit(False)).alias("split"))


def weakest(parts: DataFrame) -> DataFrame:
    """The trust of a bundle is that of its weakest part."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("trust_level"))
    out = parts.groupBy("statement_id").agg(F.min(rank).alias("r"), F.min("score").alias("score"), F.bool_and("completeness_verified").alias("completeness_verified"), F.count("*").alias("statements"))
    return out.withColumn("trust_level", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("r").cast("int"))).drop("r")


def tagged(kpis: DataFrame) -> DataFrame:
    """Checks of all parts in one list, each with its statement's number."""
    return kpis.withColumn("name", F.concat("name", F.lit(" [statement "), F.col("segment").cast("string"), F.lit("]")))
