"""What a statement prints about itself: periods in date order, balances per period, and the facts above a table's header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import dates, money
from ..functions.text import all_matches
from ..params import MONEY_TOLERANCE
from . import labels

KEY = "statement_id"
#: Why several printed periods are not read as one span; null where they are.
REASONS = ("unreadable", "overlap", "sections", "accounts", "balances", "chain")

#: Delimiters outside quotes; a comma between digits that groups thousands is none.
CUTS = r"""(?:[;\t|]|(?<![0-9]),|,(?![0-9]{3}(?![0-9])))(?=(?:[^"]*"[^"]*")*[^"]*$)"""


def printed_periods(lines: DataFrame, lexicon: dict | None = None) -> DataFrame:
    """statement_id, page, line_no, at (within the line), start_raw, end_raw, start and end of every printed range of dates.

    A range is two dates with a connective or a dash between them; one that can't be read has a null start or end.
    """
    lexicon = lexicon or vocab.lexicon()
    day = f"(?:{lexicon['date_regex']})"
    between = rf"\s*(?:{'|'.join(lexicon['period_connectives'])}|[-–—])\s*"
    whole = f"(?i){day}{between}{day}"
    found = lines.where(F.col("text").rlike(whole)).select(KEY, "page", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(whole), F.lit(0))).alias("at", "raw"))
    part = lambda k: F.regexp_extract("raw", f"(?i)({day}){between}({day})", k)
    raw = found.select(KEY, "page", "line_no", "at", part(1).alias("start_raw"), part(2).alias("end_raw"))
    return raw.withColumns({"start": dates.period_date(F.col("start_raw")), "end": dates.period_date(F.col("end_raw"))})


def _position() -> Column:
    return F.struct("page", "line_no", "at")


def ordered(periods: DataFrame) -> DataFrame:
    """Each statement's distinct periods in date order: no (from 1), n, their first place, and how each follows the one before:
    overlap, or gap with its days. A shared boundary day is neither. `unreadable`: some range of the statement is no two dates."""
    own = Window.partitionBy(KEY)
    bad = F.max(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") > F.col("end"))).over(own)
    first = F.row_number().over(Window.partitionBy(KEY, "start", "end").orderBy("page", "line_no", "at"))
    rows = periods.withColumns({"unreadable": bad, "__copy": first}).where("__copy = 1 or unreadable").drop("__copy")
    by_date = own.orderBy("start", "end", "page", "line_no", "at")
    before = F.lag("end").over(by_date)
    gap = F.when(F.col("start") > F.date_add(before, 1), F.concat(F.date_add(before, 1).cast("string"), F.lit(" to "), F.date_sub("start", 1).cast("string")))
    return rows.withColumns({"no": F.row_number().over(by_date), "n": F.count("*").over(own), "overlap": F.coalesce(F.col("start") < before, F.lit(False)), "gap": gap})


def spans(lines: DataFrame, dictionary: dict | None = None, lexicon: dict | None = None) -> DataFrame:
    """One span over several printed periods, where the statement proves it; a row for every statement with a period.

    statement_id, n_periods, merged, reason, period_start, period_end, opening_balance, closing_balance (as printed) and
    gaps. The periods must be readable and not overlap, each must have lines of its own (from its line to the one before
    the next period's), these may name one account at most, must print exactly one opening and one closing balance each,
    and every period must close on the figure that the next one opens on. Anything else leaves the first printed period,
    with the first of REASONS that applies. Gaps don't stop a span, they are listed. Every window is one statement's.
    """
    labels_of, lexicon = dictionary or vocab.label_dictionary(), lexicon or vocab.lexicon()
    found = ordered(printed_periods(lines, lexicon))
    first = found.groupBy(KEY).agg(
        F.max("n").alias("n_periods"), F.bool_or("unreadable").alias("unreadable"), F.bool_or("overlap").alias("overlap"), F.count_distinct("page", "line_no").alias("__places"),
        F.min_by(F.struct("start_raw", "end_raw"), _position()).alias("__first"), F.min_by("start_raw", "no").alias("__start"), F.max_by("end_raw", "no").alias("__end"), F.array_sort(F.collect_list("gap")).alias("gaps"),
    )
    several = first.where("n_periods > 1 and not unreadable and not overlap and __places = n_periods").select(KEY)
    kept = found.join(several, KEY, "left_semi").select(KEY, "page", "line_no", "no")
    order = Window.partitionBy(KEY).orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    parts = lines.join(several, KEY, "left_semi").join(kept, [KEY, "page", "line_no"], "left").withColumn("no", F.last("no", True).over(order)).where("no is not null")
    accounts = parts.select(KEY, F.explode(all_matches(F.col("text"), lexicon["account_regex"])).alias("a")).groupBy(KEY).agg(F.count_distinct("a").alias("__accounts"))
    keyed = parts.select(F.concat_ws("\u0001", KEY, F.col("no").cast("string")).alias(KEY), "page", "line_no", "text")

    def read(name: str) -> DataFrame:
        own = labels.match(keyed, labels_of[name])
        return own.select(F.substring_index(KEY, "\u0001", 1).alias(KEY), F.substring_index(KEY, "\u0001", -1).cast("int").alias("no"), F.when(F.col("n") == 1, F.col("value")).alias(name))

    both = kept.select(KEY, "no").join(read("opening_balance"), [KEY, "no"], "left").join(read("closing_balance"), [KEY, "no"], "left")
    ahead = F.lead("opening_balance").over(Window.partitionBy(KEY).orderBy("no"))
    off = F.abs(money.number(F.col("closing_balance")) - money.number(F.col("__ahead")))
    both = both.withColumn("__ahead", ahead)
    proof = both.groupBy(KEY).agg(
        F.bool_and(F.col("opening_balance").isNotNull() & F.col("closing_balance").isNotNull()).alias("__both"), F.bool_and(F.when(F.col("__ahead").isNotNull(), F.coalesce(F.bround(off, 6) < MONEY_TOLERANCE, F.lit(False)))).alias("__chained"),
        F.min_by("opening_balance", "no").alias("__open"), F.max_by("closing_balance", "no").alias("__close"),
    )
    rows = first.join(accounts, KEY, "left").join(proof, KEY, "left")
    many = F.col("n_periods") > 1
    faults = (F.col("unreadable"), F.col("overlap"), F.col("__places") < F.col("n_periods"), F.coalesce(F.col("__accounts") > 1, F.lit(False)), ~F.col("__both"), ~F.coalesce("__chained", F.lit(False)))
    why = F.coalesce(*(F.when(fault, F.lit(r)) for fault, r in zip(faults, REASONS)))
    rows = rows.withColumns({"reason": F.when(many, why), "merged": many & why.isNull()})
    pick = lambda a, b: F.when(F.col("merged"), a).otherwise(b)
    none = F.lit(None).cast("string")
    return rows.select(
        KEY, F.when(F.col("unreadable"), F.lit(None)).otherwise(F.col("n_periods")).cast("int").alias("n_periods"), "merged", "reason", pick(F.col("__start"), F.col("__first.start_raw")).alias("period_start"), pick(F.col("__end"), F.col("__first.end_raw")).alias("period_end"),
        pick(F.col("__open"), none).alias("opening_balance"), pick(F.col("__close"), none).alias("closing_balance"), F.when(F.col("merged"), F.col("gaps")).otherwise(F.array().cast("array<string>")).alias("gaps"),
    )


def printed(lines: DataFrame, dictionary: dict | None = None, lexicon: dict | None = None) -> DataFrame:
    """The header facts of statements from their lines (statement_id, page, line_no, text): period, date, balances, stated
    count, account, with several periods as one span where that is proven. A file of several first pages has no one span."""
    found = labels.header_facts(lines, dictionary)
    span = F.split("period", "\\.\\.")
    first_pages = labels.multiple_statements(lines).select(KEY, "first_pages")
    own = spans(lines, dictionary, lexicon).withColumnsRenamed({c: f"__{c}" for c in ("period_start", "period_end", "opening_balance", "closing_balance")})
    rows = found.join(first_pages, KEY, "left").join(own, KEY, "left").withColumn("merged", F.coalesce(F.col("merged") & (F.col("first_pages") <= 1), F.lit(False)))
    over = lambda c, plain: F.when(F.col("merged"), F.col(f"__{c}")).otherwise(plain)
    return rows.select(
        KEY, over("period_start", F.coalesce(F.get(span, F.lit(0)), "__period_start")).alias("period_start"), over("period_end", F.coalesce(F.get(span, F.lit(1)), "__period_end")).alias("period_end"), "statement_date",
        *(money.number(over(c, F.col(c))).alias(c) for c in ("opening_balance", "closing_balance")), F.col("stated_count").try_cast("int").alias("stated_count"), "account_number", "n_periods", "merged", "reason", "gaps",
    )


def preamble(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Lines above each file's header as page 1 (statement_id, page, line_no, text): never a line of the table itself.

    `lines` has statement_id, line_no and text, `heads` statement_id and header_no; blank lines are left out.
    """
    own = lines.join(heads.where("header_no > 1").select(KEY, "header_no"), KEY).where((F.col("line_no") < F.col("header_no")) & (F.trim("text") != ""))
    return own.select(KEY, F.lit(1).alias("page"), F.col("line_no").cast("int").alias("line_no"), F.trim(F.replace(F.regexp_replace("text", CUTS, " "), F.lit('"'), F.lit(""))).alias("text"))


def with_printed(headers: DataFrame, facts: DataFrame) -> DataFrame:
    """Header rows of templates with what their statements print."""
    names = ["period_start", "period_end", "opening_balance", "closing_balance", "stated_count", "account_number"]
    return headers.drop(*names).join(facts.select(KEY, *names, "statement_date"), KEY, "left")


def located(words: DataFrame, values: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Where values stand on pages: `values` (statement_id, field, value) with page, found, x0, y0, x1, y1 and times.

    A value's words are looked for as a run of a page's words in reading order, without regard to case; a value of one word
    may be part of a page's word. The first place in page order counts, `times` says how many there are. A value that is
    nowhere has found = false and no box; blank values have no row. One pass gathers each page's words into an array, which a
    page bounds; places are found by comparing slices of it, so nothing is joined word by word.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    word = F.struct(F.round(F.col("y") / max(tolerance, 1.0)).alias("row"), "x", "word_idx", "y", (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"), norm(F.col("text")).alias("t"))
    page = words.groupBy(KEY, "page").agg(F.array_sort(F.collect_list(word)).alias("w"))
    tokens = F.filter(F.split(F.trim(F.regexp_replace(F.lower("value"), r"\s+", " ")), " "), lambda t: t != "")
    wanted = values.withColumn("tokens", tokens).where(F.size("tokens") > 0)
    n = F.size("tokens")
    own = wanted.join(page, KEY, "left").withColumn("t", F.transform("w", lambda w: w["t"]))
    starts = F.sequence(F.lit(1), F.size("t") - n + 1)
    one = F.filter(starts, lambda i: F.contains(F.get(F.col("t"), i - 1), F.get("tokens", F.lit(0))))
    run = F.filter(starts, lambda i: F.slice("t", i, n) == F.col("tokens"))
    at = F.when(F.coalesce(F.size("t"), F.lit(0)) >= n, F.when(n == 1, one).otherwise(run))
    own = own.withColumn("at", at).withColumn("hit", F.when(F.size("at") > 0, F.slice("w", F.get("at", F.lit(0)), n)))
    box = F.struct(F.array_min(F.transform("hit", lambda w: w["x"])).alias("x0"), F.array_min(F.transform("hit", lambda w: w["y"])).alias("y0"), F.array_max(F.transform("hit", lambda w: w["x1"])).alias("x1"), F.array_max(F.transform("hit", lambda w: w["y1"])).alias("y1"))
    rows = own.select(KEY, "field", "value", "page", F.when(F.col("hit").isNotNull(), box).alias("box"), F.when(F.col("hit").isNotNull(), F.size("at")).otherwise(0).alias("k"))
    hit = F.when(F.col("box").isNotNull(), F.col("page"))
    out = rows.groupBy(KEY, "field", "value").agg(F.min(hit).alias("page"), F.min_by("box", hit).alias("box"), F.sum("k").cast("int").alias("times"))
    return out.select(KEY, "field", "value", "page", F.col("page").isNotNull().alias("found"), "box.x0", "box.y0", "box.x1", "box.y1", "times")
