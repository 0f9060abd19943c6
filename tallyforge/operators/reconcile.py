"""Reconciliation: ten checks per statement and a deterministic level of trust.

All checks read one aggregate per statement, made in one pass over the transactions (windows and sums share the
partitioning by statement), joined to the header. A million statements are one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import tolerant
from ..params import MONEY_TOLERANCE

KEY = "statement_id"
ORDER = ["balance_reconciliation", "running_balance_continuity", "amount_direction", "transaction_count", "dates_within_period", "dates_readable", "no_unparsed_rows", "redaction_summary", "ocr_confidence", "redaction_scan"]
KPI = "struct<name:string,status:string,expected:string,actual:string,discrepancy:string,detail:string,informational:boolean>"


def bridged(tx: DataFrame, key: str = KEY) -> DataFrame:
    """Each row's last known balance before it, the sum of amounts since, and whether one of those is unknown."""
    order = Window.partitionBy(key).orderBy("row_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    money = F.coalesce("amount", F.lit(0.0)).cast("decimal(38,6)")
    rows = tx.withColumns({"__sum": F.sum(money).over(upto), "__hidden": F.sum(F.col("amount").isNull().cast("int")).over(upto)})
    known = F.when(F.col("balance").isNotNull(), F.struct("balance", "__sum", "__hidden"))
    rows = rows.withColumn("__last", F.last(known, ignorenulls=True).over(before))
    return rows.withColumns({
        "previous_balance": F.col("__last.balance"), "since": (F.col("__sum") - F.col("__last.__sum")).cast("double"),
        "unknown": F.col("__hidden") - F.col("__last.__hidden"),
    })


def continuity(tx: DataFrame, key: str = KEY) -> DataFrame:
    """Per row with a balance and one before it: ok, broken or unverifiable; null elsewhere."""
    off = F.abs(F.col("balance") - F.col("previous_balance") - F.col("since"))
    verdict = F.when(F.col("balance").isNull() | F.col("previous_balance").isNull(), None).when(F.col("unknown") > 0, "unverifiable").when(F.round(off, 6) >= MONEY_TOLERANCE, "broken").otherwise("ok")
    return bridged(tx, key).withColumn("continuity", verdict).drop("__sum", "__hidden", "__last")


def facts(tx: DataFrame, bounds: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """One row per statement with everything that the checks ask of its rows, from one window and one aggregate.

    `bounds` has each statement's ps and pe; a row whose date is unreadable or not between them is outside. Rows, bounds
    and windows are dealt out by statement alike, so the transactions are shuffled once.
    """
    has = lambda flag: F.count_if(F.array_contains(F.split("flags", ","), flag))
    day = F.col("date").try_cast("date")
    rows = tx.join(bounds.select(key, F.struct("ps", "pe").alias("__period")), key, "left") if bounds is not None else tx.withColumn("__period", F.lit(None).cast("struct<ps:date,pe:date>"))
    hidden = F.sum(F.col("amount").isNull().cast("int")).over(Window.partitionBy(key).orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0))
    return continuity(rows, key).withColumn("__nth", hidden).groupBy(key).agg(
        F.count_if(~F.coalesce(day.between(F.col("__period.ps"), F.col("__period.pe")), F.lit(False))).alias("outside"),
        F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(38,6)")).cast("double").alias("total"), F.count_if(F.col("amount").isNull()).alias("hidden"),
        F.array_sort(F.collect_list(F.when(F.col("amount").isNull() & (F.col("__nth") <= 10), F.col("row_id")))).alias("hidden_rows"),
        F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("row_id"))).alias("last_balance"), F.min_by("balance", "row_id").alias("first_balance"), F.min_by("amount", "row_id").alias("first_amount"),
        F.count("balance").alias("balances"), F.count_if(F.col("continuity") == "broken").alias("broken"), F.count_if(F.col("continuity") == "unverifiable").alias("unverifiable"),
        F.count_if(F.col("amount") > 0).alias("ins"), F.count_if(F.col("amount") < 0).alias("outs"), F.count(day).alias("dated"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        has("malformed").alias("malformed"), has("redacted").alias("redacted"), has("date_unresolved").alias("unresolved"), has("date_year_inferred").alias("inferred"), has("ocr_low_conf").alias("ocr_low"),
    )


def _kpi(name: str, status: Column, expected: Column | None = None, actual: Column | None = None, discrepancy: Column | None = None, detail: Column | None = None, informational: bool = False) -> Column:
    """A check's row; one that doesn't apply shows no figures, unless it only informs."""
    none = F.lit(None).cast("string")
    shown = lambda c: none if c is None else c.cast("string") if informational else F.when(status != "na", c.cast("string"))
    return F.struct(F.lit(name).alias("name"), status.alias("status"), shown(expected).alias("expected"), shown(actual).alias("actual"), shown(discrepancy).alias("discrepancy"), (detail if detail is not None else F.lit("")).alias("detail"), F.lit(informational).alias("informational")).cast(KPI)


def row_list(rows: Column, count: Column, most: int = 10) -> Column:
    """rows 1, 2, 3 and 4 more."""
    text = F.concat(F.when(count == 1, "row ").otherwise("rows "), F.array_join(F.slice(rows, 1, most).cast("array<string>"), ", "))
    return F.when(count == 0, "no row identified").when(count > most, F.concat(text, F.lit(" and "), (count - most).cast("string"), F.lit(" more"))).otherwise(text)


def kpis(tx: DataFrame, headers: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """Checks of each statement of `headers`, in report order, as an array of KPI rows.

    `counters` may bring source_lines, multiline_extra, skipped_rows, visual_rows and actionable per statement.
    """
    headers = headers.withColumns({"ps": tolerant(F.col("period_start")), "pe": tolerant(F.col("period_end"))})
    rows = headers.join(facts(tx, headers.select(KEY, "ps", "pe")), KEY, "left").fillna(0, ["n", "hidden", "balances", "broken", "unverifiable", "ins", "outs", "dated", "malformed", "redacted", "unresolved", "inferred", "ocr_low"])
    if counters is not None:
        rows = rows.join(counters, KEY, "left")
    known = {"source_lines": "int", "multiline_extra": "int", "skipped_rows": "int", "visual_rows": "int", "actionable": "int"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in known.items() if c not in rows.columns})
    n = F.col("n")
    # balance: only the missing end is taken from the balance column
    closing = F.coalesce("closing_balance", F.when(F.col("opening_balance").isNotNull(), F.col("last_balance")))
    opening = F.coalesce("opening_balance", F.when(F.col("closing_balance").isNotNull(), F.col("first_balance") - F.col("first_amount")))
    rows = rows.withColumns({"close": closing, "open": opening})
    off = F.bround(F.col("close") - F.col("open") - F.col("total"), 2)
    ends = F.col("close").isNotNull() & F.col("open").isNotNull() & (n > 0)
    balance = F.when(ends & (F.col("hidden") == 0), F.when(F.abs(off) < MONEY_TOLERANCE, "pass").otherwise("fail")).when(ends, "fail").otherwise("na")
    money = lambda c: F.format_string("%.2f", c)
    proved = F.concat(F.lit("opening "), money(F.col("open")), F.lit(" and all amounts "), money(F.col("total")), F.lit(" against closing "), money(F.col("close")))
    unread = F.concat(F.col("hidden").cast("string"), F.lit(" amount(s) could not be read ("), row_list(F.col("hidden_rows"), F.col("hidden")), F.lit(")"))
    runs = F.when((n >= 2) & (F.col("balances") > 0), F.when(F.col("broken") > 0, "fail").otherwise("pass")).otherwise("na")
    one_way = (F.col("amount_sign") == "signed") & (F.col("balances") == 0) & (F.col("ins") + F.col("outs") >= 2) & ((F.col("ins") == 0) | (F.col("outs") == 0))
    stated = F.col("stated_count")
    counted = F.when(stated.isNotNull(), F.when((n == stated) & (n > 0), "pass").otherwise("fail")).otherwise(F.when(n > 0, "pass").otherwise("fail"))
    back = F.coalesce(F.col("pe") < F.col("ps"), F.lit(False))
    framed = F.col("ps").isNotNull() & F.col("pe").isNotNull() & (n > 0)
    period = F.when(back, "fail").when(framed, F.when(F.col("outside") == 0, "pass").otherwise("fail")).otherwise("na")
    lost = F.greatest(F.lit(0), F.col("source_lines") - n - F.coalesce("multiline_extra", F.lit(0)))
    thin = F.coalesce((F.col("actionable") >= 3) & (F.col("actionable") >= n) & (4 * F.col("actionable") > F.col("visual_rows")), F.lit(False))
    parsed = F.when(F.col("source_lines").isNotNull(), F.when((F.col("malformed") == 0) & (lost == 0), "pass").otherwise("fail")).when((F.col("malformed") > 0) | thin, "fail").otherwise("na")
    pages, scans = F.coalesce("ocr_pages", F.lit(0)), F.coalesce("redaction_scan_incomplete", F.lit(0))
    text = lambda c: c.cast("string")
    names = ("balance", "runs", "counted", "period", "parsed")
    rows = rows.withColumns({f"__{k}": c for k, c in zip(names, (balance, runs, counted, period, parsed))} | {"__lost": lost, "__back": back, "__off": off})
    balance, runs, counted, period, parsed = (F.col(f"__{k}") for k in names)
    lost, back, off = F.col("__lost"), F.col("__back"), F.col("__off")
    listed = F.array(
        _kpi(ORDER[0], balance, F.bround(F.col("open") + F.coalesce("total", F.lit(0.0)), 2), F.bround("close", 2), F.when(F.col("hidden") == 0, off), F.when(balance == "na", "no opening or closing balance to prove").when(F.col("hidden") > 0, unread).otherwise(proved)),
        _kpi(ORDER[1], runs, F.lit(0), F.col("broken"), F.col("broken"), F.when(runs == "na", "no running balance column").otherwise(F.concat(text(F.col("broken")), F.lit(" break(s), "), text(F.col("unverifiable")), F.lit(" unverifiable")))),
        F.when(one_way, _kpi(ORDER[2], F.lit("fail"), F.lit("mixed or balance-checkable"), F.when(F.col("outs") == 0, "all money-in").otherwise("all money-out"), None, F.lit("every amount has one sign and no balance confirms it"))),
        _kpi(ORDER[3], counted, F.coalesce(text(stated), F.lit(">0")), n, n - stated, F.when(stated.isNull(), "the statement prints no count").otherwise("read against stated count")),
        _kpi(ORDER[4], period, F.concat_ws("..", text(F.col("ps")), text(F.col("pe"))), F.when(back, "ends before it starts").otherwise(F.concat_ws("..", text(F.col("first_day")), text(F.col("last_day")))), F.when(~back, F.col("outside")), F.when(period == "na", "statement period not available").otherwise(F.concat(text(F.coalesce("outside", F.lit(0))), F.lit(" date(s) outside period")))),
        F.when(n > 0, _kpi(ORDER[5], F.when(F.col("dated") == n, "pass").otherwise("fail"), n, F.col("dated"), n - F.col("dated"), F.concat(text(F.col("dated")), F.lit(" of "), text(n), F.lit(" dates read")))),
        _kpi(ORDER[6], parsed, F.coalesce(F.col("source_lines").cast("long"), n), n - F.col("malformed"), F.coalesce(F.col("source_lines").cast("long"), n) - n + F.col("malformed"), F.concat(text(F.coalesce(lost, F.lit(0))), F.lit(" line(s) unaccounted for, "), text(F.col("malformed")), F.lit(" malformed"))),
        _kpi(ORDER[7], F.lit("na"), None, F.col("redacted"), None, F.concat(text(F.col("redacted")), F.lit(" redacted row(s)")), True),
        F.when(pages > 0, _kpi(ORDER[8], F.lit("na"), None, pages, None, F.lit("machine-read text should be checked against the source"), True)),
        F.when(scans > 0, _kpi(ORDER[9], F.lit("fail"), F.lit(0), scans, scans, F.lit("the scan for hidden text did not complete"))),
    )
    return rows.withColumn("kpis", F.filter(listed, lambda k: k.isNotNull()))


def trust(checked: DataFrame) -> DataFrame:
    """Level, score, reasons and completeness from the checks of `kpis`."""
    real = F.filter("kpis", lambda k: ~k["informational"])
    of = lambda status: F.transform(F.filter(real, lambda k: k["status"] == status), lambda k: k["name"])
    rows = checked.withColumns({"failed": of("fail"), "open_checks": of("na"), "passed": of("pass")})
    rows = rows.withColumn("score", F.coalesce(F.bround(100 * (F.size("passed") + 0.5 * F.size("open_checks")) / F.nullif(F.size("passed") + F.size("open_checks") + F.size("failed"), F.lit(0)), 0), F.lit(0.0)).cast("int"))
    first = F.when(F.size("failed") > 0, "low").when(F.size("open_checks") > 0, "medium").otherwise("high")
    secondary = F.array(F.lit("running_balance_continuity"), F.lit("dates_within_period"))
    lifted = (F.size("failed") > 0) & F.array_contains("passed", "balance_reconciliation") & (F.size(F.array_except("failed", secondary)) == 0)
    complete = F.exists("kpis", lambda k: k["name"].isin("balance_reconciliation", "running_balance_continuity") & (k["status"] != "na")) | F.col("stated_count").isNotNull()
    rows = rows.withColumns({"lifted": lifted, "completeness_verified": complete, "first_level": first})
    capped = (~F.col("completeness_verified") & (F.col("n") > 0)) | (F.col("unresolved") > 0) | (F.col("inferred") > 0) | (F.coalesce("ocr_pages", F.lit(0)) > 0)
    level = F.when(F.col("lifted"), "medium").when((F.col("first_level") == "high") & capped, "medium").otherwise(F.col("first_level"))
    say = lambda cond, c: F.when(cond, c)
    names = lambda c: F.array_join(c, ", ")
    reasons = F.array_compact(F.array(
        say(F.size("failed") > 0, F.concat(F.size("failed").cast("string"), F.lit(" check(s) failed: "), names("failed"))),
        say((F.size("failed") == 0) & (F.size("open_checks") > 0), F.concat(F.size("open_checks").cast("string"), F.lit(" check(s) not applicable: "), names("open_checks"))),
        say((F.size("failed") == 0) & (F.size("open_checks") == 0), F.lit("all applicable checks passed")),
        say(F.col("lifted"), F.lit("the balance fully reconciles, so medium rather than low")),
        say(~F.col("completeness_verified") & (F.col("n") > 0), F.lit("completeness unverified: no balance or stated count")),
        say(F.col("unresolved") > 0, F.concat(F.col("unresolved").cast("string"), F.lit(" row(s) with an unresolved year"))),
        say(F.col("inferred") > 0, F.concat(F.col("inferred").cast("string"), F.lit(" row(s) with an inferred year"))),
        say(F.coalesce("ocr_pages", F.lit(0)) > 0, F.concat(F.col("ocr_pages").cast("string"), F.lit(" page(s) read by OCR"))),
    ))
    return rows.withColumns({"trust_level": level, "reasons": reasons}).drop("lifted", "first_level")


def reconcile(tx: DataFrame, headers: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """statement_id, kpis, trust_level, score, reasons, completeness_verified for every statement."""
    return trust(kpis(tx, headers, counters)).select(KEY, "kpis", "trust_level", "score", "reasons", "completeness_verified", "n")
