"""Analytics over run, feed and feedback records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column(df: DataFrame, name: str, default=None) -> Column:
    """A column that older records may lack; absent and null read as `default`."""
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def modal(x: Column) -> Column:
    """Aggregate: the most frequent value that isn't blank, on a tie the smallest."""
    return F.mode(F.nullif(x, F.lit("")), deterministic=True)


def runs_overview(runs: DataFrame) -> DataFrame:
    """Runs by status with their share, most frequent first."""
    counts = runs.groupBy(column(runs, "status", "unknown").alias("status")).agg(F.count("*").alias("n"))
    share = F.bround(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 1)
    return counts.withColumn("pct", share).orderBy(F.desc("n"), "status")


def feed_health(log: DataFrame) -> DataFrame:
    """Feed outcomes: how many, how many written, when last."""
    return (
        log.groupBy(column(log, "gate_result", "unknown").alias("gate_result"))
        .agg(F.count("*").alias("n"), F.sum(column(log, "feed_written", False).cast("long")).alias("written"), F.max(column(log, "ts", "")).alias("last_seen"))
        .orderBy(F.desc("n"), "gate_result")
    )


def feed_write_failures(log: DataFrame) -> DataFrame:
    return log.where(column(log, "gate_result", "").rlike(":write_failed$")).select(
        column(log, "ts", "").alias("ts"), *(F.col(c) if c in log.columns else F.lit(None).cast("string").alias(c) for c in ("run_id", "source_file", "gate_result", "feed_dir"))
    )


def unsupported_clusters(runs: DataFrame) -> DataFrame:
    """Layouts that could not be read: how often, the nearest template, why, when last; oldest first on a tie."""
    own = runs.where(F.col("status").isin("unsupported", "failed"))
    first = lambda c: F.coalesce(F.min_by(c, "__at"), F.lit(""))
    at = F.struct(column(runs, "ts", ""), column(runs, "run_id", ""))
    return (
        own.withColumn("__at", at)
        .groupBy(column(runs, "layout_signature", "(unknown)").alias("signature"))
        .agg(
            first("layout_hint").alias("layout"), F.count("*").alias("count"), modal(F.col("closest_template")).alias("closest_template"),
            modal(F.col("detect_detail")).alias("why"), F.max("ts").alias("last_seen"), first("source_file").alias("example_file"),
        )
        .orderBy(F.desc("count"), "last_seen", "signature")
    )


def template_usage(runs: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """Use of each template, with the flagged feedback on it."""
    own = runs.where(F.coalesce(F.col("detected_template") != "", F.lit(False)))
    out = own.groupBy(F.col("detected_template").alias("template")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "needs_review").alias("needs_review"), F.count_if(F.col("trust_level") == "low").alias("low_trust")
    )
    if feedback is None or "template_id" not in feedback.columns:
        return out.withColumn("flagged_feedback", F.lit(0).cast("long")).orderBy(F.desc("n"), "template")
    flagged = feedback.where("flagged").groupBy(F.col("template_id").alias("template")).agg(F.count("*").alias("flagged_feedback"))
    return out.join(flagged, "template", "left").fillna(0, ["flagged_feedback"]).orderBy(F.desc("n"), "template")


def template_drift(runs: DataFrame, recent: float = 0.4, least: int = 6, drop: float = 25) -> DataFrame:
    """Templates whose recent runs are healthy much less often than their earlier ones."""
    own = runs.where(F.coalesce(F.col("detected_template") != "", F.lit(False)))
    healthy = (F.col("status") == "ok") & (column(runs, "kpi_fail_count", 0) == 0) & (column(runs, "trust_level", "") != "low")
    order = Window.partitionBy("detected_template").orderBy("ts", "run_id")
    whole = Window.partitionBy("detected_template")
    rows = own.withColumns({"healthy": F.coalesce(healthy, F.lit(False)).cast("double"), "at": F.row_number().over(order), "k": F.count("*").over(whole)}).where(F.col("k") >= least)
    rows = rows.withColumn("late", F.col("at") > F.col("k") - F.greatest(F.lit(1.0), F.bround(F.col("k") * recent, 0)))
    share = lambda late: 100 * F.avg(F.when(F.col("late") == late, F.col("healthy")))
    out = rows.groupBy(F.col("detected_template").alias("template")).agg(F.count("*").alias("runs"), share(False).alias("e"), share(True).alias("r"), F.max("ts").alias("last_seen"))
    out = out.select("template", "runs", F.bround("e", 0).alias("earlier_ok_pct"), F.bround("r", 0).alias("recent_ok_pct"), F.bround(F.col("e") - F.col("r"), 0).alias("drop"), "last_seen")
    return out.where(F.col("drop") >= drop).orderBy(F.desc("drop"), "template")


def suggestions(records: DataFrame, tokens: str, known: list[str], least: int = 2) -> DataFrame:
    """Unknown tokens of an array column by how many records hold them."""
    found = records.select(F.explode(F.array_except(F.array_distinct(F.transform(tokens, lambda t: F.upper(F.trim(t)))), F.array(*map(F.lit, known)))).alias("token"))
    return found.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "token")


def batch_summary(results: DataFrame, statuses: tuple[str, ...] = ("ok", "needs_review", "unsupported", "failed")) -> DataFrame:
    """Counts in a fixed order of status; those without a run stay, with zero."""
    listed = results.sparkSession.createDataFrame(list(enumerate(statuses)), "ord int, status string")
    counts = results.groupBy("status").agg(F.count("*").alias("n"))
    return listed.join(counts, "status", "full").select("status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ord", F.lit(len(statuses))).alias("ord")).orderBy("ord", "status").drop("ord")


def duplicate_groups(templates: DataFrame, shape: str = "shape", name: str = "id") -> DataFrame:
    """Templates that read the same layout."""
    return templates.groupBy(shape).agg(F.array_sort(F.collect_set(name)).alias("ids")).where(F.size("ids") > 1).orderBy(shape)


def summary_cards(tx: DataFrame, *keys: str) -> DataFrame:
    """Number, money in, money out, net and span of dates for each statement."""
    money = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    zero = F.lit(0.0)
    return tx.groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(money(F.when(F.col("amount") > 0, F.col("amount"))), zero).alias("money_in"), F.coalesce(money(F.when(F.col("amount") < 0, F.col("amount"))), zero).alias("money_out"),
        F.coalesce(money(F.col("amount")), zero).alias("net"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def flow(tx: DataFrame, period: Column, *keys: str) -> DataFrame:
    """Money in and out by day, week or month."""
    return tx.where("date is not null").groupBy(*keys, period.alias("period")).agg(
        F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0.0).cast("decimal(38,6)")).cast("double").alias("money_in"), F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0.0).cast("decimal(38,6)")).cast("double").alias("money_out"), F.count("*").alias("n")
    )


def cumulative(tx: DataFrame, *keys: str) -> DataFrame:
    """Running net by date; a hidden amount counts as nothing."""
    order = Window.partitionBy(*keys).orderBy("date", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    return tx.withColumn("net", F.sum(F.coalesce("amount", F.lit(0.0)).cast("decimal(38,6)")).over(order).cast("double"))


def flag_histogram(tx: DataFrame, *keys: str) -> DataFrame:
    return tx.where("flags <> ''").select(*keys, F.explode(F.split("flags", ",")).alias("flag")).groupBy(*keys, "flag").agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, name: str, *keys: str) -> DataFrame:
    n = F.length(name)
    return df.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.min(n).alias("shortest"), F.floor(F.median(n)).cast("int").alias("middle"), F.max(n).alias("longest"), F.bround(F.avg(n), 1).alias("mean"))


def top(df: DataFrame, n: int, order: list[Column], *keys: str) -> DataFrame:
    """The first n rows of each group in an order that has no ties."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")
