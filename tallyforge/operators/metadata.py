"""Content-free facts about conversions, for improving templates, and masked audits that are safe to share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import magnitude
from ..functions.text import mask_text, set_hash
from .analytics import flag_histogram

LEVELS = ("off", "basic", "standard", "full")


def at_least(level: str, need: str) -> bool:
    """Whether a capture level covers a category that needs `need`."""
    return LEVELS.index(level if level in LEVELS else "off") >= LEVELS.index(need)


def capture(tx: DataFrame, results: DataFrame, level: str = "standard") -> DataFrame:
    """statement_id, status, template and, by level, flags, sizes of amounts and lengths of descriptions; never content."""
    out = results.select("statement_id", "template_id", "status", "trust_level", "row_count")
    if not at_least(level, "basic"):
        return out.where("false")
    flags = flag_histogram(tx, "statement_id").groupBy("statement_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("flags"))
    out = out.join(flags, "statement_id", "left")
    if at_least(level, "standard"):
        sizes = tx.where("amount is not null and amount <> 0").groupBy("statement_id", magnitude(F.col("amount")).alias("bucket")).agg(F.count("*").alias("n"))
        out = out.join(sizes.groupBy("statement_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("amount_buckets")), "statement_id", "left")
    if at_least(level, "full"):
        n = F.length("description")
        lengths = tx.groupBy("statement_id").agg(F.struct(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.bround(F.avg(n), 1).alias("mean")).alias("description_length"))
        out = out.join(lengths, "statement_id", "left")
    return out


def unmapped_headers(heads: DataFrame, mapped: list[str]) -> DataFrame:
    """Source columns that no field is read from."""
    own = F.array(*map(F.lit, [m.lower() for m in mapped]))
    return heads.select("statement_id", F.array_except(F.transform("header_cells", lambda c: F.lower(F.trim(c))), own).alias("unmapped"))


def accounts(tx: DataFrame, pattern: str) -> DataFrame:
    """A digest of the account numbers that a statement names."""
    found = F.flatten(F.collect_list(F.regexp_extract_all(F.coalesce("description", F.lit("")), F.lit(pattern), F.lit(0))))
    return tx.groupBy("statement_id").agg(found.alias("__a")).select("statement_id", F.size(F.array_distinct("__a")).alias("n_accounts"), F.when(F.size("__a") > 0, set_hash(F.col("__a"))).alias("account_hash"))


def statement_audit(tx: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Masked rows beside the status of every check: layouts can be discussed without showing what they hold."""
    rows = tx.select("statement_id", "row_id", mask_text(F.col("date_raw")).alias("date_shape"), mask_text(F.col("amount_raw")).alias("amount_shape"), mask_text(F.col("description")).alias("description_shape"), "flags")
    checks = reconciled.select("statement_id", F.map_from_entries(F.transform("kpis", lambda k: F.struct(k["name"], k["status"]))).alias("checks"), "trust_level")
    return rows.join(checks, "statement_id", "left")


def batch_audit(results: DataFrame, reconciled: DataFrame) -> DataFrame:
    """One row per file: status, rows, trust and the first check that fails."""
    failing = F.get(F.transform(F.filter("kpis", lambda k: k["status"] == "fail"), lambda k: k["name"]), F.lit(0))
    first = reconciled.select("statement_id", failing.alias("failing_check"))
    return results.select("statement_id", "template_id", "status", "row_count", "trust_level").join(first, "statement_id", "left")


def report(audit: DataFrame, title: str = "Batch audit") -> str:
    """Counts of an audit as markdown; only the aggregate comes to the driver."""
    counts = audit.groupBy("status", F.coalesce("failing_check", F.lit("-")).alias("failing_check")).agg(F.count("*").alias("n")).orderBy("status", "failing_check").collect()
    lines = [f"# {title}", "", "| status | failing check | files |", "|---|---|---|", *(f"| {r['status']} | {r['failing_check']} | {r['n']} |" for r in counts)]
    return "\n".join(lines)
