"""The governed feed: an ordered gate, an upsert by content key, and retraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import FEED_CONTEXT, FEED_CORE
from .commits import KeyedTable, Snapshot


def feed_key(sha: Column) -> Column:
    return F.substring(sha, 1, 16)


def trust_ok(level: Column, least: str = "medium") -> Column:
    """Whether a level reaches the floor; an unknown level is low."""
    level = F.lower(F.coalesce(F.nullif(level, F.lit("")), F.lit("low")))
    return {"any": F.lit(True), "medium": level.isin("high", "medium")}.get(least, level == "high")


def gate(status: Column, level: Column, proven: Column, template: Column, sha: Column | None = None, least: str = "medium", require_ok: bool = True, origins: tuple[str, ...] = ("default",), allow: tuple[str, ...] = ()) -> Column:
    """The first rule that fails is the verdict: status, trust, origin, allow-list; else accepted."""
    out = F.when(sha.isNull(), "skipped:no_source_hash") if sha is not None else F.when(F.lit(False), "")
    status = F.coalesce(status, F.lit("failed"))
    if require_ok:
        out = out.when(status != "ok", F.concat(F.lit("withheld:"), status))
    out = out.when(~trust_ok(level, least), "withheld:low_trust")
    out = out.when(~F.when(F.coalesce(proven, F.lit(False)), "default").otherwise("user").isin(*origins), "withheld:not_proven")
    if allow:
        out = out.when(~F.coalesce(template.isin(*allow), F.lit(False)), "withheld:not_in_allowlist")
    return out.otherwise("accepted")


def proven_only(rows: DataFrame, proven: DataFrame, key: str = "template_id") -> DataFrame:
    """Rows of templates in the proven set."""
    return rows.join(proven.select(key), key, "left_semi")


def core_frame(tx: DataFrame) -> DataFrame:
    """The feed's columns: debit and credit split from amount, what is missing null."""
    if "debit" not in tx.columns and "amount" in tx.columns:
        tx = tx.withColumns({"debit": F.when(F.col("amount") < 0, -F.col("amount")), "credit": F.when(F.col("amount") > 0, F.col("amount"))})
    names = [*FEED_CONTEXT, *FEED_CORE]
    return tx.select(*(F.col(c) if c in tx.columns else F.lit(None).cast("string").alias(c) for c in names))


def stamped(tx: DataFrame, statements: DataFrame, fields: tuple[str, ...] = ("period_start", "period_end", "account_number")) -> DataFrame:
    """Rows of a bundle with their own statement's facts, the header's where a statement prints none."""
    own = statements.select("source_sha256", "statement_index", *(F.col(f).alias(f"__{f}") for f in fields))
    out = tx.join(own, ["source_sha256", "statement_index"], "left")
    return out.withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop(*(f"__{f}" for f in fields))


def latest(rows: DataFrame, key: str = "feed_key", ts: str = "converted_ts", tie: str = "run_id") -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return rows.withColumn("__at", F.row_number().over(order)).where("__at = 1").drop("__at")


def newest_run(rows: DataFrame, key: str = "feed_key", ts: str = "converted_ts", tie: str = "run_id") -> DataFrame:
    """All rows of the newest run of each key: what an upsert by content puts in place of what was there."""
    newest = F.max(F.struct(ts, tie)).over(Window.partitionBy(key))
    return rows.withColumn("__newest", newest).where(F.struct(ts, tie).eqNullSafe(F.col("__newest"))).drop("__newest")


def upserted(old: DataFrame, new: DataFrame, key: str = "feed_key") -> DataFrame:
    """`old` with every key of `new` replaced by the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


SIDES = ("transactions", "review")


def store(spark: SparkSession, folder: str) -> KeyedTable:
    """The stored feed: both sides are one table, so that one snapshot shows both."""
    return KeyedTable(spark, folder, "feed_key")


def side(rows: DataFrame, name: str) -> DataFrame:
    """The accepted rows of a feed, or all others."""
    accepted = F.coalesce(F.col("gate_result") == "accepted", F.lit(False))
    return rows.where(accepted if name == SIDES[0] else ~accepted)


def read(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame | None:
    """A side of the feed, at its newest version or an earlier one; None before its first row."""
    rows = store(spark, folder).snapshot(version).rows()
    return None if rows is None else side(rows, name)


def publish(spark: SparkSession, rows: DataFrame, folder: str) -> int:
    """Upsert a batch of rows (with feed_key and gate_result) in one commit: the version that shows it.

    A batch replaces the keys that it brings on both sides and touches no other; readers see it whole or not at all.
    Publishing the same batch again, as after a crash, gives the same feed.
    """
    held = store(spark, folder)
    held.upsert(rows)
    return held.compact()


def retract_stored(spark: SparkSession, folder: str, run_id: str, reason: str = "user_reported_wrong") -> int:
    """Move a run's accepted rows of the stored feed to review, and prove it: how many rows were moved.

    The rows are moved in one commit, from a snapshot that no other writer has changed. Raises if the version that was
    committed still shows an accepted row of the run.
    """
    held, moved = store(spark, folder), 0

    def changed(now: Snapshot) -> tuple[DataFrame, None] | None:
        nonlocal moved
        rows = now.rows()
        mine = None if rows is None else side(rows, SIDES[0]).where(F.col("run_id") == run_id)
        moved = 0 if mine is None else mine.count()
        if not moved:
            return None
        stay, review = retract(*(side(now.rows(mine), name) for name in SIDES), run_id, reason)
        return stay.unionByName(review), None

    version = held.rewrite(changed)
    if moved and side(held.snapshot(version).rows(), SIDES[0]).where(F.col("run_id") == run_id).head(1):
        raise RuntimeError(f"run {run_id} is still in the feed")
    return moved


def retract(accepted: DataFrame, review: DataFrame, run_id: str, reason: str = "user_reported_wrong") -> tuple[DataFrame, DataFrame]:
    """Move a run's accepted rows to review under their new verdict."""
    mine = accepted.where(F.col("run_id") == run_id).withColumn("gate_result", F.lit(f"retracted:{reason}"))
    return accepted.where(~F.coalesce(F.col("run_id") == run_id, F.lit(False))), review.unionByName(mine, allowMissingColumns=True)


def retracted_manifest(manifest: DataFrame, run_id: str, reason: str = "user_reported_wrong") -> DataFrame:
    return manifest.withColumn("gate_result", F.when(F.col("run_id") == run_id, f"retracted:{reason}").otherwise(F.col("gate_result")))
