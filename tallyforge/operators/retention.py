"""Roll-up and purge of old records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def due(records: DataFrame, ts: str, now: Column, keep_days: int) -> DataFrame:
    """Records older than `keep_days`."""
    return records.where(F.col(ts) < now - F.make_dt_interval(F.lit(keep_days)))


def roll_up(records: DataFrame, ts: str, folder: str, now: Column | None = None, keep_days: int = 90) -> DataFrame:
    """Put the old records into the archive, by year, and give back those that stay.

    The time is taken once. A record is known by its run_id and time, so a newer record of the same run stays, and one
    that the archive has already is not put there twice: a rerun after a lost job changes nothing.
    """
    spark = records.sparkSession
    if now is None:
        now = F.lit(spark.sql("select current_timestamp() as t").first()["t"])
    old = due(records, ts, now, keep_days)
    new = old.withColumn("year", F.year(ts))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        kept = spark.read.schema(f"run_id string, {ts} {dict(records.dtypes)[ts]}").json(folder)
        new = new.join(kept.select("run_id", ts).distinct(), ["run_id", ts], "left_anti")
    new.write.mode("append").partitionBy("year").json(folder)
    return records.where(~F.coalesce(F.col(ts) < now - F.make_dt_interval(F.lit(keep_days)), F.lit(False)))


def purged(uploads: DataFrame, now: Column, keep_days: int = 30) -> DataFrame:
    """Upload records after a purge: old ones lose their file, keep their record, and say so in their history."""
    gone = (F.col("ts") < now - F.make_dt_interval(F.lit(keep_days))) & F.col("path").isNotNull()
    note = F.concat(F.date_format(now, "yyyy-MM-dd"), F.lit(" purged"))
    return uploads.withColumns({"history": F.when(gone, F.concat_ws("; ", "history", note)).otherwise(F.col("history")), "path": F.when(~gone, F.col("path"))})


def with_archive(live: DataFrame, archive: DataFrame) -> DataFrame:
    """Live and archived records under the union of their columns."""
    return live.unionByName(archive.drop("year"), allowMissingColumns=True)


def current_state(history: DataFrame, key: str = "upload_id") -> DataFrame:
    """The newest status of each record and how it came there."""
    steps = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "status"))), lambda s: F.concat_ws(" ", s["ts"], s["status"])), "; ")
    return history.groupBy(key).agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"), steps.alias("history")).orderBy(F.desc("ts"))
