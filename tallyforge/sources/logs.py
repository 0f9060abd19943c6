"""Run, feed and feedback records: one JSON file per event, live or archived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FEED_LOG, FEEDBACK, RUN

SCHEMAS = {"runs": RUN, "feed": FEED_LOG, "feedback": FEEDBACK}


def read(spark: SparkSession, folder: str, kind: str = "runs") -> DataFrame:
    """All records of a kind; half-written files are left out, unknown fields too, missing ones are null."""
    schema = f"{SCHEMAS[kind]}, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", "_corrupt").json(f"{folder.rstrip('/')}/{kind}")
    return rows.where("_corrupt is null").drop("_corrupt")


def read_all(spark: SparkSession, folder: str, kind: str = "runs") -> DataFrame:
    """Live records and the archive's lines."""
    live = read(spark, folder, kind)
    archive = spark.read.schema(SCHEMAS[kind]).option("mode", "DROPMALFORMED").json(f"{folder.rstrip('/')}/{kind}-archive")
    return live.unionByName(archive, allowMissingColumns=True)


def newest(spark: SparkSession, folder: str, n: int = 2000) -> DataFrame:
    """The newest `n` files of a folder, by time and then name, with how many there are."""
    files = spark.read.format("binaryFile").load(folder).select("path", "modificationTime", "content")
    total = spark.read.format("binaryFile").load(folder).agg(F.count("*").alias("total"))
    return files.orderBy(F.desc("modificationTime"), F.desc("path")).limit(n).join(total).select("path", F.col("content").cast("string").alias("json"), "total")


def append(rows: DataFrame, folder: str, kind: str) -> None:
    """Write records; earlier ones are never overwritten."""
    rows.write.mode("append").json(f"{folder.rstrip('/')}/{kind}")


def folder_listing(spark: SparkSession, root: str, states: tuple[str, ...] = ("inbox", "processed", "failed", "stuck", "outbox")) -> DataFrame:
    """Files of an intake folder by state, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    state = F.regexp_extract("path", r"/(" + "|".join(states) + r")/[^/]+$", 1)
    return files.withColumn("state", F.nullif(state, F.lit(""))).where("state is not null").orderBy(F.desc("modificationTime"), "path")
