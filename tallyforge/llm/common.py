"""What the training-data operators share: the word pattern, shared storage, row keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting by which a query's shuffle files go at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tallyforge-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by `materialise`."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None, tidy: bool = False) -> tuple[DataFrame, str]:
    """Cut lineage: write `df` as Parquet in the shared folder and read it back. The files go when the session ends.

    With `tidy` the shuffle files of this write go as soon as it is done, rather than when the driver's memory is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tallyforge-{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true" if tidy else before)
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(TIDY, before)

    def gone() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be down already
            pass

    atexit.register(gone)
    return spark.read.schema(df.schema).parquet(path), path


def word_count(text: Column) -> Column:
    """How many words a text has; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(part: str, of: int) -> str:
    """SQL for crc32 of the text of column `part`, modulo `of`."""
    return f"pmod(crc32(cast(cast({part} as string) as binary)), {of})"
