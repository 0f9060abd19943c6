"""Intermediate tables in shared storage: they cut a plan's lineage, survive lost executors and are deleted at the end."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tallyforge-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again. The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyforge-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def gone() -> None:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be down already
            pass

    atexit.register(gone)
    return spark.read.schema(df.schema).parquet(path)
