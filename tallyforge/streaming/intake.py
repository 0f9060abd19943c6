"""Streams: folder intake, states of dropped files, latest-wins publishing, windows over run records and joins of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import feed
from ..schema import RUN
from ..sources.delimited import kind_of
from ..storage import shared_folder


def dropped_files(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """Files as they land in a folder: statement_id (their hash), path, kind, content."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select(F.sha2("content", 256).alias("statement_id"), "path", "modificationTime", kind_of(F.col("path")).alias("kind"), "content")


def new_contents(files: DataFrame, late: str = "7 days") -> DataFrame:
    """Each content once, however often it is dropped within the bound."""
    return files.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["statement_id"])


def publish(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Upsert each batch of rows (feed_key, gate_result, converted_ts, run_id, ...) into the feed; all rows of
    the newest run of a key replace what the key had."""

    def one(batch: DataFrame, _: int) -> None:
        feed.publish(batch.sparkSession, feed.newest_run(batch), folder)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def convert_each(files: DataFrame, convert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a conversion on every batch of dropped files."""
    return files.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """Run records as they are written."""
    return spark.readStream.schema(RUN).option("multiLine", "true").json(folder).withColumn("at", F.try_to_timestamp("ts"))


def status_windows(runs: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Runs by status in tumbling or sliding windows; records later than the bound are left out."""
    return runs.withWatermark("at", late).groupBy(F.window("at", width, slide) if slide else F.window("at", width), "status").agg(F.count("*").alias("n"))


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by gaps in event time."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


#: States of a dropped file; the last two end its way.
STATES = ("inbox", "processing", "processed", "failed")


def file_states(events: DataFrame, stuck_minutes: int = 30, late_minutes: int = 10) -> DataFrame:
    """The state of each file of a stream of its events (file, state, at): a row (file, state, at) whenever a batch changes it.

    The newest event by time counts, of equals the later state in STATES; events older than what is known change nothing. A
    file that stays in the inbox or in processing for `stuck_minutes` of event time gets a row `stuck`, by a timer, and leaves
    the state, as one that is processed or failed does; an event after that begins anew. So what is held is bounded by the
    files under way. Null files, states and times are left out.
    """
    bound = stuck_minutes * 60_000

    def step(key, batches, state):
        if state.hasTimedOut:
            _, at = state.get
            state.remove()
            yield pd.DataFrame({"file": [key[0]], "state": ["stuck"], "at": [pd.Timestamp(at + bound, unit="ms")]})
            return
        now = state.get if state.exists else None
        rank = lambda s, at: (at, STATES.index(s) if s in STATES else -1)
        new = now
        for batch in batches:
            for s, at in zip(batch["state"], batch["at"]):
                at = int(at.value // 1_000_000)
                if new is None or rank(s, at) > rank(*new):
                    new = (s, at)
        if new is None or new == now:
            return
        yield pd.DataFrame({"file": [key[0]], "state": [new[0]], "at": [pd.Timestamp(new[1], unit="ms")]})
        if new[0] not in STATES[:2]:
            if state.exists:
                state.remove()
        elif new[1] + bound <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield pd.DataFrame({"file": [key[0]], "state": ["stuck"], "at": [pd.Timestamp(new[1] + bound, unit="ms")]})
        else:
            state.update(new)
            state.setTimeoutTimestamp(new[1] + bound)

    known = events.where("file is not null and state is not null and at is not null").withWatermark("at", f"{late_minutes} minutes")
    return known.groupBy("file").applyInPandasWithState(step, "file string, state string, at timestamp", "state string, at long", "append", "EventTimeTimeout")


def answered(runs: DataFrame, feedback: DataFrame, within: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Runs (run_id, at, ...) with the feedback (run_id, said_at, verdict) given within a bound of the run: both sides are
    streams or both tables. The watermarks and the bound limit how long either side is held; events later than `late` behind
    their stream are dropped from a stream, and each feedback meets its run at most once."""
    left = runs.withWatermark("at", late)
    right = feedback.select(F.col("run_id").alias("__run"), "said_at", "verdict").withWatermark("said_at", late)
    near = (F.col("run_id") == F.col("__run")) & (F.col("said_at") >= F.col("at")) & (F.col("said_at") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    return left.join(right, near).drop("__run")


def drained(rows: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for what is there now, written by its file sink into shared storage and read as a table."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/tallyforge-{name}-{uuid.uuid4().hex}"
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")
