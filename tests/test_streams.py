"""File states over several batches: changes, timers, late and repeated events."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from tallyforge.streaming import intake


def test_states_over_batches(spark, tmp_path):
    source, at = tmp_path / "events", lambda m: (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)).isoformat()
    source.mkdir()

    def run(name, rows):
        (source / f"{name}.json").write_text("\n".join(json.dumps({"file": f, "state": s, "at": at(m) if m is not None else None}) for f, s, m in rows))
        stream = spark.readStream.schema("file string, state string, at timestamp").json(str(source))
        query = intake.file_states(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["file"], r["state"], r["m"]) for r in spark.read.parquet(str(tmp_path / "out")).select("file", "state", ((F.unix_seconds("at") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 60).cast("int").alias("m")).collect())

    first = [("a", "inbox", 0), ("a", "processing", 1), ("b", "inbox", 0), ("c", "inbox", 0), ("c", "failed", 0), (None, "inbox", 1), ("d", None, 1), ("e", "inbox", None)]
    seen = [("a", "processing", 1), ("b", "inbox", 0), ("c", "failed", 0)]
    assert run("1", first) == seen
    # the earlier event changes nothing, the repeated one neither
    seen = sorted([*seen, ("a", "processed", 20)])
    assert run("2", [("a", "processed", 20), ("b", "inbox", 0), ("a", "inbox", 15)]) == seen
    # event time goes on: b has been in the inbox for too long, a is done
    seen = sorted([*seen, ("z", "inbox", 90), ("b", "stuck", 30)])
    assert run("3", [("z", "inbox", 90)]) == seen
    seen = sorted([*seen, ("b", "processed", 95)])
    assert run("4", [("b", "processed", 95)]) == seen


def test_answered_tables(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    runs = spark.createDataFrame([("1", t(0)), ("2", t(0)), (None, t(0)), ("3", None)], "run_id string, at timestamp")
    said = spark.createDataFrame([("1", t(60), "ok"), ("1", t(61), "late"), ("2", t(-1), "early"), (None, t(1), "none"), ("3", t(1), "x")], "run_id string, said_at timestamp, verdict string")
    assert [(r["run_id"], r["verdict"]) for r in intake.answered(runs, said).collect()] == [("1", "ok")]
