"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tallyforge.plans import registry

HEADLINE = [
    "reconcile_statements", "ledger_running_balance", "summary_cards", "flow_by_week", "cumulative_net", "money_signed", "date_styles", "runs_overview", "unsupported_clusters", "template_usage", "template_drift",
    "feed_gate", "feed_upsert", "anchored_rows", "word_bands", "quoted_records", "label_match", "masked_text", "column_profiles", "field_coverage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    found, names = {}, registry.queries()
    for name in HEADLINE:
        start = time.perf_counter()
        names[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        found[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
