"""Command line: convert a folder of files and write its results."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from . import engine, vocab
from .operators import outputs, templates
from .session import session
from .sources import logs


def main(args: list[str] | None = None) -> int:
    """0 if every file is ok or needs review, 1 if one is not, 2 for wrong usage."""
    parser = argparse.ArgumentParser(prog="tallyforge", description=__doc__)
    parser.add_argument("input")
    parser.add_argument("--templates", required=True)
    parser.add_argument("--user-templates")
    parser.add_argument("--template", help="use this template for every file")
    parser.add_argument("--lexicon", help="a site's word lists (YAML)")
    parser.add_argument("--labels", help="a site's labels (YAML)")
    parser.add_argument("--forms", help="a folder of form templates")
    parser.add_argument("--log", help="a folder to which a record of every file is added")
    parser.add_argument("--out", required=True)
    try:
        own = parser.parse_args(args)
    except SystemExit:
        return 2
    spark = session()
    known = templates.merge(templates.load(own.templates), templates.load(own.user_templates, "user", strict=False) if own.user_templates else {})
    found = engine.convert(spark, own.input, known, own.template, lexicon=vocab.load(own.lexicon), label_words=vocab.load(own.labels), forms=templates.load_forms(own.forms) if own.forms else None)
    found.results.write.mode("overwrite").parquet(f"{own.out}/results")
    found.diagnostics.write.mode("overwrite").parquet(f"{own.out}/diagnostics")
    outputs.checks_table(found.reconciled).write.mode("overwrite").parquet(f"{own.out}/checks")
    outputs.write_csv(outputs.display(found.transactions.drop("extras", "source_ref", "raw")), f"{own.out}/transactions")
    if found.fields is not None:
        found.fields.write.mode("overwrite").parquet(f"{own.out}/fields")
    if found.statements is not None:
        found.statements.write.mode("overwrite").parquet(f"{own.out}/statements")
    if own.log:
        logs.append(engine.run_records(found, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")), own.log, "runs")
    bad = spark.read.parquet(f"{own.out}/results").where("status not in ('ok', 'needs_review')").count()
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
