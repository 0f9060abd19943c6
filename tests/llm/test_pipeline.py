"""The pipeline on odd rows: nulls, empty and repeated rows, clashing names, an empty table."""

from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from tallyforge.llm import pieces

KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
EXTRA = ["__copy", "row", "found", "__bad", "key", "sig", "times"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} int" for c in EXTRA)


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer files here")
def test_odd_rows(spark, tmp_path):
    r = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    good = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    texts = [good(r.randint(60, 120)) for _ in range(40)]
    near = texts[0].replace("word", "word", 1)
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)]
    rows += [(100, near, "en", "a"), (101, texts[1] + " one", "en", "b"), (102, texts[2] + f' token = "{KEY}"', None, None), (103, None, None, None), (104, "", "en", "a"), (5, texts[5], "en", "b"), (None, good(80), "en", "a")]
    rows += [(200 + i, "### " * 60, "en", "a") for i in range(10)]
    docs = spark.createDataFrame([(*x, len(x[1] or ""), *range(len(EXTRA))) for x in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, 0) for i in range(40)] + [(200 + i, 0, 0) for i in range(10)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), "odd")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
        kept.append([x.asDict() for x in docs.collect()])
    quality, single, clean, mixed = kept
    assert not any(x["doc_id"] is not None and x["doc_id"] >= 200 for x in quality) and {x["doc_id"] for x in quality} >= set(range(40)) - {5}
    ids = [x["doc_id"] for x in single]
    assert 100 not in ids and 101 not in ids and set(range(40)) <= set(ids) and None in ids
    assert len(clean) == len(single) and not any(KEY in (x["text"] or "") for x in clean)
    assert {x["doc_id"] for x in mixed} <= set(ids) and all(x[c] == i for x in mixed for i, c in enumerate(EXTRA))
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(last) == len(mixed) and all(x["parity"] and x["round_trip"] for x in last)


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer files here")
def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
