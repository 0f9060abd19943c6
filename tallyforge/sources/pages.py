"""Pages and words of positioned text: the ingest contract, OCR routing and the redaction guard.

No PDF or OCR program is part of this library: a reader that gives the tables in `schema.WORDS` and `schema.PAGES` plugs
in through `read_with`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import garbage_ratio, matches_marker
from ..params import OCR_MAX_BAD_RATIO, OCR_MIN_CHARS, OCR_MIN_WORDS
from ..schema import WORDS


def read_with(files: DataFrame, reader: Callable[[bytes], pd.DataFrame]) -> DataFrame:
    """Words of each file by a plug-in that turns a file's bytes into page, word_idx, x, y, width, height, text, redacted, ocr_conf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, content in zip(batch["statement_id"], batch["content"]):
                out = reader(content)
                out.insert(0, "statement_id", key)
                yield out

    return files.select("statement_id", "content").mapInPandas(run, WORDS)


def needs_ocr(text: Column, boxes: Column) -> Column:
    """A page whose text layer is missing, thin or broken."""
    seen = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))
    return (seen == 0) | ((seen < OCR_MIN_CHARS) & (boxes < OCR_MIN_WORDS)) | (garbage_ratio(F.coalesce(text, F.lit(""))) > OCR_MAX_BAD_RATIO) | (boxes < OCR_MIN_WORDS)


def ocr_words(tsv: DataFrame, dpi: int = 300) -> DataFrame:
    """Word boxes from rows of an OCR program (left, top, width, height in pixels, conf, text): points, words only."""
    scale = 72.0 / dpi
    keep = (F.col("conf") >= 0) & (F.trim("text") != "")
    return tsv.where(keep).select("statement_id", "page", "word_idx", (F.col("left") * scale).alias("x"), (F.col("top") * scale).alias("y"), (F.col("width") * scale).alias("width"), (F.col("height") * scale).alias("height"), "text", F.lit(False).alias("redacted"), F.col("conf").alias("ocr_conf"))


def mean_confidence(words: DataFrame) -> DataFrame:
    return words.groupBy("statement_id", "page").agg(F.bround(F.avg(F.when(F.col("ocr_conf") >= 0, F.col("ocr_conf"))), 1).alias("ocr_conf"))


def guarded(words: DataFrame, boxes: DataFrame | None = None, markers: Sequence[str] | None = None, token: str = "[REDACTED]") -> DataFrame:
    """Words under a drawn box, or that are a marker or block glyphs, become the token; their text is not kept."""
    hidden = matches_marker(F.col("text"), markers) | F.coalesce(F.col("redacted"), F.lit(False))
    rows = words
    if boxes is not None:
        own = boxes.groupBy("statement_id", "page").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("__boxes"))
        rows = rows.join(own, ["statement_id", "page"], "left")
        hit = F.exists("__boxes", lambda b: (F.col("x") < b["x1"]) & (F.col("x") + F.col("width") > b["x0"]) & (F.col("y") < b["y1"]) & (F.col("y") + F.col("height") > b["y0"]))
        hidden = hidden | F.coalesce(hit, F.lit(False))
    rows = rows.withColumn("redacted", hidden)
    return rows.withColumn("text", F.when(F.col("redacted"), token).otherwise(F.col("text"))).drop("__boxes")


def section_anchors(pages: DataFrame, anchors: Sequence[str]) -> DataFrame:
    """Pages that print a section's anchor."""
    found = F.filter(F.array(*map(F.lit, anchors)), lambda a: F.position(F.lower(a), F.lower("text")) > 0)
    return pages.select("statement_id", "page", F.explode(found).alias("anchor"))
