"""Template detection: every file against every template, the best by score, origin and file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_ws


def header_score(header_cells: Column, marks: Column) -> Column:
    low = lambda a: F.transform(a, lambda x: F.lower(F.trim(x)))
    return F.size(F.array_intersect(low(marks), low(header_cells)))


def page_score(text: Column, marks: Column) -> Column:
    return F.size(F.filter(marks, lambda m: F.position(fold_ws(m), fold_ws(text)) > 0))


def scored(files: DataFrame, templates: DataFrame) -> DataFrame:
    """Each file (statement_id, kind, header_cells, page_text, path) with each template of its kind.

    Templates are a driver-side set of some dozens, so the pairs grow with the files alone.
    """
    pairs = files.join(templates, files["kind"] == templates["format"])
    score = F.when(F.col("format") == "pdf", page_score(F.col("page_text"), F.col("page_marks"))).otherwise(header_score(F.col("header_cells"), F.col("header_marks")))
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    hit = F.coalesce((F.col("format") == "delimited") & (F.col("filename_regex") != "") & F.regexp_like(name, F.col("filename_regex")), F.lit(False)).cast("int")
    return pairs.select("statement_id", "template_id", "origin_rank", "min_score", score.cast("double").alias("score"), hit.alias("filename_hit"), "header_marks", "page_marks")


def detect(files: DataFrame, templates: DataFrame) -> DataFrame:
    """template_id, score, matched, margin, runner_up, tied and detail of every file.

    A template contends from its own min_score on. The winner matches if it beats the runner-up on score, else on
    origin, else on the file name; otherwise the file is ambiguous and keeps the tied ids.
    """
    return judged(scored(files, templates), files)


def judged(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """The verdict on each of `files` from its scored pairs."""
    pairs = pairs.withColumn("eligible", F.col("score") >= F.col("min_score"))
    rank = F.struct((-F.col("eligible").cast("int")).alias("e"), (-F.col("score")).alias("s"), (-F.col("origin_rank")).alias("o"), (-F.col("filename_hit")).alias("f"), F.col("template_id").alias("id"), F.col("min_score").alias("m"))
    best = pairs.groupBy("statement_id").agg(F.array_sort(F.collect_list(rank)).alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    eligible = F.filter("r", lambda x: x["e"] == -1)
    one, two = F.get(eligible, F.lit(0)), F.get(eligible, F.lit(1))
    # a struct of nulls sorts first, so the lone contender is asked for by itself
    ahead = two.isNull() | (F.struct(one["s"], one["o"], one["f"]) < F.struct(two["s"], two["o"], two["f"]))
    matched = (F.size(eligible) > 0) & ahead
    tied = F.transform(F.filter(eligible, lambda x: x["s"] == one["s"]), lambda x: x["id"])
    detail = (
        F.when(matched, F.concat(F.lit("matched "), one["id"]))
        .when(F.size(eligible) > 0, F.concat(F.lit("ambiguous: "), one["id"], F.lit(" and "), two["id"]))
        .otherwise(F.concat(F.lit("closest "), first["id"], F.lit(" score "), (-first["s"]).cast("string"), F.lit("/"), first["m"].cast("string")))
    )
    out = best.select(
        "statement_id", first["id"].alias("template_id"), (-first["s"]).alias("score"), matched.alias("matched"), F.when(matched & two.isNotNull(), two["s"] - one["s"]).alias("margin"),
        F.when(matched, two["id"]).otherwise(second["id"]).alias("runner_up"), F.when(~matched & (F.size(eligible) >= 2), tied).otherwise(F.array().cast("array<string>")).alias("tied"), detail.alias("detail"),
    )
    return files.select("statement_id").join(out, "statement_id", "left").withColumns({"matched": F.coalesce("matched", F.lit(False)), "detail": F.coalesce("detail", F.lit("no templates match the file"))})


def ranked(pairs: DataFrame) -> DataFrame:
    """All candidates in order, for reports."""
    order = Window.partitionBy("statement_id").orderBy(F.desc("score"), F.desc("origin_rank"), F.desc("filename_hit"), "template_id")
    return pairs.withColumn("rank", F.row_number().over(order))
