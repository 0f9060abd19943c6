"""Word boxes: frames, bands, rows and cells of positioned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import looks_money
from ..params import A4_HEIGHT, A4_WIDTH, ROW_TOLERANCE, SCALE_SNAP


def frame_scale(page: Column, frame: float) -> Column:
    """Page to template frame; a page within two per cent of it counts as the same size."""
    s = F.when(page > 0, F.lit(frame) / page).otherwise(1.0)
    return F.when(F.abs(s - 1) < SCALE_SNAP, 1.0).otherwise(s)


def to_frame(words: DataFrame, pages: DataFrame, width: float = A4_WIDTH, height: float = A4_HEIGHT) -> DataFrame:
    sizes = pages.select("statement_id", "page", frame_scale(F.col("width"), width).alias("__sx"), frame_scale(F.col("height"), height).alias("__sy"))
    rows = words.join(sizes, ["statement_id", "page"], "left").fillna(1.0, ["__sx", "__sy"])
    return rows.withColumns({"x": F.col("x") * F.col("__sx"), "width": F.col("width") * F.col("__sx"), "y": F.col("y") * F.col("__sy"), "height": F.col("height") * F.col("__sy")}).drop("__sx", "__sy")


def in_region(x_min: float | None = None, x_max: float | None = None, y_min: float | None = None, y_max: float | None = None) -> Column:
    """Words that reach into a box; a bound that is None does not count."""
    out = F.lit(True)
    if x_min is not None:
        out &= F.col("x") + F.col("width") >= x_min
    if x_max is not None:
        out &= F.col("x") <= x_max
    if y_min is not None:
        out &= F.col("y") >= y_min
    if y_max is not None:
        out &= F.col("y") <= y_max
    return out


def band(bands: dict[str, dict], centre: Column | None = None) -> Column:
    """The first band that holds a word's centre: bands are literals, so this is no join."""
    cx = F.col("x") + F.col("width") / 2 if centre is None else centre
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, b in bands.items():
        out = out.when(cx.between(b["x_min"], b["x_max"]), F.lit(name))
    return out


def rows(words: DataFrame, tolerance: float = ROW_TOLERANCE, *keys: str) -> DataFrame:
    """Words of a page in visual rows: a row ends where a word lies more than `tolerance` below the row's first word.

    The bound is the row's own start, so the rows are a fold over the page's words in reading order; a page is bounded.
    """
    by = ["statement_id", "page", *keys]
    conf = F.col("ocr_conf") if "ocr_conf" in words.columns else F.lit(None).cast("double").alias("ocr_conf")
    word = F.struct("y", "x", "width", "height", "text", "word_idx", conf)
    page = words.groupBy(*by).agg(F.array_sort(F.collect_list(word)).alias("w"))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("ref"), F.array().cast("array<int>").alias("g"))

    def step(a: Column, w: Column) -> Column:
        new = a["ref"].isNull() | (w["y"] > a["ref"] + tolerance)
        n = a["n"] + F.when(new, 1).otherwise(0)
        return F.struct(n.alias("n"), F.when(new, w["y"]).otherwise(a["ref"]).alias("ref"), F.array_append(a["g"], n).alias("g"))

    folded = page.withColumn("g", F.aggregate("w", start, step, lambda a: a["g"]))
    return folded.select(*by, F.explode(F.arrays_zip("g", "w")).alias("z")).select(*by, F.col("z.g").alias("row"), "z.w.*")


def lines(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Reading-order text: a new line where the next word lies more than `tolerance` below the last."""
    order = Window.partitionBy("statement_id", "page").orderBy("y", "x", "word_idx")
    gap = F.coalesce(F.col("y") - F.lag("y").over(order) > tolerance, F.lit(False)).cast("int")
    numbered = words.withColumn("__gap", gap).withColumn("line", F.sum("__gap").over(order) + 1)
    parts = F.array_sort(F.collect_list(F.struct("x", "word_idx", "text")))
    return numbered.groupBy("statement_id", "page", "line").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def cells(placed: DataFrame, bands: dict[str, dict], sure: tuple[str, ...] = ("date", "amount", "balance", "debit", "credit")) -> DataFrame:
    """The text of each band of each row, words from left to right; a word may stand in several bands. `conf` is the least
    OCR confidence among the words of the bands in `sure`."""
    cx = F.col("x") + F.col("width") / 2
    own = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda p: p["text"]), " ")
    word = F.struct("x", "word_idx", "text")
    out = [F.nullif(own(F.when(cx.between(b["x_min"], b["x_max"]), word)), F.lit("")).alias(name) for name, b in bands.items()]
    weighed = F.lit(False)
    for name, b in bands.items():
        if name in sure:
            weighed |= cx.between(b["x_min"], b["x_max"])
    conf = F.min(F.when(weighed, F.col("ocr_conf"))) if "ocr_conf" in placed.columns else F.lit(None).cast("double")
    return placed.groupBy("statement_id", "page", "row").agg(*out, conf.alias("conf"), own(word).alias("raw"), F.min("y").alias("y0"), F.max(F.col("y") + F.col("height")).alias("y1"), F.median("height").alias("h"))


def overlaps(words: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Words that touch one of a page's boxes (x0, y0, x1, y1): boxes are literals."""
    hit = F.lit(False)
    for x0, y0, x1, y1 in boxes:
        hit |= (F.col("x") < x1) & (F.col("x") + F.col("width") > x0) & (F.col("y") < y1) & (F.col("y") + F.col("height") > y0)
    return words.where(hit)


def clusters(values: DataFrame, name: str, gap: float, *keys: str) -> DataFrame:
    """One-dimensional clusters: a new one where the next value is more than `gap` away."""
    order = Window.partitionBy(*keys).orderBy(name)
    new = F.coalesce(F.col(name) - F.lag(name).over(order) > gap, F.lit(False)).cast("int")
    return values.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, 0)) + 1).drop("__new")


def best_page(words: DataFrame) -> DataFrame:
    """statement_id and best_page: the page with the most words that look like money, the first on a tie."""
    pages = words.groupBy("statement_id", "page").agg(F.count_if(looks_money(F.col("text"))).alias("n"))
    return pages.groupBy("statement_id").agg(F.max_by("page", F.struct("n", -F.col("page"))).alias("best_page"))
