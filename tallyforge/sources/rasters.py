"""Page rasters: solid dark regions, words under them, and skew. A raster is one row with its grey bytes.

Rows are statement_id, page, width and height (pixels), scale (points to a pixel) and grey (width x height bytes, row by row,
0 black). Whatever renders or decodes pages gives these; the work on pixels is NumPy within tasks, a page at a time. Where
pages can be rendered in the task that reads them, a `Render` goes with rows of statement_id, page, scale and what it needs, and
no pixels pass between tasks or through Arrow.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_redaction_evidence
from ..operators.geometry import rows as visual_rows
from ..params import DARK_LEVEL, OCCLUDED_SHARE, ROW_TOLERANCE

RASTERS = "statement_id string, page int, width int, height int, scale double, grey binary"
RECTS = "statement_id string, page int, x0 double, y0 double, x1 double, y1 double"
#: Ink for the skew search: darker than this; with fewer or more dark pixels than these there is nothing to measure.
INK, LEAST_INK, MOST_INK = 100, 200, 400_000
#: Pages that are handed on at once: each row may be megabytes.
PAGES = 16
#: Turns a few rows into the grey pixels (height x width) of each, in order. A page is done with before the next one is asked
#: for, so all may be painted on one array; a page without pixels is an empty array.
Render = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` dealt out by keys to all cores: work on pixels goes by pages, while Spark sizes its tasks by the bytes that they read."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def pixels(row) -> np.ndarray:
    """height x width of grey levels; a raster whose bytes don't fit its size is empty."""
    return as_pixels(row.grey, row.width, row.height)


def as_pixels(data: bytes | None, width: int | None, height: int | None) -> np.ndarray:
    grey = np.frombuffer(data or b"", dtype=np.uint8)
    return grey.reshape(height, width) if height and width and len(grey) == height * width else np.zeros((0, 0), dtype=np.uint8)


def as_given(part: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The `Render` of rows that have their pixels with them."""
    for row in zip(*(part.column(c).to_pylist() for c in ("grey", "width", "height"))):
        yield as_pixels(*row)


def runs(dark: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Runs of dark pixels of at least `least`: row, start and end (exclusive), row by row."""
    height, width = dark.shape
    flat = np.zeros(height * (width + 1) + 1, dtype=bool)  # a pixel of paper before each row and after the last
    flat[:-1].reshape(height, width + 1)[:, 1:] = dark
    edges = (flat[1:] != flat[:-1]).nonzero()[0]
    long = edges[1::2] - edges[::2] >= least
    return [(a // (width + 1), a % (width + 1), a % (width + 1) + n) for a, n in zip(edges[::2][long].tolist(), (edges[1::2] - edges[::2])[long].tolist())]


def tops(grey: np.ndarray) -> list[int]:
    """The rows that differ from the row above, and the first."""
    width = grey.shape[1]
    flat = np.ascontiguousarray(grey).ravel()
    if width % 8 == 0:
        width, flat = width // 8, flat.view(np.uint64)
    return sorted({0, *((flat[width:] != flat[:-width]).nonzero()[0] // width + 1).tolist()})


def stretches(grey: np.ndarray, least: int, level: int) -> list[tuple[int, int, int, int]]:
    """Dark runs as top, bottom (exclusive), start and end: rows that are all alike have the same runs and are looked at once."""
    top = tops(grey)
    bottom = [*top[1:], len(grey)]
    return [(top[i], bottom[i], a, b) for i, a, b in runs(grey[top] < level, least)]


def components(found: list[tuple[int, int, int, int]], gap: int) -> list[list[tuple[int, int, int, int]]]:
    """Stretches of runs in groups: two belong together if they share a column and at most `gap` rows lie between them."""
    parent = list(range(len(found)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(found) < 2:
        return [found] if found else []
    first = 0
    for i, (top, _, a, b) in enumerate(found):
        while found[first][1] < top - gap:
            first += 1
        for j in range(first, i):
            if found[j][0] < top and found[j][2] < b and a < found[j][3]:
                parent[root(i)] = root(j)
    groups: dict[int, list[tuple[int, int, int, int]]] = {}
    for i, own in enumerate(found):
        groups.setdefault(root(i), []).append(own)
    return list(groups.values())


def dark_boxes(grey: np.ndarray, scale: float, least_share: float = 0.10, least_height: float = 10.0, level: int = DARK_LEVEL, fill: float = 0.55, gap: int = 2) -> list[tuple[float, float, float, float]]:
    """Boxes (in points) of solid dark regions: runs of a tenth of the width, in bands high enough and mostly dark."""
    if not grey.size:
        return []
    out = []
    for own in components(stretches(grey, max(1, int(np.ceil(least_share * grey.shape[1]))), level), gap):
        tops, bottoms, starts, ends = zip(*own)
        y0, y1, x0, x1 = min(tops), max(bottoms), min(starts), max(ends)
        if (y1 - y0) * scale >= least_height and np.count_nonzero(grey[y0:y1, x0:x1] < level) / ((y1 - y0) * (x1 - x0)) >= fill:
            out.append((x0 * scale, y0 * scale, x1 * scale, y1 * scale))
    return sorted(out)


def _each(sheets: DataFrame, one: Callable, kind: str, render: Render | None = None) -> DataFrame:
    """Rows of `kind`: statement_id, page and what `one` gives for a page's pixels and scale."""
    names, kinds = zip(*(c.split() for c in kind.split(", ")))
    types = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[k] for k in kinds]
    draw = render or as_given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found: list[tuple] = []
            keys = list(zip(*(whole.column(c).to_pylist() for c in ("statement_id", "page", "scale"))))
            for at in range(0, whole.num_rows, PAGES):
                for (key, page, scale), grey in zip(keys[at : at + PAGES], draw(whole.slice(at, PAGES)), strict=True):
                    found += [(key, page, *x) for x in one(grey, scale)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * len(types), types)], names)

    return (sheets if render else sheets.select("statement_id", "page", "width", "height", "scale", "grey")).mapInArrow(run, kind)


def dark_regions(rasters: DataFrame, render: Render | None = None) -> DataFrame:
    """statement_id, page, x0, y0, x1, y1 (points) of every solid dark region. Rasters that are null or broken have none."""
    return _each(rasters, dark_boxes, RECTS, render)


def shares(grey: np.ndarray, boxes: np.ndarray, level: int = DARK_LEVEL) -> np.ndarray:
    """The dark share of each box (x0, y0, x1, y1 in pixels), by sums over the whole raster; 0 for an empty box."""
    return dark_shares(grey < level, boxes)


def dark_shares(dark: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The same of a mask of dark pixels."""
    low, high = np.floor(boxes[:, :2]).astype(int), np.ceil(boxes[:, 2:]).astype(int)
    return np.array(dark_parts(dark, zip(*low.T.tolist(), *high.T.tolist())), dtype=float)


def dark_parts(seen: np.ndarray, boxes: Iterable[tuple[int, int, int, int]], level: int = 0) -> list[float]:
    """The same of boxes in whole pixels, of a mask, or with `level` of grey. Boxes that are small beside the raster are counted
    one by one, not by sums over all of it."""
    height, width = seen.shape
    own = [(min(max(x0, 0), width), min(max(y0, 0), height), min(max(x1, 0), width), min(max(y1, 0), height)) for x0, y0, x1, y1 in boxes]
    area = [max(x1 - x0, 0) * max(y1 - y0, 0) for x0, y0, x1, y1 in own]
    if sum(area) > 4 * seen.size:
        sums = np.zeros((height + 1, width + 1), dtype=np.int64)
        sums[1:, 1:] = (seen < level if level else seen).cumsum(0).cumsum(1)
        held = [int(sums[y1, x1] - sums[y0, x1] - sums[y1, x0] + sums[y0, x0]) if n else 0 for (x0, y0, x1, y1), n in zip(own, area)]
    else:
        held = [int(np.count_nonzero(seen[y0:y1, x0:x1] < level if level else seen[y0:y1, x0:x1])) if n else 0 for (x0, y0, x1, y1), n in zip(own, area)]
    return [k / n if n else 0.0 for k, n in zip(held, area)]


def masks(rasters: DataFrame, level: int = DARK_LEVEL) -> DataFrame:
    """statement_id, page, rw, rh, scale and mask: the dark pixels as deflated bits, null where a raster is null or broken.

    A mask is a small part of its raster, so that rasters need not be shuffled to meet their words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES):
                part = whole.slice(at, PAGES)
                seen = (as_pixels(*r) for r in zip(*(part.column(c).to_pylist() for c in ("grey", "width", "height"))))
                mask = [zlib.compress(np.packbits(grey < level).tobytes(), 1) if grey.size else None for grey in seen]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("statement_id", "page", "width", "height", "scale")), pa.array(mask, pa.binary())], ["statement_id", "page", "rw", "rh", "scale", "mask"])

    return rasters.select("statement_id", "page", "width", "height", "scale", "grey").mapInArrow(run, "statement_id string, page int, rw int, rh int, scale double, mask binary")


def as_mask(data: bytes | None, width: int | None, height: int | None) -> np.ndarray:
    """height x width of dark pixels from `masks`; empty where there is none."""
    if data is None:
        return np.zeros((0, 0), dtype=bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(data), dtype=np.uint8), count=width * height).reshape(height, width).astype(bool)


def occluded(words: DataFrame, rasters: DataFrame, share: float = OCCLUDED_SHARE, least_area: float = 12.0, render: Render | None = None) -> DataFrame:
    """`words` with `redacted` set where most of a word's box is dark on its page's raster; `scanned` says whether there was one.

    Each page's words are one row that meets its raster's mask, or with `render` the row that it is drawn from, and a task holds a
    few pages at a time. Words without a box, or of less than `least_area` square points, are left as they are. The column
    `redacted` is added where words have none.
    """
    if "redacted" not in words.columns:
        words = words.withColumn("redacted", F.lit(False))
    keys = ["statement_id", "page"]
    listed = spread(words, *keys).groupBy(*keys).agg(F.collect_list(F.struct(*words.columns)).alias("w"))
    sheets = spread(rasters, *keys).withColumn("here", F.lit(True)) if render else masks(rasters)
    paged = listed.join(sheets, keys, "left")

    def looked(part: pa.RecordBatch) -> Iterator[np.ndarray]:
        """The mask of each row, or with `render` its grey pixels; empty where it has none."""
        if render is None:
            yield from (as_mask(*r) for r in zip(*(part.column(c).to_pylist() for c in ("mask", "rw", "rh"))))
            return
        here = part.column("here").is_valid()
        drawn = render(part.filter(here))
        for there in here.to_pylist():
            yield next(drawn) if there else np.zeros((0, 0), dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            listed, seen, under = whole.column("w"), [], []
            ends = (listed.offsets.to_numpy() - listed.offsets[0].as_py()).tolist()
            scale = np.repeat(whole.column("scale").to_numpy(zero_copy_only=False).astype(float), np.diff(ends))
            x, y, w, h = (listed.flatten().field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y", "width", "height"))
            known = np.isfinite(x) & np.isfinite(y) & np.isfinite(w) & np.isfinite(h) & np.isfinite(scale)
            known &= np.where(known, w * h, 0.0) >= least_area
            cut = lambda how, c: how(np.where(known, c / scale, 0.0)).astype(int).tolist()
            boxes, known = list(zip(cut(np.floor, x), cut(np.floor, y), cut(np.ceil, x + w), cut(np.ceil, y + h))), known.tolist()
            for at in range(0, whole.num_rows, PAGES):
                for i, found in enumerate(looked(whole.slice(at, PAGES)), at):
                    a, b = ends[i], ends[i + 1]
                    seen.append(found.size > 0)
                    under.append([k and s >= share for k, s in zip(known[a:b], dark_parts(found, boxes[a:b], DARK_LEVEL if render else 0))] if found.size else [False] * (b - a))
            yield pa.RecordBatch.from_arrays([listed, pa.array(seen, pa.bool_()), pa.array(under, pa.list_(pa.bool_()))], names=["w", "scanned", "dark"])

    kind = dict(listed.dtypes)["w"]
    found = paged.mapInArrow(run, f"w {kind}, scanned boolean, dark array<boolean>").select("scanned", F.explode(F.arrays_zip("w", "dark")).alias("z"))
    return found.select("z.w.*", "scanned", "z.dark").withColumn("redacted", F.coalesce("redacted", F.lit(False)) | F.col("dark")).select(*words.columns, "scanned")


def injected(words: DataFrame, rects: DataFrame, token: str = "[REDACTED]", most: float = 34.0) -> DataFrame:
    """`words` and, for every visual row that still shows a date or an amount, tokens across the dark boxes that cross the row.

    Boxes (statement_id, page, x0, y0, x1, y1) stand for words that were never in the text. Tokens follow each other at the
    median width of the row's words, from 8 points to `most`, so that every column below a box gets one.
    """
    seen = visual_rows(words.where(~F.coalesce("redacted", F.lit(False)) & (F.trim("text") != "")), ROW_TOLERANCE)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word_idx", "text"))), lambda w: w["text"]), " ")
    rows = seen.groupBy("statement_id", "page", "row").agg(line.alias("line"), F.min("y").alias("ry0"), F.max(F.col("y") + F.col("height")).alias("ry1"), F.median("height").alias("rh"), F.median("width").alias("rw"))
    rows = rows.where(has_redaction_evidence(F.col("line"))).withColumn("step", F.when(F.col("rw") > 0, F.greatest(F.lit(8.0), F.least(F.lit(most), F.col("rw")))).otherwise(most))
    hit = rows.join(rects.where("x1 > x0 and y1 > y0"), ["statement_id", "page"]).where("ry1 >= y0 and ry0 <= y1")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.col("x1") - 1 - F.col("x0")) / F.col("step")), F.lit(0)).cast("int")), lambda k: F.col("x0") + k * F.col("step"))
    new = hit.select("statement_id", "page", F.explode(starts).alias("x"), F.col("ry0").alias("y"), "x1", "step", F.col("rh").alias("height"))
    made = {"width": F.least(F.col("step") - 2, F.col("x1") - F.col("x")), "text": F.lit(token), "redacted": F.lit(True)}
    new = new.withColumns(made)
    return words.unionByName(new.select(*(c for c in words.columns if c in new.columns)), allowMissingColumns=True)


def skew_angle(grey: np.ndarray, most: float = 5.0, step: float = 0.05) -> float:
    """The angle in degrees at which rows of ink are sharpest: the greatest sum of squared row counts, of equals the least angle."""
    return ink_angle(grey < INK, most, step)


def ink_angle(ink: np.ndarray, most: float = 5.0, step: float = 0.05) -> float:
    """The same of a mask of ink.

    At each angle, columns that sink by the same whole number of rows are taken together: their ink is a difference of counts
    from the left, and only these few differences are shifted and added.
    """
    if not LEAST_INK <= np.count_nonzero(ink) <= MOST_INK:
        return 0.0
    own = np.flatnonzero(ink.any(1))
    rows = ink[own[0] : own[-1] + 1]
    height, width = rows.shape
    left = np.zeros((width + 1, height), dtype=np.int32)
    np.cumsum(rows.T, axis=0, out=left[1:])
    best, score = 0.0, -1
    for a, cut in sinking(width, most, step):
        k = len(cut) - 1
        own = left[cut]
        part = np.zeros((k, height + k), dtype=np.int32)
        np.subtract(own[1:], own[:-1], out=part[:: -1 if a > 0 else 1, :height])  # where the slope is positive the later columns rise
        # read with rows one shorter, each part lies one further down than the one before
        level = part.ravel()[: k * (height + k - 1)].reshape(k, height + k - 1).sum(0)
        found = int(np.dot(level, level))
        if found > score:
            best, score = a, found
    return round(best, 2)


@functools.lru_cache(maxsize=4)
def sinking(width: int, most: float, step: float) -> list[tuple[float, np.ndarray]]:
    """The angles to try, least first, each with the columns at which a line at that angle comes to the next row."""
    x, steps, out = np.arange(width), int(round(most / step)), []
    for a in sorted((k * step for k in range(-steps, steps + 1)), key=lambda a: (abs(a), a)):
        sunk = np.floor(-x * np.tan(np.radians(a)))
        out.append((a, np.concatenate([[0], np.flatnonzero(np.diff(sunk)) + 1, [width]])))
    return out


def source_of(height: int, width: int, angle: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pixel of a raster turned back by an angle: whether it has a source, and that one's row and column."""
    t, cx, cy = np.radians(angle), (width - 1) / 2, (height - 1) / 2
    x, y = np.arange(width)[None, :] - cx, np.arange(height)[:, None] - cy
    sx = np.rint(np.cos(t) * x - np.sin(t) * y + cx).astype(np.int32)
    sy = np.rint(np.sin(t) * x + np.cos(t) * y + cy).astype(np.int32)
    return (sx >= 0) & (sx < width) & (sy >= 0) & (sy < height), sy, sx


def straightened(grey: np.ndarray, angle: float) -> np.ndarray:
    """The raster turned back by an angle, of the same size, white where nothing was."""
    inside, sy, sx = source_of(*grey.shape, angle)
    out = np.full_like(grey, 255)
    out[inside] = grey[sy[inside], sx[inside]]
    return out


@functools.lru_cache(maxsize=64)
def _angles(height: int, width: int, bits: bytes, least: float) -> tuple[float, float]:
    """The angle of a picture of ink, and what is left of it after straightening if it is more than `least` degrees. Some
    pictures are remembered by all of their bits: blank pages, forms and copies come again and again."""
    ink = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=height * width).reshape(height, width).astype(bool)
    angle = ink_angle(ink)
    if abs(angle) <= least:
        return angle, angle
    inside, sy, sx = source_of(height, width, angle)
    turned = np.zeros_like(ink)
    turned[inside] = ink[sy[inside], sx[inside]]
    return angle, ink_angle(turned)


def angles(grey: np.ndarray, least: float) -> tuple[float, float]:
    return _angles(*grey.shape, np.packbits(grey < INK).tobytes(), least)


def skew(rasters: DataFrame, render: Render | None = None) -> DataFrame:
    """statement_id, page and angle (degrees, positive where rows fall to the right) of every raster; 0 where it can't be told."""
    return _each(rasters, lambda grey, scale: [angles(grey, math.inf)[:1]], "statement_id string, page int, angle double", render)


def straightness(rasters: DataFrame, least: float = 0.3, render: Render | None = None) -> DataFrame:
    """statement_id, page, angle as `skew` has it, and left: what `skew` finds on the raster as `deskewed` leaves it.

    One pass over the pages; neither the straightened rasters nor a join of the two angles is needed.
    """
    return _each(rasters, lambda grey, scale: [angles(grey, least)], "statement_id string, page int, angle double, left double", render)


def deskewed(rasters: DataFrame, least: float = 0.3) -> DataFrame:
    """`rasters` with every page turned straight whose skew is more than `least` degrees, and that angle. A raster without
    pixels stays as it is."""
    schema = RASTERS + ", angle double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PAGES):
                part, out = batch.iloc[at : at + PAGES], []
                for r in part.itertuples(index=False):
                    grey = pixels(r)
                    angle = skew_angle(grey)
                    turned = abs(angle) > least
                    out.append((r.statement_id, r.page, r.width, r.height, r.scale, straightened(grey, angle).tobytes() if turned else r.grey, angle if turned else 0.0))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rasters.select("statement_id", "page", "width", "height", "scale", "grey").mapInPandas(run, schema)
