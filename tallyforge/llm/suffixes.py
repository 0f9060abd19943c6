"""Removal of long repeated strings by a logarithmic family of sparse suffix arrays.

A suffix is indexed at a sampled place only: where the hash of its first HEAD bytes is the least among the heads that
start within one window of SPAN bytes. Any two equal strings of SPAN bytes sample the same place, so none is missed. A
suffix array is the table of sampled heads in order of their hashes; equality is all that is asked of it.

Documents arrive in batches. A batch's array is merge-scanned against every level of the index for heads that are known
already, then becomes a level itself; two levels of equal rank merge into one of the next. What has been hit is settled
on the bytes: around each hit the strings of SPAN bytes that hold the head are sorted and compared, and the first and
last that occur elsewhere give the stretch to remove.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, remove

SPAN, HEAD = 400, 128
BLOCK = 1 << 21
BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xFF51AFD7ED558CCD)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
DIGITS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


INVERSE = pow(BASE, -1, 1 << 64)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        _TABLES[size] = _powers(BASE, size), _powers(INVERSE, size)
    up, down = _TABLES[size]
    return up[:n], down[:n]


def head_hashes(data: np.ndarray, head: int) -> np.ndarray:
    """A hash of each string of `head` bytes in the buffer."""
    up, down = _tables(len(data))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(DIGITS[data] * up, dtype=np.uint64)))
    out = (sums[head:] - sums[:-head]) * down[: len(data) - head + 1]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return out


def _running(values: np.ndarray, width: int, pick: np.ufunc, fill: np.uint64) -> np.ndarray:
    """pick over each run of `width` values: from the last block boundary before it, and to the next one."""
    n = len(values)
    rows = -(-n // width)
    table = np.full(rows * width, fill, dtype=np.uint64)
    table[:n] = values
    table = table.reshape(rows, width)
    ahead = pick.accumulate(table, axis=1).ravel()
    behind = pick.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def sampled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the buffer that are sampled, and the hashes of their heads; no string crosses from one piece into the next."""
    width = span - head + 1
    if len(data) < span:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    hashes = head_hashes(data, head)
    np.minimum(hashes, NONE - np.uint64(1), out=hashes)
    late = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(late, np.maximum(starts, ends - head + 1), 1)
    np.add.at(late, ends, -1)
    hashes[np.cumsum(late[: len(hashes)]) > 0] = NONE
    least = _running(hashes, width, np.minimum, NONE)
    late[:] = 0
    np.add.at(late, np.maximum(starts, ends - span + 1), 1)
    np.add.at(late, ends, -1)
    least[np.cumsum(late[: len(least)]) > 0] = 0
    padded = np.concatenate((np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)))
    most = _running(padded, width, np.maximum, np.uint64(0))[: len(hashes)]
    at = np.nonzero((hashes == most) & (hashes != NONE))[0]
    return at, hashes[at]


def places(texts: list[bytes], span: int, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, byte offset and head hash of each sampled place; long texts are read in blocks that overlap."""
    found = []
    pieces: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if pieces:
            sizes = np.array([len(p[2]) for p in pieces], dtype=np.int64)
            ends = np.cumsum(sizes)
            at, hashes = sampled(np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8), ends - sizes, ends, span, head)
            own = np.searchsorted(ends, at, side="right")
            found.append((np.array([p[0] for p in pieces])[own], at - (ends - sizes)[own] + np.array([p[1] for p in pieces])[own], hashes))
            pieces.clear()

    held = 0
    for number, text in enumerate(texts):
        if len(text) < span:
            continue
        for start in range(0, len(text) - span + 1, BLOCK):
            part = text[start : start + BLOCK + span - 1]
            if held + len(part) > BLOCK + span and pieces:
                flush()
                held = 0
            pieces.append((number, start, part))
            held += len(part)
    flush()
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    number, offset, hashes = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((offset, number))  # blocks of one text overlap: a place may come twice
    number, offset, hashes = number[order], offset[order], hashes[order]
    new = np.ones(len(number), dtype=bool)
    new[1:] = (number[1:] != number[:-1]) | (offset[1:] != offset[:-1])
    return number[new], offset[new], hashes[new]


KEY = ["rk", "dk"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, data (UTF-8 of the text) and a key: rows with the same key have the same doc_id and text."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id"), data.alias("data"), F.xxhash64(own, data).alias("rk"), F.coalesce(own, F.lit(-(1 << 62))).alias("dk"))


class LevelIndex:
    """The family of levels. Each is a table of heads with how often they occur, in order within its partitions."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.hits: list[str] = []

    def add(self, heads: DataFrame) -> DataFrame:
        """Take in a batch (h, one row per place); the heads that now occur twice or more and that this batch has."""
        array = heads.groupBy("h").agg(F.count("*").alias("n")).sortWithinPartitions("h")
        array, path = materialise(array, "suffix-level", tidy=True)
        hits = array.where("n > 1").select("h")
        for _, level, _ in self.levels:
            hits = hits.union(array.join(level.select("h"), "h", "left_semi").select("h"))
        hits, hits_path = materialise(hits.distinct(), "suffix-hits", tidy=True)
        self.hits.append(hits_path)
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, other, old = self.levels.pop()
            merged = array.union(other).groupBy("h").agg(F.sum("n").alias("n")).sortWithinPartitions("h")
            new, new_path = materialise(merged, "suffix-level", tidy=True)
            remove(self.spark, path, old)
            array, path, rank = new, new_path, rank + 1
        self.levels.append((rank, array, path))
        return hits

    def drop(self) -> None:
        """Delete the levels and the hits that were returned."""
        remove(self.spark, *(path for _, _, path in self.levels), *self.hits)
        self.levels, self.hits = [], []


def _column_hashes(texts: list[bytes], lefts: np.ndarray, span: int, head: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each offset of a string of `span` bytes around the head: rows that have it, and its hash. Heads are aligned."""
    reach = span - head
    sizes = np.array([len(t) for t in texts])
    table = np.zeros((len(texts), head + 2 * reach), dtype=np.uint8)
    for row, (text, left) in enumerate(zip(texts, lefts)):
        table[row, reach - left : reach - left + len(text)] = np.frombuffer(text, dtype=np.uint8)
    first, last = reach - lefts, reach - lefts + sizes
    up = _powers(BASE, span)
    columns = np.ascontiguousarray(table.T)
    rolling = np.zeros(len(texts), dtype=np.uint64)
    for j in range(span):
        rolling += DIGITS[columns[j]] * up[j]
    for s in range(reach + 1):
        if s:
            rolling = (rolling - DIGITS[columns[s - 1]]) * np.uint64(INVERSE) + DIGITS[columns[s + span - 1]] * up[span - 1]
        yield s, np.nonzero((first <= s) & (last >= s + span))[0], rolling


def settle(texts: list[bytes], lefts: np.ndarray, often: np.ndarray, span: int, head: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last offset at which a string of `span` bytes occurs elsewhere; -1 where none does.

    Each row is a different surrounding of a head, `often` how many places have it. Strings are sorted by hash offset by
    offset; equal neighbours are a repeat.
    """
    low, high = np.full(len(texts), -1), np.full(len(texts), -1)
    for s, rows, rolling in _column_hashes(texts, lefts, span, head):
        own = rolling[rows]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        repeat = often[rows] > 1
        repeat[order[1:][same]] = True
        repeat[order[:-1][same]] = True
        hit = rows[repeat]
        high[hit] = s
        low[hit[low[hit] < 0]] = s
    return low, high


def repeated_spans(docs: DataFrame, span: int = SPAN, head: int = HEAD, batches: int = 4, hot_rows: int = 200_000) -> DataFrame:
    """KEY and spans (array of start, end in bytes, may overlap) for documents that hold a repeated string.

    Heads with more than `hot_rows` different surroundings are not brought into one task: their strings are dealt out
    by hash, counted and joined back. Each intermediate table, and what was shuffled for it, goes once it has been used.
    """
    spark, reach = docs.sparkSession, span - head

    def sample(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            number, offset, hashes = places(part.column("data").to_pylist(), span, head)
            at = pa.array(number)
            yield pa.RecordBatch.from_arrays([part.column("rk").take(at), part.column("dk").take(at), pa.array(offset.astype(np.int32)), pa.array(hashes.view(np.int64))], [*KEY, "at", "h"])

    found = _keyed(docs).select("data", *KEY).mapInArrow(sample, "rk long, dk long, at int, h long")
    found, found_path = materialise(found.withColumn("batch", F.expr(f"pmod(rk, {batches})").cast("int")), "suffix-places", ["batch"])
    index, hits = LevelIndex(spark), None
    for batch in range(batches):
        new = index.add(found.where(F.col("batch") == batch).select("h"))
        hits = new if hits is None else hits.union(new)
    marks = found.join(hits.distinct(), "h", "left_semi").groupBy(*KEY).agg(F.collect_set(F.struct("at", "h")).alias("marks"))
    marks, marks_path = materialise(marks, "suffix-marks", tidy=True)
    index.drop()
    remove(spark, found_path)

    def surround(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for whole in parts:
            for start in range(0, whole.num_rows, 256):  # few documents at a time: each may have many marks
                part, out = whole.slice(start, 256), [[] for _ in kinds]
                for k, d, data, marks in zip(*(part.column(c).to_pylist() for c in (*KEY, "data", "marks"))):
                    for mark in marks:
                        own = max(0, mark["at"] - reach)
                        text = data[own : mark["at"] + head + reach]
                        name = xxhash.xxh3_64_intdigest(text, mark["at"] - own) - (1 << 63)
                        row = (k, d, mark["at"], mark["h"], name, mark["at"] - own, None if name in seen else text)
                        for column, value in zip(out, row):
                            column.append(value)
                        if len(seen) < 1_000_000:  # only saves sending a text again
                            seen.add(name)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [*KEY, "at", "h", "cid", "left", "ctx"])

    held = _keyed(docs).select("data", *KEY).join(marks, KEY).mapInArrow(surround, "rk long, dk long, at int, h long, cid long, left int, ctx binary")
    held, held_path = materialise(held, "suffix-around", tidy=True)
    remove(spark, marks_path)
    kinds = held.groupBy("h", "cid").agg(F.count("*").alias("n"), F.max("left").alias("left"), F.max("ctx").alias("ctx"))
    kinds, kinds_path = materialise(kinds, "suffix-kinds", tidy=True)
    # a table of its own, so that its size is known: it is empty but for heads of very many surroundings
    heat, heat_path = materialise(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot_rows).select("h"), "suffix-heat", tidy=True)
    calm, hot = kinds.join(heat, "h", "left_anti"), kinds.join(heat, "h", "left_semi")

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []

        def answer(pdf: pd.DataFrame) -> pd.DataFrame:
            low, high = settle(pdf["ctx"].tolist(), pdf["left"].to_numpy(), pdf["n"].to_numpy(), span, head)
            return pd.DataFrame({"h": pdf["h"].to_numpy(), "cid": pdf["cid"].to_numpy(), "low": low.astype(np.int32), "high": high.astype(np.int32)})[low >= 0]

        for pdf in parts:  # rows come in order of h; the last head may go on in the next batch
            if not len(pdf):
                continue
            last = pdf["h"].iloc[-1]
            whole, rest = pdf[pdf["h"] != last], pdf[pdf["h"] == last]
            if len(whole):
                yield answer(pd.concat([*kept, whole]))
                kept = []
            kept.append(rest)
        if kept:
            yield answer(pd.concat(kept))

    answers = calm.repartition("h").sortWithinPartitions("h").select("h", "cid", "n", "left", "ctx").mapInPandas(solve, "h long, cid long, low int, high int")
    strings, strings_path = _hot_strings(hot, span, head)
    answers = answers.union(_hot_answers(strings))
    spans = held.select(*KEY, "at", "h", "cid").join(answers, ["h", "cid"]).select(*KEY, F.struct((F.col("at") + F.col("low") - reach).alias("start"), (F.col("at") + F.col("high") - reach + span).alias("end")).alias("s"))
    spans, _ = materialise(spans.groupBy(*KEY).agg(F.collect_set("s").alias("spans")), "suffix-spans", tidy=True)
    remove(spark, held_path, kinds_path, heat_path, strings_path)
    return spans


def _hot_strings(hot: DataFrame, span: int, head: int) -> tuple[DataFrame, str]:
    """Every string of heads with very many surroundings as a row."""

    def strings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for a in range(0, len(pdf), 4096):
                own = pdf.iloc[a : a + 4096]
                h, cid, n = (own[c].to_numpy() for c in ("h", "cid", "n"))
                for s, rows, rolling in _column_hashes(own["ctx"].tolist(), own["left"].to_numpy(), span, head):
                    if len(rows):
                        yield pd.DataFrame({"h": h[rows], "cid": cid[rows], "n": n[rows], "s": np.int32(s), "w": rolling[rows].view(np.int64)})

    return materialise(hot.select("h", "cid", "n", "left", "ctx").mapInPandas(strings, "h long, cid long, n long, s int, w long"), "suffix-hot", tidy=True)


def _hot_answers(rows: DataFrame) -> DataFrame:
    """The same answers from rows of strings, which are counted."""
    twice = rows.groupBy("h", "s", "w").agg(F.sum("n").alias("all")).where("all > 1").select("h", "s", "w")
    return rows.join(twice, ["h", "s", "w"]).groupBy("h", "cid").agg(F.min("s").alias("low"), F.max("s").alias("high"))


def without_repeats(docs: DataFrame, span: int = SPAN, batches: int = 4) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end: what is removed, joined and in order) and kept (the remaining bytes).

    Each byte covered by a string of `span` bytes that also starts anywhere else, in the same document or another, is
    removed; overlaps count, and strings are judged on the input. A null text is empty; a null doc_id is carried along;
    a repeated row is another document, so its long strings are repeats; very long texts are read in blocks that
    overlap; an empty table gives no rows; other columns are ignored.
    """
    spans = repeated_spans(docs, span, min(HEAD, span // 3), batches)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            joined, kept = [], []
            for data, own in zip(part.column("data").to_pylist(), part.column("spans").to_pylist()):
                runs: list[list[int]] = []
                for start, end in sorted((s["start"], s["end"]) for s in own or []):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                edges = [0, *(x for run in runs for x in run), len(data)]
                joined.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(d) for d in part.column("data").to_pylist()], pa.int64()), pa.array(joined, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return _keyed(docs).join(spans, KEY, "left").select("doc_id", "data", "spans").mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op7_suffixes(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
