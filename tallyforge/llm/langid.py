"""Language identification by interpolated Kneser-Ney models of four characters.

Characters fold to 64 symbols: 0 for any run of what is not a letter, 1 to 26 for a to z, the rest by code point modulo
37, which keeps the letters of one alphabet apart. Four symbols make a code of 24 bits. The counts of all training texts
are summed by Spark; discounts, continuation counts and back-off weights follow from them. A model's probabilities lie
in an array beside the sorted array of hashed codes. A text goes to the language with the lowest cross-entropy per
symbol; one that fits even that language worse than nearly all its training texts do is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise

ORDER, BITS = 4, 6
SYMBOLS, CODES = 1 << BITS, 1 << (ORDER * BITS)
PART = 1 << 21
_FOLD: list[np.ndarray] = []


def symbol(char: str) -> int:
    if not char.isalpha():
        return 0
    low = char.lower()[0]
    return ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 37


def folding() -> np.ndarray:
    if not _FOLD:
        _FOLD.append(np.fromiter((symbol(chr(c)) for c in range(0x110000)), dtype=np.uint8, count=0x110000))
    return _FOLD[0]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts one after the other, and how many each has; a text without a letter has none."""
    table, out, sizes = folding(), [], []
    for text in texts:
        own = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if not own.any():
            sizes.append(0)
            continue
        own = np.concatenate(([0], own, [0]))
        own = own[1:][(own[1:] != 0) | (own[:-1] != 0)].astype(np.int32)
        padded = np.concatenate((np.zeros(ORDER - 1, dtype=np.int32), own))
        out.append((padded[:-3] << 18) | (padded[1:-2] << 12) | (padded[2:-1] << 6) | own)
        sizes.append(len(own))
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.int32)), np.array(sizes, dtype=np.int64)


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > PART:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def hashed(code: np.ndarray) -> np.ndarray:
    return code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(one / (one + 2 * two)) if one else 0.5


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # sorted hashes of codes
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.float32))  # one column per language
    back: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.float32))  # log weight of a context of three
    lower: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.float32))  # log probability in order three

    def log_table(self, code: np.ndarray) -> np.ndarray:
        """Log probability of each code in each language."""
        out = self.back[code >> BITS] + self.lower[code & (CODES // SYMBOLS - 1)]
        key = hashed(code)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        if len(self.keys):
            known = self.keys[at] == key
            own = self.logs[at[known]]
            out[known] = np.where(np.isnan(own), out[known], own)
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per symbol of each text in each language; not a number for texts without a letter."""
        out = np.full((len(texts), len(self.langs)), np.nan)
        seen, place = np.zeros(CODES, dtype=bool), np.zeros(CODES, dtype=np.int32)
        for a, b in _pieces(texts):
            code, sizes = codes(texts[a:b])
            if not len(code) or not self.langs:
                continue
            seen[code] = True
            own = np.nonzero(seen)[0]
            seen[own] = False
            place[own] = np.arange(len(own))
            table = self.log_table(own)
            full = np.nonzero(sizes)[0]
            starts = (np.cumsum(sizes) - sizes)[full]
            at = place[code]
            for k in range(len(self.langs)):
                out[a + full, k] = -np.add.reduceat(table[:, k].astype(np.float64)[at], starts) / sizes[full]
        return out


def _lower_order(gram: np.ndarray, count: np.ndarray, order: int, below: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of every gram of `order` symbols from continuation counts; `below` has the order below."""
    size = SYMBOLS**order
    counts = np.bincount(gram, count, size)
    d = _discount(counts[counts > 0])
    by = counts.reshape(-1, SYMBOLS)
    total, kinds = by.sum(axis=1, keepdims=True), (by > 0).sum(axis=1, keepdims=True)
    rest = np.tile(below.reshape(-1, SYMBOLS), (len(by) // max(1, below.size // SYMBOLS), 1)) if order > 1 else np.full((1, SYMBOLS), 1 / SYMBOLS)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(total > 0, np.maximum(by - d, 0) / total + d * kinds / total * rest, rest)
    return out.ravel()


def train(lang: np.ndarray, code: np.ndarray, count: np.ndarray) -> Model:
    """Models from counts of codes by language."""
    langs = sorted(set(lang.tolist()))
    model = Model(langs)
    if not langs:
        return model
    own_codes = np.unique(code)
    keys = hashed(own_codes)
    order = np.argsort(keys)
    model.keys = keys[order]
    model.logs = np.full((len(keys), len(langs)), np.nan, dtype=np.float32)
    model.back = np.zeros((CODES // SYMBOLS, len(langs)), dtype=np.float32)
    model.lower = np.zeros((CODES // SYMBOLS, len(langs)), dtype=np.float32)
    for k, name in enumerate(langs):
        own = lang == name
        c, n = code[own], count[own].astype(np.float64)
        three = np.unique(c) & (SYMBOLS**3 - 1)  # each kind of code continues its last three symbols once
        two = np.unique(three) & (SYMBOLS**2 - 1)
        one = np.unique(two) & (SYMBOLS - 1)
        p1 = _lower_order(one, np.ones(len(one)), 1, np.zeros(0))
        p2 = _lower_order(two, np.ones(len(two)), 2, p1)
        p3 = _lower_order(three, np.ones(len(three)), 3, p2)
        d = _discount(n)
        context = c >> BITS
        total, kinds = np.bincount(context, n, SYMBOLS**3), np.bincount(context, minlength=SYMBOLS**3)
        weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        model.back[:, k], model.lower[:, k] = np.log(weight), np.log(p3)
        p4 = np.maximum(n - d, 0) / total[context] + weight[context] * p3[c & (SYMBOLS**3 - 1)]
        model.logs[np.searchsorted(model.keys, hashed(c)), k] = np.log(p4)
    return model


def language_counts(docs: DataFrame) -> DataFrame:
    """lang, code and n over all texts of docs(text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
            for name in sorted(set(langs.tolist())):
                mine = [texts[i] or "" for i in np.nonzero(langs == name)[0]]
                for a, b in _pieces(mine):
                    code, n = np.unique(codes(mine[a:b])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code, pa.int32()), pa.array(n, pa.int64())], ["lang", "code", "n"])

    return docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def identify(docs: DataFrame, folds: int = 5, held: int = 0, tail: float = 4.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy and rejected for every row of `docs`.

    Learns from text and lang of rows that are not held out (crc32 of the doc_id as text, modulo `folds`, is `held`).
    A text that is null or has no letter is `und` with score 0; so is every text if there is nothing to learn from.
    `rejected` marks texts whose entropy lies more than `tail` deviations above the mean of the training texts given to
    the same language, and their score is halved or worse. Ties go to the language first in order. A null doc_id counts
    as held out; null langs teach nothing; repeated rows are judged each; texts are read whole, however long; an empty
    table gives no rows; other columns are ignored. The model sent to the executors holds at most 2 ** 24 codes.
    """
    at = F.coalesce(F.expr(fold("doc_id", folds)) == held, F.lit(True))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), at.alias("held_out"), "text", F.col("lang").cast("string").alias("lang"))
    counts = language_counts(own.where("not held_out and lang is not null")).toArrow()
    model = train(np.array(counts.column("lang").to_pylist(), dtype=object), counts.column("code").to_numpy().astype(np.int64), counts.column("n").to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learned = sent.value
            h = learned.entropies([t or "" for t in batch.column("text").to_pylist()])
            none = np.isnan(h).any(axis=1) if learned.langs else np.ones(batch.num_rows, dtype=bool)
            if learned.langs:
                ranked = np.sort(np.where(none[:, None], 0, h), axis=1)
                best = np.where(none, -1, np.argmin(np.where(none[:, None], 0, h), axis=1))
                gap = ranked[:, 1] - ranked[:, 0] if len(learned.langs) > 1 else np.full(len(h), 1.0)
                low = ranked[:, 0]
            else:
                best, gap, low = (np.full(batch.num_rows, v) for v in (-1, 0.0, 0.0))
            names = [learned.langs[k] if k >= 0 else "und" for k in best]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("lang"), pa.array(names, pa.string()), pa.array(np.where(none, np.nan, low), pa.float64(), from_pandas=True), pa.array(np.where(none, 0.0, gap))], ["doc_id", "held_out", "lang", "lang_pred", "entropy", "gap"])

    judged, _ = materialise(own.mapInArrow(run, "doc_id long, held_out boolean, lang string, lang_pred string, entropy double, gap double"), "langid")
    fit = judged.where("not held_out and lang = lang_pred").groupBy("lang_pred").agg(F.avg("entropy").alias("mean"), F.greatest(F.coalesce(F.stddev("entropy"), F.lit(0.0)), F.lit(0.02)).alias("deviation"))
    far = (F.col("entropy") - F.col("mean")) / F.col("deviation")
    sure = 1 / (1 + F.exp(-40 * F.col("gap")))
    score = F.when(F.col("lang_pred") == "und", 0.0).otherwise(sure / (1 + F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.coalesce(far, F.lit(0.0)) - tail)))))
    return judged.join(fit, "lang_pred", "left").select("doc_id", "held_out", "lang_pred", score.alias("score"), "entropy", (F.coalesce(far > tail, F.lit(False))).alias("rejected"))


def op6_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
