"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; each visit fits a shallow tree to the logistic gradients gathered in that
feature's bins and adds its leaves to the feature's lookup table. Then the pairs with the largest gain on what is left
get two-way tables in the same way. A score is the sum of one table cell per feature and pair, looked up in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise

FEATURES = [
    "log_words", "word_len", "log_longest", "upper", "digit", "symbol", "exclaim", "bar", "sentence", "other_mark",
    "non_ascii", "distinct_words", "repeat_windows", "repeat_lines", "line_len", "entropy",
]


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.float64)
    out[list(chars.encode())] = 1
    return out


UPPER, DIGIT = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789")
SYMBOL, SENTENCE = _mask("#*$%&<>"), _mask(".,;:?")
MARKS = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)], dtype=np.float64)
HIGH = np.array([c >= 128 for c in range(256)], dtype=np.float64)


def features(text: bytes) -> list[float]:
    """Numbers that describe a text in UTF-8; every text, the empty one too, has all of them."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256).astype(np.float64)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    k, size = len(words), max(n, 1)
    share = counts[counts > 0] / size
    windows = max(k - 2, 0)
    symbol, sentence = counts @ SYMBOL, counts @ SENTENCE
    return [
        np.log1p(k), sum(map(len, words)) / max(k, 1), np.log1p(max(map(len, words), default=0)), counts @ UPPER / size,
        counts @ DIGIT / size, symbol / size, counts[33] / size, counts[124] / size, sentence / size,
        (counts @ MARKS - symbol - sentence - counts[33] - counts[124]) / size, counts @ HIGH / size,
        len(set(words)) / max(k, 1), 1 - len(set(zip(words, words[1:], words[2:]))) / max(windows, 1) if windows else 0.0,
        1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0, np.log1p(n / max(len(lines), 1)), float(-(share * np.log(share)).sum()),
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and the numbers that the model reads, from the whole text."""
    kind = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([features(t or b"") for t in batch.column(1).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, table.T)], ["doc_id", *FEATURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, kind)


@dataclass
class Additive:
    """Bin edges and lookup tables. An empty model scores its base rate."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables)):
            margin += table[np.searchsorted(edge, x[:, f], side="right")]
        for i, j, table in self.pairs:
            margin += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-margin))


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """A shallow tree over ordered bins: the value of each bin's leaf."""
    total_g, total_h = g.sum(), h.sum()
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
        gain[(left_h < least) | (right_h < least)] = -1
        at = int(gain.argmax())
        if gain[at] > 1e-9:
            return np.concatenate([_leaves(g[: at + 1], h[: at + 1], depth - 1, ridge, least), _leaves(g[at + 1 :], h[at + 1 :], depth - 1, ridge, least)])
    return np.full(len(g), total_g / (total_h + ridge))


def _boxes(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """A tree of two levels over a two-way table: the best cut of the rows, then one of the columns on either side."""
    best, out = -np.inf, np.full(g.shape, g.sum() / (h.sum() + ridge))
    for cut in range(1, len(g)):
        parts = [_leaves(g[s].sum(axis=0), h[s].sum(axis=0), 1, ridge, least) for s in (slice(cut), slice(cut, None))]
        gain = sum((g[s].sum(axis=0) * v).sum() for s, v in zip((slice(cut), slice(cut, None)), parts))
        if gain > best:
            best, out = gain, np.vstack([np.tile(parts[0], (cut, 1)), np.tile(parts[1], (len(g) - cut, 1))])
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, pairs: int = 5, bins: int = 64, coarse_bins: int = 12, rate: float = 0.15, depth: int = 2, ridge: float = 2.0, least: float = 2.0) -> Additive:
    """Fit on rows x (one column per feature) and labels y in {0, 1}. Without both labels: the base rate alone."""
    model = Additive()
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if len(set(y.tolist())) < 2:
        return model
    quantiles = lambda col, n: np.unique(np.quantile(col, np.linspace(0, 1, n + 1)[1:-1]))
    model.edges = [quantiles(c, bins) for c in x.T]
    model.coarse = [quantiles(c, coarse_bins) for c in x.T]
    at = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    rough = [np.searchsorted(e, c, side="right") for e, c in zip(model.coarse, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, own in enumerate(at):
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * _leaves(np.bincount(own, g, size), np.bincount(own, h, size), depth, ridge, least)
            model.tables[f] += step
            margin += step[own]
    g, h = slopes()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
            cell = rough[i] * shape[1] + rough[j]
            gg, hh = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))
            gains.append(((gg * _boxes(gg, hh, ridge, least)).sum(), i, j, cell, shape))
    chosen = sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:pairs]
    tables = [np.zeros(t[4]) for t in chosen]
    for _ in range(pair_rounds):
        for table, (_, _, _, cell, shape) in zip(tables, chosen):
            g, h = slopes()
            step = rate * _boxes(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), ridge, least)
            table += step
            margin += step.ravel()[cell]
    model.pairs = [(t[1], t[2], table) for t, table in zip(chosen, tables)]
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`.

    The model is fitted on at most `fit_rows` labelled rows (those first by a hash of their doc_id), never on a held-out
    one (crc32 of the doc_id as text, modulo 3, is 1); everything else covers all rows. A doc_id with several labels
    counts as good if half of them or more do; null labels and null doc_ids teach nothing. A null text is scored as
    empty, a row with null doc_id is scored as held out. Without labels of both kinds every row gets the base rate.
    Other columns are ignored; repeated rows are scored each; texts are read whole, however long; rows that tie at the
    bound of the sample are told apart by their features; an empty table gives no rows.
    """
    table, _ = materialise(with_features(docs), "quality")
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("__mark"))
    known = table.where(f"{fold('doc_id', 3)} <> 1").join(marks, "doc_id").dropDuplicates(["doc_id", *FEATURES])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(fit_rows).select("__mark", *FEATURES).toPandas()
    model = fit(sample[FEATURES].to_numpy(dtype=np.float64), sample["__mark"].to_numpy(dtype=np.float64)) if len(sample) else Additive()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = model.score(batch[FEATURES].to_numpy(dtype=np.float64))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"].astype(bool), "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    held = F.coalesce(F.expr(f"{fold('doc_id', 3)} = 1"), F.lit(True)).alias("held_out")
    return table.select("doc_id", held, *FEATURES).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier takes for good, with all columns, whatever their names.

    Nulls, empty and very long texts and repeated rows are scored as in `quality_scores`; of repeated rows of one doc_id
    none stays if one of them is bad. A row without doc_id stays. An empty table gives no rows.
    """
    bad = quality_scores(docs, labels).where("predicted = 0").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
