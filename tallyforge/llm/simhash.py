"""SimHash near-duplicates found by vantage-point trees.

Two fingerprints that differ in 3 bits or fewer agree, but for 1 bit or none, on one of their two 32-bit halves. Each
half has its own vantage-point tree: a node holds a vantage point v and a radius mu, fingerprints within mu of v go
left, all others right, and those at mu + 1 go left as well. By the triangle bound no pair within 1 bit is parted: if
one end is within mu and the other is not, the other stands at mu + 1 exactly, so the left shard has both. A tree over
all 64 bits with radius 3 would send 1.5 times as many rows on at every level; a half sends 1.14 times as many.

The upper levels, built on a bounded sample, cut the fingerprints into shards; within a shard the same rule goes on in
memory, and the leaves are searched exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .graph import connected_components

SEED = 42
CHUNK = 1 << 16


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each word shingle of a text in UTF-8, in order; none if it has no word."""
    tokens = text.lower().split()  # bytes: A-Z only, and white space is the space and 9 to 13
    if not tokens:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    first, last = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(first, last)), dtype="<u8", count=len(first))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of a text in UTF-8: majority bits of the XXH64 of its word shingles; 0 if it has no word."""
    return majority(shingle_hashes(text, words))


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t or b"", words) for t in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Tree:
    """One half's vantage-point tree: node i has children 2i+1 and 2i+2; a leaf has no vantage point."""

    def __init__(self, shift: int, depth: int, sample: np.ndarray) -> None:
        self.shift, self.nodes = shift, {}
        self._grow(0, self.half(sample), depth)

    def half(self, prints: np.ndarray) -> np.ndarray:
        return (prints >> np.uint64(self.shift)).astype(np.uint32)

    def _grow(self, node: int, part: np.ndarray, depth: int) -> None:
        cut = best_cut(part) if depth else None
        if cut is None:
            return
        self.nodes[node] = cut
        left, right = parted(part, *cut)
        self._grow(2 * node + 1, part[left], depth - 1)
        self._grow(2 * node + 2, part[right], depth - 1)

    def shards(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each copy of a fingerprint, and its index."""
        leaves, rows = [], []
        todo = [(0, np.arange(len(prints)))]
        half = self.half(prints)
        while todo:
            node, at = todo.pop()
            if node not in self.nodes:
                leaves.append(np.full(len(at), node))
                rows.append(at)
                continue
            left, right = parted(half[at], *self.nodes[node])
            todo += [(2 * node + 1, at[left]), (2 * node + 2, at[right])]
        return np.concatenate(leaves), np.concatenate(rows)


def parted(part: np.ndarray, vantage: int, mu: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.bitwise_count(part ^ np.uint32(vantage))
    return d <= mu + 1, d > mu


def best_cut(part: np.ndarray, tries: int = 8) -> tuple[int, int] | None:
    """Vantage point and radius that send the fewest rows both ways; None if none parts the rows well."""
    best, found = 1.35, None
    if len(part) < 16:
        return None
    for v in part[:: max(1, len(part) // tries)][:tries]:
        share = np.bincount(np.bitwise_count(part ^ v), minlength=34) / len(part)
        below = np.cumsum(share)
        for mu in range(32):
            left, right = below[mu + 1], 1 - below[mu]
            if max(left, right) < 0.75 and (cost := left + right + 0.3 * abs(left - right)) < best:
                best, found = cost, (int(v), mu)
    return found


def chained(prints: np.ndarray, reps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join all of a leaf's fingerprints within `bits` of each other, a tree of them per component."""
    links = []
    while len(prints):
        root, front, prints, reps = reps[0], [prints[0]], prints[1:], reps[1:]
        while front and len(prints):
            near = np.bitwise_count(prints ^ front.pop()) <= bits
            if near.any():
                links += [(root, r) for r in reps[near].tolist()]
                front += list(prints[near])
                prints, reps = prints[~near], reps[~near]
    return links


def shard_links(prints: np.ndarray, reps: np.ndarray, shift: int, bits: int, leaf: int = 512) -> list[tuple[int, int]]:
    links, todo = [], [(prints, reps)]
    while todo:
        p, r = todo.pop()
        half = (p >> np.uint64(shift)).astype(np.uint32)
        cut = best_cut(half) if len(p) > leaf else None
        if cut is None:
            links += chained(p, r, bits)
        else:
            todo += [(p[side], r[side]) for side in parted(half, *cut)]
    return links


def near_links(prints: DataFrame, bits: int = 3, shard_rows: int = 4096, sample_rows: int = 1 << 20) -> DataFrame:
    """Links src, dst among the distinct fingerprints of `prints` (fp, rep), enough to join each component.

    The trees are shaped by a sample, chosen by hash: 16,384 fingerprints or one in 4,096, `sample_rows` at most (8 MB on
    the driver). They part the rows into up to a sixteenth as many shards, so shards grow only beyond four billion
    fingerprints. Every fingerprint is dealt and searched.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the halves' trees are exact up to 3 bits")
    n, parts = prints.count(), 1 << 30
    wanted = min(sample_rows, max(1 << 14, n >> 12))
    some = prints if n <= wanted else prints.where(f"pmod(xxhash64(fp), {parts}) < {max(1, wanted * parts // n)}")
    sample = np.sort(some.select("fp").toPandas()["fp"].to_numpy(dtype=np.int64)).view(np.uint64)
    sample = np.random.default_rng(9).permutation(sample)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard_rows))))
    depth = min(depth, max(0, int(np.log2(max(1, len(sample)) / 16))))
    trees = [Tree(shift, depth, sample) for shift in (0, 32)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for k, tree in enumerate(trees):
                leaves, rows = tree.shards(fp.view(np.uint64))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(leaves * 2 + k), batch.column(0).take(at), batch.column(1).take(at)], ["shard", "fp", "rep"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        found = shard_links(fp, pdf["rep"].to_numpy(dtype=np.int64), 32 * int(pdf["shard"].iloc[0] % 2), bits)
        return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    return prints.select("fp", "rep").mapInArrow(deal, "shard long, fp long, rep long").groupBy("shard").applyInPandas(link, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fp (signed long) and component_id: the smallest doc_id reachable by links of `bits` bits or fewer.

    Nulls: a null text counts as empty; a row without doc_id is never the name of a component (alone, it has none).
    Empty texts share fingerprint zero and link like any other. Repeated rows share a fingerprint and a component. An
    empty table gives no rows. Texts are read whole, however long. Other columns of `docs` are ignored. Equal fingerprints are joined by a group-by, so a
    group of copies counts once in the trees, whatever its size.
    """
    prints, _ = materialise(with_fingerprints(docs, words), "simhash")
    distinct, _ = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "simhash-reps")
    parts = connected_components(near_links(distinct, bits))
    named = distinct.join(parts, distinct["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """The rows of `docs` that name their group: one of each group of near copies, with all columns.

    A row without doc_id stays. Repeated rows of one doc_id all stay if that doc_id does. Nulls, empty and very long
    texts as in `near_duplicates`; an empty table gives no rows; other columns stay, whatever their names.
    """
    return without(docs, near_duplicates(docs, words, bits))


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id names its component in `found` (doc_id, component_id)."""
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
