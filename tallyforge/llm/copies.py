"""Near copies by their sets of word shingles: every pair whose Jaccard similarity reaches a bar, and no other.

First come the pairs that the vantage-point trees of `simhash` find, on fingerprints of the same shingles. Two texts at
0.8 have fingerprints that differ in 10 of 64 bits on average and in 20 at times; at that radius a tree parts nothing. So
the other candidates come from prefixes: with all shingles in one order, two sets at similarity t share one of the first
n - ceil(t n) + 1 of each. The order puts rare shingles first, so that a line or a passage that many texts have makes no
candidates; which shingles are frequent is estimated on a sample, and what the sample misses costs time, not pairs. Each
candidate, from either source, is verified on the whole sets.

Of a group that shares a prefix shingle, all are compared with one first, and what those links join is one component. Rows
of different components are then held against each other by parity maps: bit h mod b of a set is the parity of its
shingles there, so the bits in which two maps differ are at most the shingles that one set alone has. That bound loses
no pair, and only pairs that pass it leave the task: once as many as join what all would join, then, of the components
that these leave apart, all. A group is dealt out in blocks, so no task holds all of a large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove
from .graph import connected_components
from .simhash import majority, near_links, shingle_hashes

#: Similarity as a fraction, so that the bar is exact.
LEAST = (4, 5)
BLOCK = 256
MOST_BITS = 8192


def prefix_length(n: int, least: tuple[int, int] = LEAST) -> int:
    return n - -(-n * least[0] // least[1]) + 1 if n else 0


def signature(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: what a worker holds at a time is bounded by these, not by the reader's."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_bits(n: int) -> int:
    """Bits of the parity map of a set of n: eight to sixteen for each shingle, so that few of them share a bit."""
    return min(MOST_BITS, max(64, 1 << max(0, 8 * n - 1).bit_length()))


def parity_map(own: np.ndarray) -> bytes:
    bits = map_bits(len(own))
    odd = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Maps (rows of 64-bit words) as they would be with fewer bits."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def similar(a: bytes, b: bytes, least: tuple[int, int] = LEAST) -> bool:
    """Whether two sorted sets, as bytes, reach the bar."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return least[1] * shared >= least[0] * (len(x) + len(y) - shared)


def frequent(rows: DataFrame, n: int, words: int, sample_rows: int = 8192, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three or more texts of a sample have, sorted, and in how many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [np.unique(shingle_hashes(t or b"", words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], ["h"])

    parts = 1 << 20
    share = min(parts, -(-sample_rows * parts // max(1, n)))
    some = rows.where(f"pmod(xxhash64(doc_id), {parts}) < {share}")
    top = some.mapInArrow(run, "h long").groupBy("h").count().where("count >= 3").orderBy(F.desc("count"), "h").limit(most).toPandas()
    h, count = top["h"].to_numpy(dtype=np.int64).view(np.uint64), top["count"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], count[order]


def prefix(own: np.ndarray, known: np.ndarray, counts: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The first shingles of a set, rare ones first."""
    size = prefix_length(len(own), least)
    if len(known) and len(own):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        own = own[np.lexsort((own, np.where(known[at] == own, counts[at], 0)))]
    return own[:size]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, cut anew so that no key is in two of them."""
    left: list[pa.RecordBatch] = []
    join = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        start = int(np.searchsorted(key, key[-1]))
        if start or left and left[-1].column(0)[0].as_py() != key[0]:
            if left or start:
                yield join([*left, *([batch.slice(0, start)] if start else [])])
            left = []
        left.append(batch.slice(start))
    if left:
        yield join(left)


def _bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
    return starts, np.diff(np.append(starts, len(key)))


def _shared(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows whose key another row has, with the first row of their key, or themselves where the two can't reach the bar.

    Rows come in order of their keys. Only the first row of a key is held, until a second one shows that it has company.
    """
    held, lone = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*([held] if held is not None and batch.column("key")[0] == held.column("key")[0] else []), batch]).combine_chunks().to_batches()[0]
        again = table.num_rows > batch.num_rows
        key, sig, n, pos = (table.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sig", "n", "pos"))
        starts, sizes = _bounds(key)
        own = np.repeat(sizes > 1, sizes)
        if again and not lone:
            own[0] = False  # sent on before
        first = np.repeat(starts, sizes)
        n, rest = n.astype(np.int64), (n - pos).astype(np.int64)
        fits = (least[0] + least[1]) * np.minimum(rest, rest[first]) >= least[0] * (n + n[first])
        root = np.where(fits, sig[first], sig)
        held = table.slice(int(starts[-1]), 1)
        lone = bool(sizes[-1] == 1)
        yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(own)) for c in table.columns), pa.array(root[own])], ["key", "sig", "n", "pos", "root"])


def _spanning(x: np.ndarray, y: np.ndarray, parent: list[int]) -> list[int]:
    """Which of the pairs of components join two that earlier ones have not joined yet."""

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
            kept.append(k)
    return kept


def _apart(least: tuple[int, int], spanning: bool):
    """Pairs of one group, in different components, that can still reach the bar by the places before their shared
    shingle and by their parity maps. Where `cross` is set, only rows of different blocks are compared. With `spanning`
    only as many as join what all of them would join, the likeliest first in each block."""
    over, of = least[0], least[0] + least[1]

    def pairs(a: tuple, b: tuple, cross: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the two sides, and by how many shingles the bound exceeds the bar."""
        (n_a, rest_a, part_a, block_a, map_a), (n_b, rest_b, part_b, block_b, map_b) = a, b
        fits = (part_a[:, None] != part_b[None, :]) & (of * np.minimum(rest_a[:, None], rest_b[None, :]) >= over * (n_a[:, None] + n_b[None, :]))
        if cross:
            fits &= block_a[:, None] != block_b[None, :]
        x, y = np.nonzero(fits)
        spare = np.empty(len(x), dtype=np.int64)
        for i in range(0, len(x), 8192):
            c, d = x[i : i + 8192], y[i : i + 8192]
            differing = np.bitwise_count(map_a[c] ^ map_b[d]).sum(axis=1, dtype=np.int64)
            spare[i : i + 8192] = of * ((n_a[c] + n_b[d] - differing) // 2) - over * (n_a[c] + n_b[d])
        own = spare >= 0
        return x[own], y[own], spare[own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            key, sig, n, pos, part, block, cross = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sig", "n", "pos", "part", "block", "cross"))
            n, rest, maps = n.astype(np.int64), (n - pos).astype(np.int64), batch.column("map")
            for start, size in zip(*_bounds(key)):
                if (part[start : start + size] == part[start]).all():
                    continue
                own = np.arange(start, start + size)
                raw = maps.slice(start, size).to_pylist()
                width = np.array([len(m) // 8 for m in raw])
                labels, label = np.unique(part[own], return_inverse=True)
                parent = list(range(len(labels)))
                # two sets that reach the bar have maps of equal width or twice that
                for small in np.unique(width):
                    sides = []
                    for w in (small, 2 * small):
                        at = np.nonzero(width == w)[0]
                        table = np.frombuffer(b"".join(raw[i] for i in at), dtype=np.uint64).reshape(len(at), w)
                        rows = own[at]
                        sides.append((rows, label[at], (n[rows], rest[rows], part[rows], block[rows], folded(table, small) if len(at) else table.reshape(0, small))))
                    (rows, left, columns), _ = sides
                    for k, (others, right, more) in enumerate(sides):
                        for i in range(0, len(rows), BLOCK):
                            for j in range(0 if k else i, len(others), BLOCK):
                                x, y, spare = pairs(tuple(c[i : i + BLOCK] for c in columns), tuple(c[j : j + BLOCK] for c in more), bool(cross[start]))
                                if spanning and len(x):
                                    order = np.argsort(-spare, kind="stable")
                                    x, y = x[order], y[order]
                                    kept = _spanning(left[i + x], right[j + y], parent)
                                    x, y = x[kept], y[kept]
                                if len(x):
                                    x, y = sig[rows[i + x]], sig[others[j + y]]
                                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["src", "dst"])

    return run


def reachable(a: np.ndarray, b: np.ndarray, n: int, m: int, least: tuple[int, int] = LEAST) -> bool:
    """Whether sets of n and m shingles can reach the bar, given their prefixes.

    Up to the end of the prefix that ends first, what the sets share is what the prefixes share; beyond it lies at most
    the rest of that set.
    """
    shared = len(np.intersect1d(a, b, assume_unique=True)) + max(n - len(a), m - len(b))
    return (least[0] + least[1]) * shared >= least[0] * (n + m)


def _hopeful(pairs: DataFrame, single: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs src, dst that their prefixes don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            flat = []
            for name in ("a", "b"):
                column = batch.column(name)
                values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x) for x in column)])
                flat.append([values[i:j] for i, j in zip(ends[:-1], ends[1:])])
            own = [reachable(a, b, n, m, least) for a, b, n, m in zip(*flat, batch.column("na").to_pylist(), batch.column("nb").to_pylist())]
            yield batch.select(["src", "dst"]).filter(pa.array(own, pa.bool_()))

    a, b = (single.select(F.col("sig").alias(end), F.col("keys").alias(name), F.col("n").alias(f"n{name}")) for end, name in (("src", "a"), ("dst", "b")))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b", "na", "nb").mapInArrow(run, "src long, dst long")


def _verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs src, dst whose sets reach the bar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [similar(a, b, least) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield batch.select(["src", "dst"]).filter(pa.array(own, pa.bool_()))

    a, b = (sets.select(F.col("sig").alias(end), F.col("shingles").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def near_copies(docs: DataFrame, words: int = 5, least: tuple[int, int] = LEAST, block_rows: int = 4096) -> DataFrame:
    """doc_id and component_id: the smallest doc_id reachable by links of similarity `least` or more.

    Texts of fewer than `words` words are one shingle; a null text counts as empty, and empty texts are copies of each
    other. A row without doc_id never names a component (alone, it has none). Repeated rows share a component. An empty
    table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(frequent(rows, rows.count(), words))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            every = [shingle_hashes(t or b"", words) for t in batch.column(1).to_pylist()]
            own = [np.unique(s) for s in every]
            fp = np.fromiter(map(majority, every), dtype=np.uint64, count=len(every)).view(np.int64)
            keys = [prefix(s, *sent.value, least).view(np.int64) for s in own]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signature(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int32()), lists, pa.array([parity_map(s) for s in own], pa.binary()), pa.array(fp)], ["doc_id", "sig", "n", "keys", "map", "fp"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [np.unique(shingle_hashes(t or b"", words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["sig", "shingles"])

    prints, whole_prints = materialise(rows.mapInArrow(first, "doc_id long, sig long, n int, keys array<long>, map binary, fp long"), "copies")
    reps, _ = materialise(prints.groupBy("sig").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "copies-reps")
    # one row of each set stands for its copies
    single, _ = materialise(prints.join(reps, (prints["sig"] == reps["sig"]) & (prints["doc_id"] == reps["rep"]), "left_semi").dropDuplicates(["sig", "doc_id"]), "copies-single")
    # beyond this only the names of the sets are asked of each document
    prints, _ = materialise(prints.select("doc_id", "sig"), "copies-names")
    remove(docs.sparkSession, whole_prints)

    def linked(pairs: DataFrame) -> DataFrame:
        likely, _ = materialise(_hopeful(pairs, single, least), "copies-likely")
        # a table, so that its size is known: a short list of documents goes to the texts, not the texts to it
        wanted, _ = materialise(likely.select(F.col("src").alias("sig")).union(likely.select("dst")).distinct().join(reps, "sig").select(F.col("rep").alias("doc_id")).distinct(), "copies-wanted")
        sets = rows.join(wanted, "doc_id", "left_semi").mapInArrow(whole, "sig long, shingles binary").dropDuplicates(["sig"])
        sets, path = materialise(sets, "copies-sets")
        links, _ = materialise(_verified(likely, sets, least), "copies-links")
        remove(docs.sparkSession, path)
        return links

    dealt = single.select("sig", "n", F.posexplode("keys").alias("pos", "key")).select("key", "sig", "n", "pos").repartition("key").sortWithinPartitions("key", "sig")
    shared, _ = materialise(dealt.mapInArrow(lambda batches: _shared(batches, least), "key long, sig long, n int, pos int, root long"), "copies-shared")
    # sets of equal fingerprints have one of them in common, those of near ones come from the trees
    alike, _ = materialise(single.groupBy("fp").agg(F.min("sig").alias("rep")), "copies-prints")
    near = near_links(alike).union(single.join(alike, "fp").select("sig", "rep")).toDF("a", "b")
    near = near.union(shared.select("sig", "root")).where("a <> b")
    tried, _ = materialise(near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "copies-tried")
    links = linked(tried)
    parts, _ = materialise(connected_components(links), "copies-parts")

    def apart(parts: DataFrame, spanning: bool) -> DataFrame:
        placed = shared.join(parts, shared["sig"] == parts["node"], "left").select("key", "sig", "n", "pos", F.coalesce("component", "sig").alias("part"))
        many = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).where("low <> high").select("key", "blocks")
        mixed = placed.join(many, "key").join(single.select("sig", "map"), "sig").withColumn("block", F.expr("cast(pmod(sig, blocks) as int)"))
        mixed = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        mixed = mixed.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).alias("key"), "sig", "n", "pos", "part", "block", (F.col("block") != F.col("other")).alias("cross"), "map")
        dealt = mixed.repartition("key").sortWithinPartitions("key", "sig")
        return materialise(dealt.mapInArrow(_apart(least, spanning), "src long, dst long").distinct().join(tried, ["src", "dst"], "left_anti"), "copies-apart")[0]

    # a spanning set first: what it joins leaves few pairs for the second pass, which leaves none out
    for spanning in (True, False):
        links = links.union(linked(apart(parts, spanning)))
        parts, _ = materialise(connected_components(links), "copies-parts")
    named = reps.join(parts, reps["sig"] == parts["node"], "left").select("sig", "rep", F.coalesce("component", "sig").alias("part"))
    names = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    return prints.select("doc_id", "sig").join(named.join(names, "part").select("sig", "component_id"), "sig", "left").select("doc_id", "component_id")
