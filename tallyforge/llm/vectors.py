"""Embedding near-duplicates by a flat graph with robust pruning.

A bounded sample gives cluster centres; each vector goes to the cluster of its nearest centre and to those whose border
lies so near that a vector within range may stand beyond it, as far as `cells` allows. Every cluster builds a graph of its own: near neighbours thinned by the robust rule (a neighbour is dropped
if one kept already is nearer to it by a factor alpha). The adjacency lists of a vector are united over its clusters.
A search starts at a cluster's medoids and at the vector's own list, goes greedily on with a beam, and then expands
through everything within range. What it finds is verified in double precision.

The recall of a set of vectors is measured against all rows, as the mean over vectors that have links, those with few
links apart, so that a dense group does not hide what sparse pairs lose. With too low a recall the search runs again
with more clusters for each vector and a wider beam, and failing that every block is compared with every other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .graph import connected_components


def units(lists: list) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = np.array(lists, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres(x: np.ndarray, k: int, steps: int = 6, apart: float = 0.9) -> np.ndarray:
    """Directions of k clusters of the sample; centres closer than `apart` become one, so a dense group is not cut up."""
    own = x[np.random.default_rng(1).permutation(len(x))[:k]]
    for _ in range(steps):
        near = np.argmax(x @ own.T, axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        own = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), own)
    kept: list[int] = []
    for i in range(len(own)):
        if not kept or (own[kept] @ own[i]).max() < apart:
            kept.append(i)
    return own[kept]


def robust_lists(x: np.ndarray, degree: int, pool: int, alpha: float, spare: int = 6) -> np.ndarray:
    """Out-neighbours of each row, -1 where there are fewer.

    `spare` more are drawn from the whole pool: in a dense group the thinned list holds the nearest rows alone, and parts
    of the group that lie apart would not be joined.
    """
    n = len(x)
    pool = min(pool, n - 1)
    out = np.full((n, degree + spare), -1, dtype=np.int32)
    if pool <= 0:
        return out
    draw = np.random.default_rng(2)
    y = x.astype(np.float32)
    for a in range(0, n, 512):
        rows = np.arange(a, min(n, a + 512))
        sims = y[rows] @ y.T
        sims[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        own = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-own, axis=1)
        near, far = np.take_along_axis(near, order, axis=1), 1 - np.take_along_axis(own, order, axis=1)
        alive = np.ones(near.shape, dtype=bool)
        line = np.arange(len(rows))
        for r in range(degree):
            live = alive.any(axis=1)
            if not live.any():
                break
            at = alive.argmax(axis=1)
            pick = near[line, at]
            out[rows[live], r] = pick[live]
            alive[line, at] = False
            between = 1 - np.einsum("rpd,rd->rp", y[near], y[pick])
            alive &= alpha * between > far
        out[rows[:, None], np.arange(degree, degree + spare)] = np.take_along_axis(near, draw.integers(0, pool, (len(rows), spare)), axis=1)
    return out


def with_reverse(lists: np.ndarray, x: np.ndarray, degree: int) -> list[np.ndarray]:
    """Each list with the rows that name it, the nearest `degree` of those."""
    n = len(lists)
    src = np.repeat(np.arange(n), lists.shape[1])
    dst = lists.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    sims = np.einsum("ij,ij->i", x[src], x[dst]) if len(src) else np.zeros(0)
    order = np.lexsort((-sims, dst))
    back_to, back_from = dst[order], src[order]
    starts = np.searchsorted(back_to, np.arange(n + 1))
    return [np.union1d(lists[i][lists[i] >= 0], back_from[starts[i] : min(starts[i + 1], starts[i] + degree)]) for i in range(n)]


def medoids(x: np.ndarray, k: int = 8) -> np.ndarray:
    """The row nearest the mean, then rows far from those chosen."""
    mean = x.mean(axis=0)
    out = [int(np.argmax(x @ mean))]
    near = x @ x[out[0]]
    while len(out) < min(k, len(x)):
        out.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[out[-1]])
    return np.array(out)


def search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, least: float, beam: int) -> np.ndarray:
    """hits[i, j]: row j was met from row i and is within range, by greedy beams from `starts` and range expansion."""
    n = len(x)
    y = x.astype(np.float32)
    hits = np.zeros((n, n), dtype=bool)
    for a in range(0, n, 256):
        rows = np.arange(a, min(n, a + 256))
        b = len(rows)
        seen = np.zeros((b, n), dtype=bool)
        seen[np.arange(b), rows] = True
        own = hits[rows]
        ids, sims, done = np.full((b, beam), -1), np.full((b, beam), -2, dtype=np.float32), np.ones((b, beam), dtype=bool)

        def meet(line: np.ndarray, met: np.ndarray) -> None:
            """Rows `met` (one list per line, -1 for none) are looked at from `line`."""
            nonlocal ids, sims, done
            fresh = (met >= 0) & ~seen[line[:, None], met]
            seen[np.repeat(line, met.shape[1])[fresh.ravel()], met[fresh]] = True
            value = np.where(fresh, np.einsum("ld,lmd->lm", y[rows[line]], y[met]), -2)
            close = fresh & (value >= least - 1e-5)
            own[np.repeat(line, met.shape[1])[close.ravel()], met[close]] = True
            all_ids, all_sims = np.hstack((ids[line], met)), np.hstack((sims[line], value))
            all_done = np.hstack((done[line], ~fresh))
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[line], sims[line], done[line] = (np.take_along_axis(t, top, axis=1) for t in (all_ids, all_sims, all_done))

        line = np.arange(b)
        meet(line, np.tile(starts, (b, 1)))
        meet(line, graph[rows])
        while True:
            open_sims = np.where(done, -3, sims)
            at = open_sims.argmax(axis=1)
            line = np.nonzero(open_sims[np.arange(b), at] > -2)[0]
            if not len(line):
                break
            node = ids[line, at[line]]
            done[line, at[line]] = True
            meet(line, graph[node])
        front_line, front = np.nonzero(own)
        while len(front):
            step_line, step = [], []
            for c in range(0, len(front), 20000):
                met = graph[front[c : c + 20000]]
                line = np.repeat(front_line[c : c + 20000], met.shape[1])
                met = met.ravel()
                fresh = (met >= 0) & ~seen[line, met]
                line, met = line[fresh], met[fresh]
                key = np.unique(line.astype(np.int64) * n + met)
                line, met = key // n, key % n
                seen[line, met] = True
                close = np.einsum("ij,ij->i", y[rows[line]], y[met]) >= least - 1e-5
                own[line[close], met[close]] = True
                step_line.append(line[close]), step.append(met[close])
            front_line, front = np.concatenate(step_line), np.concatenate(step)
        hits[rows] = own
    return hits


def _padded(lists: list[np.ndarray]) -> np.ndarray:
    width = max(1, max(map(len, lists), default=1))
    out = np.full((len(lists), width), -1, dtype=np.int64)
    for i, own in enumerate(lists):
        out[i, : len(own)] = own
    return out



def _links_once(reps: DataFrame, least: float, cells: int, cell_rows: int, block_rows: int, sample_rows: int, degree: int, beam: int, alpha: float) -> DataFrame:
    """rep, links (weighted by copies) and root (smallest rep met) for each cluster that a vector belongs to.

    With `cells` = 0 all vectors are one cluster and its blocks are compared without a graph: exact, at quadratic cost.
    """
    spark = reps.sparkSession
    sizes = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sample = reps.orderBy(F.xxhash64("vector"), "vector").limit(sample_rows).select("dim", "vector").toArrow()
    by_dim = np.array(sample.column("dim").to_pylist())
    lists = sample.column("vector").to_pylist()
    own = {}
    for dim, n in sizes.items():
        mine = [lists[i] for i in np.nonzero(by_dim == dim)[0]]
        own[dim] = centres(units(mine), max(1, min(-(-n // cell_rows), len(mine) // 4))) if mine and cells else np.zeros((1, dim))
    sent = spark.sparkContext.broadcast(own)  # at most sample_rows / 4 centres
    reach = float(np.sqrt(2 - 2 * least)) + 1e-9

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                part = batch.take(pa.array(at))
                x = units(part.column("vector").to_pylist())
                middle = sent.value[int(dim)]
                k = max(1, min(cells, len(middle)))
                sims = x @ middle.T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :k].astype(np.int32)
                # beyond the border with a centre: no vector within range of x can be nearer to it
                ahead = np.take_along_axis(sims, near[:, :1], axis=1) - np.take_along_axis(sims, near, axis=1)
                apart = np.linalg.norm(middle[near[:, :1]] - middle[near], axis=2)
                near = np.sort(np.where(ahead <= reach * apart, near, -1), axis=1)
                flat, line = near.ravel(), np.repeat(np.arange(len(at)), k)
                everywhere = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * k + 1, k), pa.int32()), pa.array(flat, pa.int32()))
                rows, flat = pa.array(line[flat >= 0]), pa.array(flat[flat >= 0], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("dim").take(rows), flat, part.column("rep").take(rows), part.column("n").take(rows), part.column("vector").take(rows), everywhere.take(rows)], ["dim", "cell", "rep", "n", "vector", "cells"])

    dealt, _ = materialise(reps.select("dim", "rep", "n", "vector").mapInArrow(deal, "dim int, cell int, rep long, n long, vector array<double>, cells array<int>"), "vec-cells")
    # a cluster beyond block_rows is cut into blocks by hash, and every pair of blocks is a shard
    blocks = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    member = dealt.join(blocks, ["dim", "cell"]).withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    member = member.select("*", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = units(pdf["vector"].tolist())
        reps = pdf["rep"].to_numpy()
        lists = with_reverse(robust_lists(x, degree, 10 * degree, alpha), x, degree)
        return pd.DataFrame({"rep": reps, "list": [reps[own] for own in lists]})

    key = ["dim", "cell", "low", "high"]
    if cells:
        built = member.select(*key, "rep", "vector").groupBy(*key).applyInPandas(build, "rep long, list array<long>")
        united = built.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("list"))
        ready = member.join(united, "rep")
    else:
        ready = member.withColumn("list", F.array().cast("array<bigint>"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep").reset_index(drop=True)
        x, reps, often, block = units(pdf["vector"].tolist()), pdf["rep"].to_numpy(), pdf["n"].to_numpy(), pdf["block"].to_numpy()
        if cells:
            lists = []
            for own in pdf["list"]:
                at = np.searchsorted(reps, own)
                at[at == len(reps)] = 0
                lists.append(at[reps[at] == own])
            hits = search(x, _padded(lists), medoids(x), least, beam)
            hits |= hits.T
        else:
            y = x.astype(np.float32)
            hits = np.concatenate([y[i : i + 512] @ y.T >= least - 1e-5 for i in range(0, len(y), 512)])
        a, b = np.nonzero(np.triu(hits, 1))
        true = np.concatenate([(x[a[c : c + 100000]] * x[b[c : c + 100000]]).sum(axis=1) >= least for c in range(0, len(a), 100000)]) if len(a) else np.zeros(0, dtype=bool)
        a, b = a[true], b[true]
        # a pair counts in the first cluster that both belong to, and there in the shard of their two blocks
        cell, low, high = (int(pdf[c].iloc[0]) for c in ("cell", "low", "high"))
        own_cells = np.array(pdf["cells"].tolist())
        shared = np.full(len(a), np.iinfo(np.int32).max)
        for i in range(own_cells.shape[1]):
            for j in range(own_cells.shape[1]):
                same = (own_cells[a, i] == own_cells[b, j]) & (own_cells[a, i] >= 0)
                shared[same] = np.minimum(shared[same], own_cells[a, i][same])
        counts = (shared == cell) & (np.minimum(block[a], block[b]) == low) & (np.maximum(block[a], block[b]) == high)
        links = np.bincount(a[counts], often[b[counts]], len(reps)) + np.bincount(b[counts], often[a[counts]], len(reps))
        root = np.arange(len(reps))
        while True:  # smallest row of each component
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"rep": reps, "links": links.astype(np.int64), "root": reps[root]})

    return ready.select(*key, "block", "rep", "n", "vector", "cells", "list").groupBy(*key).applyInPandas(find, "rep long, links long, root long")


def recall(reps: DataFrame, found: DataFrame, least: float, queries: int = 2048, few: int = 8) -> float | None:
    """Share of its links that a vector has on average, over `queries` vectors (first by hash) and a quarter as many of
    those with links; the lesser of the means over all and over vectors with up to `few` links. None without any link.
    """
    known = reps.join(found, "rep", "left").select("dim", "rep", "vector", F.coalesce("links", F.lit(0)).alias("links"))
    order = [F.xxhash64("vector", F.lit(9)), "vector"]
    asked = known.orderBy(*order).limit(queries).union(known.where("links > 0").orderBy(*order).limit(queries // 4)).dropDuplicates(["rep"])
    rows = asked.collect()
    sent = reps.sparkSession.sparkContext.broadcast([(r["dim"], r["rep"], r["vector"]) for r in rows])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        sides: dict[int, tuple[list[int], np.ndarray]] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if dim not in sides:
                    mine = [q for q in sent.value if q[0] == dim]
                    sides[dim] = [q[1] for q in mine], units([q[2] for q in mine]) if mine else np.zeros((0, dim))
                names, x = sides[dim]
                whole = batch.take(pa.array(np.nonzero(dims == dim)[0]))
                for start in range(0, whole.num_rows, 2048):
                    part = whole.slice(start, 2048)
                    close = x @ units(part.column("vector").to_pylist()).T >= least
                    often, other = part.column("n").to_numpy(), part.column("rep").to_numpy()
                    for i in np.nonzero(close.any(axis=1))[0]:
                        total[names[i]] = total.get(names[i], 0) + int(often[close[i] & (other != names[i])].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["rep", "true"])

    true = {r["rep"]: r["t"] for r in reps.select("dim", "rep", "n", "vector").mapInArrow(count, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("t")).collect()}
    shares = [(min(1.0, r["links"] / true[r["rep"]]), true[r["rep"]]) for r in rows if true.get(r["rep"], 0)]
    if not shares:
        return None
    sparse = [s for s, n in shares if n <= few]
    return float(min(np.mean([s for s, _ in shares]), np.mean(sparse) if sparse else 1.0))


def near_duplicates(table: DataFrame, least: float = 0.95, cell_rows: int = 1500, block_rows: int = 6000, sample_rows: int = 16384, degree: int = 20, alpha: float = 1.2) -> DataFrame:
    """vec_id, n_links, component_id, kept and audit_recall for every row of table(vec_id, embedding).

    Links join vectors of cosine `least` or more, in double precision. Vectors that are null, empty or zero, or that
    hold null or non-finite components, link with nothing, nor do vectors of different lengths. Equal vectors count as
    links of each other and are searched for once, whatever their number; a repeated row is another copy. Rows of one
    vec_id with different vectors are vectors of their own, linked only if they are near. A row with
    null vec_id links with nothing. An empty table gives no rows; other columns are ignored. `sample_rows` bounds the
    vectors that shape the clusters; all vectors are indexed and searched for. audit_recall is null if none of the
    vectors asked has a link. Below 0.99 the search goes wider, at last to all blocks: what is returned then is exact.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("ok", F.coalesce(~bad & F.col("vec_id").isNotNull(), F.lit(False)))
    reps = rows.where("ok").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("dim", F.size("vector"))
    # a vec_id may stand for several vectors, so each has a number of its own, fixed by the table that is written
    reps = reps.sortWithinPartitions("id", "vector").withColumn("rep", F.monotonically_increasing_id())
    reps, _ = materialise(reps, "vec-reps")
    for cells, beam in ((4, 16), (8, 64), (0, 0)):
        parts, _ = materialise(_links_once(reps, least, cells, cell_rows, block_rows, sample_rows, degree, beam, alpha), "vec-links")
        links = parts.groupBy("rep").agg(F.sum("links").alias("links"))
        share = recall(reps, links, least)
        if share is None or share >= 0.99:
            break
    components = connected_components(parts.select(F.col("rep").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "rep")
    known = reps.join(links, "rep", "left").join(components, "rep", "left")
    known, _ = materialise(known.select("vector", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("root")), "vec-known")
    smallest = known.groupBy("root").agg(F.min("id").alias("component"))
    known = known.join(smallest, "root").select("vector", "links", "component")
    good = rows.where("ok").join(known, "vector").select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    lone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return good.union(lone).select("vec_id", "n_links", "component_id", kept.alias("kept"), F.lit(share).cast("double").alias("audit_recall"))


def op1_vectors(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
