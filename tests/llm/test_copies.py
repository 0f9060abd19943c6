"""Near copies by shingle sets against all pairs, and the near-duplicate stage of the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tallyforge.llm import copies

WORDS = [f"w{i}" for i in range(5000)]


def edited(own, k, r):
    out = list(own)
    for at in r.sample(range(len(own)), k):
        out[at] = f"new{r.randrange(10**9)}"
    return out


def corpus(seed=3):
    """Texts of all lengths; copies from very close to just under the bar; a line that all of one kind have."""
    r = random.Random(seed)
    line = [f"common{i}" for i in range(12)]
    texts = [None, "", " ", "one", "one", "two words"]
    for n in (6, 20, 60, 100, 300, 300, 300, 40, 41, 42):
        own = [r.choice(WORDS) for _ in range(n)]
        texts += [" ".join(own)] + [" ".join(edited(own, k, r)) for k in (1, 1, 2, max(1, n // 50), max(1, n // 40), n // 6)]
    texts += [" ".join(line + [r.choice(WORDS) for _ in range(30)]) for _ in range(40)]
    own = [r.choice(WORDS) for _ in range(120)]
    return texts + [" ".join(edited(own, 1, r)) for _ in range(25)]


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    """Smallest id of each component of pairs at 0.8 or more, all pairs compared."""
    name = {i: i for i, _ in rows}
    sets = [(i, grams(t)) for i, t in rows]
    links = [(i, j) for i, a in sets for j, b in sets if i < j and 5 * len(a & b) >= 4 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(name[i], name[j])
            changed |= name[i] != low or name[j] != low
            name[i] = name[j] = low
    return name


def test_near_copies_against_all_pairs(spark):
    rows = list(enumerate(corpus()))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(docs).collect()}
    assert got == expected(rows)
    assert copies.near_copies(docs.where("false")).count() == 0


def test_blocks_of_large_groups(spark):
    """Variants that share rare shingles but are mostly too far apart, in blocks of eight rows."""
    r = random.Random(9)
    base = [r.choice(WORDS) for _ in range(60)]
    rows = list(enumerate(" ".join(edited(base, r.choice([1, 1, 2, 3, 4]), r)) for _ in range(150)))
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, key int")
    got = {x["doc_id"]: x["component_id"] for x in copies.near_copies(docs, block_rows=8).collect()}
    assert got == expected(rows) and len(set(got.values())) > 5


def test_parity_maps_bound_the_overlap():
    r = np.random.default_rng(1)
    for n, m, both in ((30, 30, 20), (200, 180, 150), (1000, 700, 600), (5000, 4000, 3900), (1, 1, 1), (0, 3, 0)):
        pool = np.unique(r.integers(0, 1 << 63, n + m, dtype=np.uint64))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:both], pool[n : n + m - both])))
        maps = [np.frombuffer(copies.parity_map(x), dtype=np.uint64)[None] for x in (a, b)]
        small = min(x.shape[1] for x in maps)
        apart = int(np.bitwise_count(copies.folded(maps[0], small) ^ copies.folded(maps[1], small)).sum())
        assert (len(a) + len(b) - apart) // 2 >= len(np.intersect1d(a, b)) and apart % 2 == (len(a) + len(b)) % 2


def test_rows_that_share_a_key():
    r = random.Random(6)
    for _ in range(300):
        keys = sorted(r.randrange(5) for _ in range(r.randint(1, 20)))
        rows = [(k, i, 10, 0) for i, k in enumerate(keys)]
        cuts = sorted(r.sample(range(len(rows) + 1), min(len(rows), 5)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        names = ["key", "sig", "n", "pos"]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[c] for x in p], pa.int64()) for c in range(4)], names) for p in parts]
        out = [tuple(x.values()) for b in copies._shared(iter(batches), copies.LEAST) for x in b.to_pylist()]
        assert out == [(*x, keys.index(x[0])) for x in rows if keys.count(x[0]) > 1]


def test_pipeline_drops_near_copies(spark):
    rows = list(enumerate(corpus(5)))
    docs = spark.createDataFrame([*rows, (None, "no id"), (None, None)], "doc_id long, text string")
    kept = sorted((r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()), key=lambda i: -1 if i is None else i)
    assert kept == [None, None, *sorted(set(expected(rows).values()))]


def test_groups_are_whole():
    r = random.Random(2)
    for _ in range(200):
        keys = sorted(r.randrange(6) for _ in range(r.randint(1, 25)))
        cuts = sorted(r.sample(range(len(keys) + 1), min(len(keys), 4)))
        parts = [keys[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)])]
        out = [b.column(0).to_pylist() for b in copies._groups(iter([pa.RecordBatch.from_arrays([pa.array(p, pa.int64())], ["key"]) for p in parts]))]
        assert [k for b in out for k in b] == keys
        assert sum(len(set(b)) for b in out) == len(set(keys))
