"""Merkle manifest of a dataset: one tree of digests per language, one tree over them, and a proof for every row.

Rows become leaves once, in one scan. The leaves are sorted by range, so a hot language lies in many partitions, and
cut into indexed blocks of at most 65,536 consecutive leaves. Each block runs a mountain-range stack: a leaf is pushed,
a run of eight (or the tree's short last run) carries into its parent, and what the block's edges cut off is left as
peaks. Peaks of neighbouring blocks are merged in the same way, 64 blocks at a time, until each tree has its root alone:
no run is padded, and no step sees more than a block or 64 blocks' peaks. Proofs go back down the same rounds: a node's
siblings up to its peak are in its block, the rest comes with the peak.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, materialise

FANOUT, BLOCK_BITS, MERGED = 8, 16, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "tree string, made long, block long, level int, idx long, digest string, n long, peak boolean, new boolean"
ENDS = "tree string, made long, level int, idx long, lefts array<string>, rights array<string>, subroot string, root string"


def digest(parts: Iterable[str]) -> str:
    """Lowercase hexadecimal sha256 of all parts, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def widths(n: int) -> list[int]:
    """How many nodes each level of a tree of n leaves has, the root's last."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


class Range:
    """The stack of one block: nodes are pushed from left to right, complete runs carry, the rest are peaks."""

    def __init__(self, n: int):
        self.widths = widths(n)
        self.stack: list[list[tuple[int, str]]] = [[] for _ in self.widths]
        self.peaks: list[tuple[int, int, str]] = []
        self.runs: dict[tuple[int, int], list[str]] = {}  # completed here: the children of a node
        self.made: dict[tuple[int, int], str] = {}

    def push(self, level: int, idx: int, node: str) -> None:
        while level < len(self.widths) - 1:
            run = self.stack[level]
            run.append((idx, node))
            if idx % FANOUT != FANOUT - 1 and idx != self.widths[level] - 1:
                return
            self.stack[level] = []
            if run[0][0] % FANOUT:  # the run begins in an earlier block
                self.peaks += [(level, i, d) for i, d in run]
                return
            children = [d for _, d in run]
            level, idx, node = level + 1, idx // FANOUT, digest(children)
            self.runs[level, idx], self.made[level, idx] = children, node
        self.peaks.append((level, idx, node))

    def close(self) -> list[tuple[int, int, str]]:
        """All peaks, those of the right edge too."""
        for level, run in enumerate(self.stack):
            self.peaks += [(level, i, d) for i, d in run]
        self.stack = [[] for _ in self.widths]
        return self.peaks

    def path(self, level: int, idx: int) -> tuple[list[tuple[str, str]], tuple[int, int]]:
        """The siblings left and right of a node and of its ancestors as far as this block has them, and the peak."""
        out = []
        while (level + 1, idx // FANOUT) in self.runs:
            at, idx, level = idx % FANOUT, idx // FANOUT, level + 1
            run = self.runs[level, idx]
            out.append(("".join(run[:at]), "".join(run[at + 1 :])))
        return out, (level, idx)


def _risen(nodes: pd.DataFrame) -> Range:
    own = Range(int(nodes["n"].iloc[0]))
    rows = sorted(zip(nodes["level"].tolist(), nodes["idx"].tolist(), nodes["digest"]), key=lambda r: r[1] * FANOUT ** r[0])
    for level, idx, node in rows:
        own.push(level, idx, node)
    own.close()
    return own


def _rise(nodes: pd.DataFrame) -> pd.DataFrame:
    own, n, tree, block = _risen(nodes), nodes["n"].iloc[0], nodes["tree"].iloc[0], nodes["block"].iloc[0]
    tops = {(lv, i) for lv, i, _ in own.peaks}
    rows = [(lv, i, d, True, (lv, i) in own.made) for lv, i, d in own.peaks] + [(*at, d, False, True) for at, d in own.made.items() if at not in tops]
    out = pd.DataFrame(rows, columns=["level", "idx", "digest", "peak", "new"])
    return out.assign(tree=tree, made=block, block=block // MERGED, n=n)[["tree", "made", "block", "level", "idx", "digest", "n", "peak", "new"]]


def leaves(docs: DataFrame) -> DataFrame:
    """tree (its language), doc_id, leaf and bent for every row of `docs`.

    A leaf is the digest of doc_id, source, lang, n_chars and text: `-` for a null, else the number of UTF-8 bytes, a
    colon and the value. `bent` is the leaf after tampering (A-Z of the text in lower case) where the crc32 of the
    decimal doc_id is divisible by 3, else null; a null text stays, and so does its leaf.
    """
    value = {c: docs[c].cast("string") for c in FIELDS}
    coded = lambda v: F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
    head = F.concat(*(coded(value[c]) for c in FIELDS[:4]))
    leaf = F.sha2(F.concat(head, coded(value["text"])), 256)
    bent = F.when(F.expr(f"{fold('doc_id', 3)} = 0"), F.sha2(F.concat(head, coded(F.translate(value["text"], UPPER, LOWER))), 256))
    tree = F.when(value["lang"].isNull(), "n").otherwise(F.concat(F.lit("s"), value["lang"]))
    return docs.select(tree.alias("tree"), docs["doc_id"].cast("long").alias("doc_id"), leaf.alias("leaf"), bent.alias("bent"))


def indexed(rows: DataFrame, tree: str, order: list[str | Column], name: str) -> DataFrame:
    """`rows` with block (of at most 65,536 consecutive rows of a tree, counted from 0), idx (place in the tree) and n (its rows).

    Sorted by range over the tree and `order`, which must not read long values; rows that tie keep the order of the input.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [tree, *order, "__tie"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__tie").withColumn("place", F.monotonically_increasing_id())
    placed, _ = materialise(dealt.withColumn("__block", F.shiftright("place", BLOCK_BITS)), name)
    upto = Window.partitionBy(tree).orderBy("__block")
    blocks = placed.groupBy(tree, "__block").agg(F.count("*").alias("__n"), F.min("place").alias("__first"))
    blocks = blocks.withColumns({
        "block": F.row_number().over(upto).cast("long") - 1, "__before": F.coalesce(F.sum("__n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n": F.sum("__n").over(Window.partitionBy(tree)),
    })
    return placed.join(blocks, [tree, "__block"]).withColumn("idx", F.col("place") - F.col("__first") + F.col("__before")).drop("__block", "__n", "__first", "__before", "place")


def raised(nodes: DataFrame) -> list[DataFrame]:
    """The rounds of merging over nodes(tree, block, level, idx, digest, n): each round's rows, the last with every root."""
    rounds, now = [], nodes
    while True:
        made, _ = materialise(now.groupBy("tree", "block").applyInPandas(_rise, NODE), "merkle-round")
        rounds.append(made)
        now = made.where("peak")
        if now.groupBy("tree").count().where("count > 1").isEmpty():
            return rounds
        now = now.select("tree", "block", "level", "idx", "digest", "n", "made")


def _lowered(key, nodes: pd.DataFrame, ends: pd.DataFrame):
    """For each node of a block, in order: its row, its siblings left and right up to the root, and the block's facts."""
    own = _risen(nodes)
    last = {(lv, i): (list(a), list(b)) for lv, i, a, b in zip(ends["level"].tolist(), ends["idx"].tolist(), ends["lefts"], ends["rights"])}
    rest: dict[tuple[int, int], tuple[list[str], list[str]]] = {}

    def above(level: int, idx: int) -> tuple[list[str], list[str]]:
        if (level, idx) not in rest:
            steps, peak = own.path(level, idx)
            rest[level, idx] = [a for a, _ in steps] + last[peak][0], [b for _, b in steps] + last[peak][1]
        return rest[level, idx]

    for row in nodes.itertuples(index=False):
        run = own.runs.get((row.level + 1, row.idx // FANOUT))
        if run is None:
            yield row, *last[row.level, row.idx]
        else:
            at, (a, b) = row.idx % FANOUT, above(row.level + 1, row.idx // FANOUT)
            yield row, ["".join(run[:at]), *a], ["".join(run[at + 1 :]), *b]


def _lower(key, nodes: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    subroot, root = ends["subroot"].iloc[0], ends["root"].iloc[0]
    rows = [(r.tree, r.made, r.level, r.idx, a, b, subroot, root) for r, a, b in _lowered(key, nodes, ends)]
    return pd.DataFrame(rows, columns=["tree", "made", "level", "idx", "lefts", "rights", "subroot", "root"])


def _prove(key, nodes: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    subroot, root, out, joined = ends["subroot"].iloc[0] if len(ends) else None, ends["root"].iloc[0] if len(ends) else None, [], {}
    for r, lefts, rights in _lowered(key, nodes, ends):
        at = r.idx // FANOUT, len(lefts)
        if at not in joined:  # all but the leaf's own run is the same for eight leaves
            joined.clear()
            joined[at] = "".join(a + b for a, b in zip(lefts[1:], rights[1:]))
        now = r.bent if isinstance(r.bent, str) else r.digest
        for a, b in zip(lefts, rights):
            now = digest((a, now, b))
        first = lefts[0] + rights[0] if lefts else ""
        out.append((r.doc_id, r.digest, subroot, root, digest((first, joined[at])), now, now == root))
    return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def lowered(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The ends of the first round's peaks, from those of the roots: as many steps down as there were rounds up."""
    for made in reversed(rounds[:-1]):
        own = made.where("peak").select("tree", "block", "made", "level", "idx", "digest", "n")
        ends, _ = materialise(own.groupBy("tree", "block").cogroup(ends.groupBy("tree", "made")).applyInPandas(_lower, ENDS), "merkle-ends")
    return ends


class Manifest:
    """The trees over `docs`: `nodes`, `roots` and `root`, and the proofs of all rows.

    Null fields are coded as `-`; a null lang is a tree of its own and the first of the top tree; null doc_ids come
    first, rows with one doc_id go by leaf, and repeated rows are leaves of their own; texts of any length and empty
    texts are values like others; other columns are ignored; an empty table has no nodes and no proofs.
    """

    def __init__(self, docs: DataFrame):
        made, _ = materialise(leaves(docs), "merkle-leaves")
        self.leaves = indexed(made, "tree", [F.col("doc_id").asc_nulls_first(), "leaf"], "merkle-rows")
        level = F.lit(0).alias("level")
        self._base = self.leaves.select("tree", "block", level, "idx", F.col("leaf").alias("digest"), "n", F.col("doc_id").cast("string").alias("doc_id"), "bent")
        self._rounds = raised(self._base.drop("doc_id", "bent"))
        self.roots = self._rounds[-1].where("peak").select(F.col("tree").alias("lang_tree"), "digest", F.col("made").alias("lang_made"), F.col("level").alias("lang_level"))
        top = indexed(self.roots.withColumn("tree", F.lit("top")), "tree", ["lang_tree"], "merkle-roots")
        self._top = top.select("tree", "block", F.lit(0).alias("level"), "idx", "digest", "n", F.col("lang_tree").alias("lang_tree"), "lang_made", "lang_level")
        self._top_rounds = raised(self._top.select("tree", "block", "level", "idx", "digest", "n"))
        self.root = self._top_rounds[-1].where("peak").select(F.col("digest").alias("root"), F.col("made"), F.col("level"))

    def nodes(self) -> DataFrame:
        """lang, top (whether of the tree over the languages), level (leaves of the dataset 0), idx and digest of every node."""
        made = lambda rounds: [r.where("new").select("tree", "level", "idx", "digest") for r in rounds]
        all_ = [self._base.select("tree", "level", "idx", "digest"), *made(self._rounds), *made(self._top_rounds)]
        out = all_[0]
        for part in all_[1:]:
            out = out.unionByName(part)
        lang = F.when(F.col("tree").startswith("s"), F.substr("tree", F.lit(2)))
        return out.select(lang.alias("lang"), (F.col("tree") == "top").alias("top"), "level", "idx", "digest")

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row."""
        none = F.array().cast("array<string>")
        root = F.col("root")
        ends = self.root.select(F.lit("top").alias("tree"), "made", F.col("level"), F.lit(0).cast("long").alias("idx"), none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), root)
        ends = lowered(self._top_rounds, ends)
        base = self._top.withColumnsRenamed({"lang_tree": "doc", "lang_made": "made"})
        down = base.groupBy("tree", "block").cogroup(ends.groupBy("tree", "made")).applyInPandas(_hand_down, ENDS)
        down, _ = materialise(down, "merkle-tops")
        ends = lowered(self._rounds, down)
        kind = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"  # a long with nulls would be a float in pandas
        found = self._base.groupBy("tree", "block").cogroup(ends.groupBy("tree", "made")).applyInPandas(_prove, kind)
        return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _hand_down(key, nodes: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """The subroots' ends in the top tree, as the ends of their own trees' roots."""
    root = ends["root"].iloc[0]
    rows = [(r.doc, r.made, r.lang_level, 0, a, b, r.digest, root) for r, a, b in _lowered(key, nodes, ends)]
    return pd.DataFrame(rows, columns=["tree", "made", "level", "idx", "lefts", "rights", "subroot", "root"])


def op11_manifest(spark, sf_dir: str) -> DataFrame:
    return Manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")).proofs()
