"""Repair of conversations: the cheapest edits after which the roles read system?, then user and assistant in turn.

A state says what has been said last: nothing, system, user or assistant. Each turn is a 4x4 matrix over (cost, audit):
the least cost of going from state to state by keeping, reroling or deleting the turn, and the edits' initials. It is
closed by insertions, and matrices multiply by (min, +) with the audits joined, ties going to the audit that is less in
ASCII order. Two audits over the same turns that cost the same are never a prefix of each other (their letters fix
their cost, and what one had more would be insertions alone), so least parts make a least whole and the product is
associative. Turns are sorted by range, multiplied within blocks of at most 65,536, and then 32 blocks at a time, so a
conversation of any length is repaired across partitions. What else is counted merges in the same elements.

The repaired turns and their hash are made in one pass over turns sorted by conversation: memory is a batch and one
audit. A hash of a whole conversation is sequential by nature, so there one conversation is one task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

BLOCK_BITS, MERGED = 16, 32
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
SPACES = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
#: What may follow a state by an insertion or a reroled turn, and the state after it.
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}

Matrix = list[list[tuple[int, str] | None]]

#: The matrix of no turn: insertions alone. More than two in a row never pay.
CLOSURE: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
for _i in range(4):
    CLOSURE[_i][FOLLOWS[_i]] = (2, "I")
    if FOLLOWS[FOLLOWS[_i]] != _i:
        CLOSURE[_i][FOLLOWS[FOLLOWS[_i]]] = (4, "II")


def product(a: Matrix, b: Matrix) -> Matrix:
    """(min, +) with audits joined."""
    out: Matrix = []
    for row in a:
        own: list[tuple[int, str] | None] = []
        for j in range(4):
            best = None
            for k in range(4):
                left, right = row[k], b[k][j]
                if left is None or right is None:
                    continue
                cost = left[0] + right[0]
                if best is None or cost < best[0] or cost == best[0] and left[1] + right[1] < best[1]:
                    best = (cost, left[1] + right[1])
            own.append(best)
        out.append(own)
    return out


def of_turn(initial: str, lost: bool, truncated: bool) -> Matrix:
    """A turn with this role's initial, closed by insertions after it. `lost`: it has to be deleted."""
    one: Matrix = [[(3, "D") if i == j else None for j in range(4)] for i in range(4)]
    if not lost:
        more = int(truncated)
        for state, after in FOLLOWS.items():
            one[state][after] = (2 + more, "R")
        if initial == "s":
            one[START][SYSTEM] = (more, "K")
        elif initial in ("u", "a"):
            for state, after in FOLLOWS.items():
                if ROLES[after][0] == initial:
                    one[state][after] = (more, "K")
    return product(one, CLOSURE)


_TURNS: dict[tuple[str, bool, bool], Matrix] = {}


def _turn(initial: str, lost: bool, truncated: bool) -> Matrix:
    key = (initial if initial in "sua" else "", lost, truncated)
    if key not in _TURNS:
        _TURNS[key] = of_turn(*key)
    return _TURNS[key]


def _whole(parts: list[Matrix]) -> Matrix:
    """The product of many, in pairs: audits are copied only as often as the tree is deep."""
    while len(parts) > 1:
        parts = [product(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def least(whole: Matrix) -> tuple[int, str]:
    """Cost and audit of the cheapest repair: from nothing said to nothing or the assistant's word."""
    ends = [e for e in (whole[START][START], whole[START][ASSISTANT]) if e]
    return min(ends)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: conv (a key that is never null), conv_id, turn, role and text of the rows that are left.

    By crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes out `.`, `!` and `?`, 3 repeats it,
    4 makes it the user's. Nulls are one space in that key, in role and in text; a null turn or conv_id stays null.
    """
    c = conversations
    spaced = lambda x: F.coalesce(c[x].cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    rows = c.select(_key(c["conv_id"]).alias("conv"), c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), fate.alias("fate"))
    return rows.where("fate <> 0").withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate", "copy")


def _key(conv_id):
    return F.coalesce(conv_id.cast("string"), F.lit("null"))


def judged(turns: DataFrame) -> DataFrame:
    """Turns (conv, turn, role, text) with place (their order: by conv, turn with nulls first, role, then the hash of role
    and text), block, initial and fault (blank, duplicate, truncated or null)."""
    mark = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    rows = turns.withColumns({"mark": mark, "initial": F.substring("role", 1, 1), "blank": ~F.col("text").rlike(WORD), "open": ~last.isin(".", "!", "?")})
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    placed, _ = materialise(dealt, "turns")
    again = placed.groupBy("conv", "mark").agg(F.min("place").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("__first"), "duplicate").when(F.col("open"), "truncated")
    return placed.join(again, ["conv", "mark"], "left").select("conv", "turn", "role", "text", "place", F.shiftright("place", BLOCK_BITS).alias("block"), "initial", fault.alias("fault"))


ELEMENT = (
    "conv string, block long, costs array<int>, audits array<string>, first string, last string, illegal long, blank long, duplicate long, truncated long, "
    "low long, high long, turns long, left long, right long"
)
COUNTS = ["illegal", "blank", "duplicate", "truncated"]
#: Costs of 32 bits last for 700 million turns of one conversation.
NONE = -1


def _packed(m: Matrix) -> tuple[list[int], list[str]]:
    flat = [e for row in m for e in row]
    return [e[0] if e else NONE for e in flat], [e[1] if e else "" for e in flat]


def _unpacked(costs, audits) -> Matrix:
    flat = [(int(c), a) if c != NONE else None for c, a in zip(costs, audits)]
    return [flat[i : i + 4] for i in range(0, 16, 4)]


def _element(conv: str, block: int, rows: list[tuple]) -> tuple:
    """rows: (turn, initial, fault) in order."""
    whole = _whole([_turn(i, f in ("blank", "duplicate"), f == "truncated") for _, i, f in rows])
    faults = [f for *_, f in rows]
    known = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1] + b[1] not in LEGAL for a, b in zip(rows, rows[1:]))
    ends = (known[0], known[-1]) if known else (None, None)
    return conv, block, *_packed(whole), rows[0][1], rows[-1][1], illegal, *(faults.count(c) for c in COUNTS[1:]), *ends, len(set(known)), *ends


def _elements(batch: pa.Table) -> pa.Table:
    """The elements of a block, one for each conversation."""
    batch = batch.sort_by("place")
    out, own, at = [], [], None
    block = batch["block"][0].as_py()
    for conv, *row in zip(*(batch[c].to_pylist() for c in ("conv", "turn", "initial", "fault"))):
        if conv != at and own:
            out.append(_element(at, block, own))
            own = []
        at = conv
        own.append(tuple(row))
    out.append(_element(at, block, own))
    return _table(out)


KIND = pa.schema([
    ("conv", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()),
    *((c, pa.int64()) for c in (*COUNTS, "low", "high", "turns", "left", "right")),
])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), KIND)], schema=KIND)


def merged(parts: list[dict]) -> tuple:
    """One element of neighbouring ones, in order: conv, block of the first, and so on as in ELEMENT."""
    whole = _whole([_unpacked(p["costs"], p["audits"]) for p in parts])
    sums = {c: sum(p[c] for p in parts) for c in (*COUNTS, "turns")}
    sums["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
    known = [p for p in parts if p["low"] is not None]
    sums["turns"] -= sum(a["right"] == b["left"] for a, b in zip(known, known[1:]))  # one turn on both sides of a cut
    low, high = (known[0]["low"], known[-1]["high"]) if known else (None, None)
    return parts[0]["conv"], parts[0]["block"], *_packed(whole), parts[0]["first"], parts[-1]["last"], *(sums[c] for c in COUNTS), low, high, sums["turns"], low, high


def _merge(batch: pa.Table) -> pa.Table:
    return _table([merged(batch.sort_by("block").to_pylist())])


def repairs(turns: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation among judged `turns`."""
    now, _ = materialise(turns.select("conv", "block", "place", "turn", "initial", "fault").groupBy("block").applyInArrow(_elements, ELEMENT), "turn-elements")
    done = []
    while True:
        count = Window.partitionBy("conv")
        ranked = now.withColumns({"__n": F.count("*").over(count), "__at": F.row_number().over(count.orderBy("block")) - 1})
        ranked, _ = materialise(ranked, "turn-ranks")
        done.append(ranked.where("__n = 1").drop("__n", "__at"))
        rest = ranked.where("__n > 1")
        if rest.isEmpty():
            break
        group = F.floor(F.col("__at") / MERGED).alias("__group")
        now, _ = materialise(rest.groupBy("conv", group).applyInArrow(lambda t: _merge(t.drop(["__n", "__at"])), ELEMENT), "turn-elements")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.mapInPandas(_solved, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [least(product(CLOSURE, _unpacked(c, a))) for c, a in zip(batch["costs"], batch["audits"])]
        gaps = (batch["high"] - batch["low"] + 1 - batch["turns"]).fillna(0).astype("int64")
        yield pd.DataFrame({"conv": batch["conv"], "gaps": gaps, **{c: batch[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": [c for c, _ in found], "audit": [a for _, a in found]})


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv, each conversation's audit first: the repaired turns, in order."""
    kind = pa.schema([("conv", pa.string()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    conv, audit, at, n, shift = None, "", 0, 0, 0
    out: list[tuple] = []

    def inserted() -> None:
        nonlocal at, n
        while at < len(audit) and audit[at] == "I":
            out.append((conv, n, None, ROLES[USER + (n - shift) % 2], "", "I"))
            at, n = at + 1, n + 1

    for batch in batches:
        for key, head, turn, role, initial, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "turn", "role", "initial", "text"))):
            if key != conv:
                inserted()
                conv, audit, at, n, shift = key, head or "", 0, 0, 0
                continue
            inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "K" and initial == "s":
                shift = 1
            out.append((conv, n, turn, role if edit == "K" else ROLES[USER + (n - shift) % 2], text, edit))
            n += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)
            out.clear()
    inserted()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns, sorted: the sha256 of each conversation's `role:text`, joined by line feeds."""
    conv, now = None, hashlib.sha256()
    kind = pa.schema([("conv", pa.string()), ("sha", pa.string())])
    for batch in batches:
        found = []
        for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
            if key != conv:
                if conv is not None:
                    found.append((conv, now.hexdigest()))
                conv, now = key, hashlib.sha256()
            else:
                now.update(b"\n")
            now.update(f"{role}:{text}".encode())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], schema=kind)
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([now.hexdigest()])], schema=kind)


def applied(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns: conv, at (from 0), turn (null where inserted), role, text, edit (K, R or I), sorted by conv and at
    within partitions that hold whole conversations."""
    none = lambda t: F.lit(None).cast(t)
    heads = found.select("conv", F.lit(-1).cast("long").alias("place"), "audit", none("long").alias("turn"), none("string").alias("role"), none("string").alias("initial"), none("string").alias("text"))
    rows = turns.select("conv", "place", none("string").alias("audit"), "turn", "role", "initial", "text")
    dealt = heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "place")
    return dealt.select("conv", "audit", "turn", "role", "initial", "text").mapInArrow(_applied, "conv string, at long, turn long, role string, text string, edit string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired turns of conversations (conv, turn, role, text) and the findings of each: see `applied`, `repairs`.

    `conv` is a text that is never null. Roles are judged by their first letter: one with another initial, or none, is
    never kept. Null turns come first, ties go by role and text, repeated rows are duplicates; a blank text goes, of any
    length; an empty table gives no rows; other columns are ignored.
    """
    known, _ = materialise(judged(turns), "turns-judged")
    found, _ = materialise(repairs(known), "turn-repairs")
    return applied(known, found), found


def repaired(conversations: DataFrame) -> DataFrame:
    """Damages `conversations` (see `damaged`) and repairs them: one row for every original conv_id, null included."""
    turns, found = repair(damaged(conversations))
    hashes = turns.mapInArrow(_hashed, "conv string, sha string")
    everyone = conversations.select(_key(conversations["conv_id"]).alias("conv"), conversations["conv_id"].cast("long").alias("conv_id")).distinct()
    rows = everyone.join(found, "conv", "left").join(hashes, "conv", "left")
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *sums, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_turns(spark, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
