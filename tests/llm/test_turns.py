"""Conversation repair against a search through all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tallyforge.llm import turns


def least(rows):
    """rows: (initial, lost, truncated). The least (cost, audit) over all edits, insertions in any place."""
    found = []
    for edits in itertools.product("DKRr", repeat=len(rows)):  # R reroles to user, r to assistant
        for inserted in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            roles, audit, cost = inserted[0], "I" * len(inserted[0]), 2 * len(inserted[0])
            for (initial, lost, cut), e, more in zip(rows, edits, inserted[1:]):
                if lost and e != "D":
                    break
                roles += {"D": "", "K": initial, "R": "u", "r": "a"}[e] + more
                audit += e.upper() + "I" * len(more)
                cost += {"D": 3, "K": 0, "R": 2, "r": 2}[e] + 2 * len(more) + (cut and e != "D")
            else:
                if re.fullmatch("(s?(ua)+)?", roles):
                    found.append((cost, audit))
    return min(found)


def test_products():
    r = random.Random(2)
    for size in (1, 2, 3) * 12:
        rows = [(r.choice("suax"), r.random() < 0.2, r.random() < 0.3) for _ in range(size)]
        parts = [turns._turn(*x) for x in rows]
        want = least(rows)
        assert turns.least(turns.product(turns.CLOSURE, turns._whole(parts))) == want, rows
    many = [turns._turn(r.choice("suax"), r.random() < 0.2, r.random() < 0.3) for _ in range(200)]
    left = many[0]
    for m in many[1:]:
        left = turns.product(left, m)
    assert left == turns._whole(many)


def plain(rows):
    out, convs = [], {}
    for conv, turn, role, text, *_ in rows:
        own = convs.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
    for conv, own in convs.items():
        mark = lambda t: hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), mark(t)))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(turns.SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        known = [t for t, *_ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        whole = turns.CLOSURE
        for (_, role, _), f in zip(own, faults):
            whole = turns.product(whole, turns._turn(role[:1], f in ("blank", "duplicate"), f == "truncated"))
        cost, audit = turns.least(whole)
        said, queue = [], list(own)
        for e in audit:
            row = None if e == "I" else queue.pop(0)
            if e != "D":
                after = {"": "user", "s": "user", "u": "assistant", "a": "user"}[said[-1][0] if said else ""]
                said.append(f"{row[1] if e == 'K' else after}:{'' if e == 'I' else row[2]}")
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits,merged", [(16, 32), (2, 2)])
def test_repaired(spark, monkeypatch, bits, merged):
    monkeypatch.setattr(turns, "BLOCK_BITS", bits)
    monkeypatch.setattr(turns, "MERGED", merged)
    r = random.Random(4)
    words = ["Hello there.", "What now?", "cut off", "", " \n", "Yes!", "Gut.", None, "é."]
    rows = [(c, t if r.random() < 0.95 else None, r.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"]), r.choice(words), "x", 1) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(77, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.", "y", 2) for t in range(120)]
    rows += [(None, 1, "user", "Nobody.", None, None), (None, None, None, None, None, None), (78, None, "user", "Long " * 100_000, "z", 3), (77, 5, "user", "Turn 4.", "y", 2)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, place int")
    assert sorted(map(tuple, turns.repaired(docs.repartition(3)).collect()), key=repr) == plain(rows)


def test_repair_keeps_texts(spark):
    rows = [("a", 0, "user", "Hi."), ("a", 1, "user", "Again."), ("a", 2, "system", "No."), ("b", 0, "assistant", " ")]
    fixed, found = turns.repair(spark.createDataFrame(rows, "conv string, turn long, role string, text string"))
    got = [(r["conv"], r["at"], r["turn"], r["role"], r["text"], r["edit"]) for r in fixed.orderBy("conv", "at").collect()]
    assert [(r["conv"], r["cost"], r["audit"]) for r in found.orderBy("conv").collect()] == [("a", 4, "KIKR"), ("b", 3, "D")]
    assert got == [("a", 0, 0, "user", "Hi.", "K"), ("a", 1, None, "assistant", "", "I"), ("a", 2, 1, "user", "Again.", "K"), ("a", 3, 2, "assistant", "No.", "R")]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repaired(empty).count() == 0
