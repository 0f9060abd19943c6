"""The Merkle manifest against a plain version."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from tallyforge.llm import manifest

KIND = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root, and for each leaf its siblings as (left, right), level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for leaf, k in enumerate(at):
            run = level[k // 8 * 8 : k // 8 * 8 + 8]
            paths[leaf].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        at = [k // 8 for k in at]
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def plain(rows):
    coded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(coded, (*r[:4], text)))
    low = str.maketrans(manifest.UPPER, manifest.LOWER)
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[2] for x in sorted(langs[k], key=lambda x: x[:3])]) for k in order}
    root, tops = tree([trees[k][0] for k in order])
    out = []
    for k, top in zip(order, tops):
        for (*_, own, r), path in zip(sorted(langs[k], key=lambda x: x[:3]), trees[k][1]):
            bent = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r, r[4].translate(low)) if bent and r[4] is not None else own
            for a, b in path + top:
                now = h(a, now, b)
            out.append((r[0], own, trees[k][0], root, h(*(a + b for a, b in path + top)), now, now == root))
    return sorted(out, key=repr)


def rows_of(n, langs=("en", "fr", None, "é", "zz")):
    rows = [(i * 7 % 1000, "S", langs[0 if i % 3 else i % len(langs)], i, f"Text {i} É", "x", 1) for i in range(n)]
    return rows + [(5, "S", "en", 1, "Same", "x", 1)] * 3 + [(None, None, None, None, None, None, None), (None, "", "", None, "", "y", 2), (9, "a", "long", 3, "Ab " * 200_000, None, None)]


@pytest.mark.parametrize("n,bits,merged", [(300, 3, 2), (90, 16, 64), (2, 1, 8)])
def test_proofs(spark, monkeypatch, n, bits, merged):
    monkeypatch.setattr(manifest, "BLOCK_BITS", bits)
    monkeypatch.setattr(manifest, "MERGED", merged)
    rows = rows_of(n)
    got = manifest.Manifest(spark.createDataFrame(rows, KIND).repartition(3)).proofs()
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_empty_one_and_nodes(spark):
    empty = manifest.Manifest(spark.createDataFrame([], KIND))
    assert empty.proofs().count() == 0 and empty.nodes().count() == 0
    one = manifest.Manifest(spark.createDataFrame([(7, "s", "en", 1, "AB", "x", 1)], KIND))
    row = one.proofs().first()
    assert row["root"] == row["leaf"] == row["subroot"] and row["proof_sha256"] == h() and not row["verified"]
    rows = rows_of(100)
    nodes = [tuple(r) for r in manifest.Manifest(spark.createDataFrame(rows, KIND)).nodes().collect()]
    langs = {}
    for r in rows:
        langs[r[2]] = langs.get(r[2], 0) + 1
    assert len(nodes) == len(set(nodes)) == sum(sum(manifest.widths(c)) for c in langs.values()) + sum(manifest.widths(len(langs))[1:])
