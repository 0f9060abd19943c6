"""Mixing, tokens, secrets, pages, vectors and the pipeline."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from tallyforge.llm import html, mixing, pieces, secrets, vectors

DATA = "/root/testdata/sf0.001"
MODEL = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer files here")


def filled(sizes, weights, share=1.5, most=2.0):
    """Targets by resharing what is over until none is."""
    target, open_, left = {}, set(sizes), share * sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


def mixture(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(0, 400)), r.choice(["b", "a", "é", "a", "a", None, "z"])) for i in range(300)]
    return rows, spark.createDataFrame([*rows, (None, None, "a"), (7, "extra row of seven", "b")], "doc_id long, text string, source string")


def test_mixing(spark):
    rows, docs = mixture(spark)
    got = mixing.mixed(docs, block_words=16).collect()
    assert len(got) == 302 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes = {}
    for _, t, s in [*rows, (7, "extra row of seven", "b")]:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = [*sorted(s for s in sizes if s is not None), None]
    weights = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    expected = filled(sizes, weights)
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 7)}
    taken = {}
    for r in got:
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    for i, _, s in rows:
        if i != 7:
            assert by[i]["source_size"] == sizes[s] and abs(by[i]["target"] - expected[s]) < 1e-6
    for s in sizes:
        assert abs(taken[sizes[s]] - expected[s]) <= 0.5 + 1e-6
    again = mixing.mixed(docs.repartition(3), block_words=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mixed(docs.where("false")).count() == 0
    whole = mixing.mix_documents(docs, 16)
    assert whole.columns == docs.columns and 0 < whole.count() <= 604


@MODEL
def test_tokens(spark):
    r = random.Random(3)
    alphabet = " " * 6 + "aaaabbethin\n\t▁é中😀\x00<s>0x41.-_"
    texts = [None, "", " ", "<s> </s><0x41>", "word " * 30000, *("".join(r.choice(alphabet) for _ in range(r.randint(0, 300))) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pieces.encode(docs).orderBy("doc_id").collect()
    assert len(rows) == len(texts) and all(r["parity"] and r["round_trip"] for r in rows)
    assert [r["n_tokens"] for r in rows[:3]] == [0, 0, 1] and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    back = pieces.decode(pieces.encode(docs)).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [(t or "").replace("▁", " ") for t in texts]
    assert pieces.encode(docs.where("false")).count() == 0


@MODEL
def test_parts_of_long_texts():
    with open(pieces.MODEL, "rb") as file:
        codec = pieces.Codec(file.read(), 1)
    r = random.Random(5)
    for _ in range(50):
        text = "".join(r.choice("  ab▁\n") for _ in range(400))
        ids = [i for p in codec.parts(text, 40) for i in codec.encode([p])[0].tolist()]
        assert ids == codec.reference([text])[0]


@MODEL
def test_round_trip_sees_the_decoder():
    from tokenizers import decoders

    with open(pieces.MODEL, "rb") as file:
        codec = pieces.Codec(file.read(), 1)
    assert codec.checked(["two words here", "", "né ▁ 漢"])[1:] == ([True] * 3, [True] * 3)
    codec.tokenizer.decoder = decoders.Sequence([decoders.Fuse()])
    assert codec.checked(["two words here"])[2] == [False]


def test_small_sources_and_clashing_names(spark):
    names = ["__copy", "__times", "times", "row", "own", "col", "block", "no"]
    rows = [(1, "a b c", "x"), (2, "a b c d", "y"), (3, "w " * 30, "z"), (4, None, None), (5, "", "q"), (6, "big " * 100_000, "z2"), (None, "n o", "x")]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    got = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
    by = {}
    for r in got.values():
        by.setdefault(r["target"], 0)
        by[r["target"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(t - k) <= 0.5 for t, k in by.items()) and got[1]["taken"] + got[None]["taken"] == 10
    whole = mixing.mix_documents(docs)
    assert whole.columns == docs.columns
    often = {}
    for r in whole.collect():
        often[r["doc_id"]] = often.get(r["doc_id"], 0) + 1
        assert [r[c] for c in names] == list(range(len(names)))
    assert often[None] == often[1] == often[2] == 2 and 4 not in often and often[6] in (1, 2)
    assert mixing.mix_documents(docs.where("false")).count() == 0


def test_unigram_models_are_rebuilt():
    import struct

    def message(*parts):
        out = b""
        for n, kind, value in parts:
            key = bytes([n << 3 | kind]) if n < 16 else bytes([(n << 3 | kind) & 127 | 128, n >> 4])
            out += key + (bytes([len(value)]) + value if kind == 2 else struct.pack("<f", value) if kind == 5 else bytes([value]))
        return out

    listed = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁ab", -1.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("▁a", -1.5, 1)]
    data = b"".join(message((1, 2, message((1, 2, p.encode()), (2, 5, s), (3, 0, k)))) for p, s, k in listed) + message((2, 2, message((3, 0, 1)))) + message((3, 2, message((3, 0, 1), (4, 0, 0))))
    codec = pieces.Codec(data, 1)
    assert codec.model.kind == pieces.UNIGRAM_MODEL
    for text in ("ab a b", "abab", "b ab"):
        assert codec.encode([text])[0].tolist() == codec.reference([text])[0]


def test_secrets(spark):
    key, aws = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "AKIA" + "Q3EGRJ7T2LPX5ZWD"
    texts = [
        None, "", "no candidates here", f'token = "{key}" rest', f'TOKEN = "{key.upper()}"!! AND', f"at commit {key} we changed", "card 4716 and 9807915762804490 once",
        f"aws access_key: {aws}\nand api_key = '{key}' end", 'token = "your-token-here-1234567"', "see https://host.example/static/vendor/theme-2023/main-style-0001 there",
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, __clean int")
    rows = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert [len(rows[i]["__secrets"]) for i in range(len(texts))] == [0, 0, 0, 1, 1, 0, 0, 2, 0, 0]
    assert rows[3]["__clean"] == 'token = "[SECRET]" rest' and rows[0]["__clean"] is None and rows[2]["__clean"] == texts[2]
    for i in (3, 4, 7):
        for s in rows[i]["__secrets"]:
            assert texts[i][s["start"] : s["start"] + s["length"]].lower() in (key, aws.lower())
    redacted = secrets.redact(docs.select("doc_id", "text").withColumn("n_chars", docs["doc_id"]))
    assert redacted.columns == ["doc_id", "text", "n_chars"] and {r["doc_id"]: r["n_chars"] for r in redacted.collect()}[3] == len('token = "[SECRET]" rest')


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy {i}</div><article><h1>Title {i}</h1><p><b>First &lt;{i}&gt;   part<br><p>Second&nbsp;part <i>in</i>line</p><div id="cookie-notice">We use cookies</div><ul><li>One<li>Two</ul><form><input>Go</form>
<section class="comments"><p>Great post</p></section></article><aside>Related</aside><footer>&copy; x</footer>"""


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i)) for i in range(25)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://o.example", "just text"), (103, "http://o.example/2", "<div>a < b <p>c<div class=ad>never closed<article><p>in</article>")]
    loose = "<div>Accept our newsletter terms and all of the conditions now</div><div>Own words of page number {i} only here stand alone</div>"
    rows += [(200 + i, f"http://plain.example/{i}", loose.format(i=i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nFirst <{i}> part\nSecond part inline\nOne\nTwo" for i in range(25))
    assert got[100] == got[101] == "" and got[102] == "just text" and got[103] == "in"
    assert got[203] == "Own words of page number 3 only here stand alone"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_that_share_a_text_stay(spark):
    rows = [(i, f"http://h.example/{i}", f"<article><p>{'the same words in every second article of this host ' * 3}</p><p>own {i}</p></article>" if i % 2 else f"<article><p>page {i}</p></article>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].startswith("the same words") and got[2] == "page 2"


def test_vectors(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(60, 16))
    group = base[0] + 0.03 * r.normal(size=(40, 16))
    pairs = base[1:15] + 0.02 * r.normal(size=(14, 16))
    x = np.concatenate((base, group, pairs, base[:3], base[:3] * 7))
    lists = [[float(v) for v in row] for row in x]
    rows = [(i, v, 1, 2) for i, v in enumerate(lists)]
    odd = [(900, None, 1, 2), (901, [], 1, 2), (902, [0.0] * 16, 1, 2), (903, [float("nan")] * 16, 1, 2), (904, [None] * 16, 1, 2), (905, [1.0, 0.0], 1, 2), (906, [2.0, 0.0], 1, 2), (None, lists[0], 1, 2)]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rep int, cell int"), cell_rows=40, block_rows=30).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(linked, root[None, :], len(x)).min(axis=1))
    assert [got[i]["n_links"] for i in range(len(x))] == linked.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == root.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(900, 905))
    assert got[905]["n_links"] == 1 and got[906]["component_id"] == 905 and got[905]["audit_recall"] >= 0.9 and len(got) == len(x) + 8


def test_vectors_audit_and_exact_search(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(700, 24))
    x = np.concatenate((base, base[:350] + 0.2 * r.normal(size=(350, 24)), base[0] + 0.02 * r.normal(size=(200, 24))))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(table, cell_rows=60, block_rows=80).collect()}
    lost = [1 - got[i]["n_links"] / n for i, n in enumerate(linked.sum(axis=1)) if n]
    assert got[0]["audit_recall"] >= 0.99 and np.mean(lost) <= 0.01 and max(got[i]["n_links"] - n for i, n in enumerate(linked.sum(axis=1))) == 0
    rows = spark.createDataFrame([(i, 24, 1, [float(v) for v in row]) for i, row in enumerate(x)], "rep long, dim int, n long, vector array<double>")
    exact = {p["rep"]: p["links"] for p in vectors._links_once(rows, 0.95, 0, 60, 80, 500, 20, 0, 1.2).groupBy("rep").agg({"links": "sum"}).toDF("rep", "links").collect()}
    assert [exact[i] for i in range(len(x))] == linked.sum(axis=1).tolist()
    # half of the sparse vectors' links lost: the dense group does not hide it
    worse = spark.createDataFrame([(i, int(n) if i % 2 or n > 8 else 0) for i, n in enumerate(linked.sum(axis=1))], "rep long, links long")
    assert vectors.recall(rows, worse, 0.95) < 0.7
    lone = table.where("vec_id < 20")
    assert {r["audit_recall"] for r in vectors.near_duplicates(lone).collect()} == {None} and vectors.near_duplicates(table.where("false")).count() == 0


@MODEL
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept, _ = corpus_pipeline.materialise(stage(spark, kept, DATA), "test")
        assert kept.columns == names
    last = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert 0 < last.count() <= 2 * docs.count() and last.where("not parity or not round_trip").count() == 0
