"""One vec_id with several vectors, squeezing models and line feeds, articles that are half boilerplate."""

from __future__ import annotations

import os
import random
import struct

from tallyforge.llm import html, pieces, suffixes, vectors
from tallyforge.llm.common import TIDY, shared_dir


def test_one_vec_id_with_several_vectors(spark):
    near = lambda a, b: [a + 0.01, b + 0.01, 0.0]
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, near(1.0, 0.0)), (3, near(0.0, 1.0)), (9, [0.0, 0.0, 1.0]), (8, [0.0, 0.0, 2.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)
    # 1 and 2 are linked, 1 (twice) and 3 are, and the two groups stay apart
    assert found == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (8, 1, 8, True), (9, 1, 8, False)]


def test_squeezing_models_keep_spaces_beside_line_feeds():
    def message(*parts):
        out = b""
        for n, kind, value in parts:
            out += bytes([n << 3 | kind]) + (bytes([len(value)]) + value if kind == 2 else struct.pack("<f", value) if kind == 5 else bytes([value]))
        return out

    listed = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("▁a", -1.5, 1), ("▁b", -1.6, 1), ("\n", -2.0, 1)]
    data = b"".join(message((1, 2, message((1, 2, p.encode()), (2, 5, s), (3, 0, k)))) for p, s, k in listed) + message((2, 2, message((3, 0, 1)))) + message((3, 2, message((3, 0, 1), (4, 0, 1))))
    codec = pieces.Codec(data, 1)
    assert codec.model.squeeze
    for text in ("a\n b", "a \n  b", "  a  b  ", " \n a", "a \n", "\n\n  b   a\n", "", " ", "a\n"):
        assert codec.encode([text])[0].tolist() == codec.reference([text])[0], repr(text)


def test_boilerplate_may_be_most_of_an_article_but_near_copies_stay(spark):
    r = random.Random(2)
    words = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    shared, copied = words(60), [f"c{i}" for i in range(200)]
    rows = [(i, f"http://a.example/{i}", f"<article><p>{shared}</p><p>{words(40)}</p></article>") for i in range(40)]
    for i in range(20):  # copies that differ in a tenth of the words, all in one stretch
        own = [*copied[:160], *(f"own{i}x{j}" for j in range(20)), *copied[180:]]
        rows.append((100 + i, f"http://b.example/{i}", f"<article><p>{' '.join(own)}</p></article>"))
    got = {p["page_id"]: p for p in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["n_cut"] == 60 and shared not in got[i]["text"] and len(got[i]["text"].split()) == 40 for i in range(40))
    assert all(got[100 + i]["n_cut"] == 0 and len(got[100 + i]["text"].split()) == 200 for i in range(20))


def test_tables_of_the_suffixes_go_once_they_are_used(spark):
    path = shared_dir(spark).removeprefix("file:")
    before, setting = set(os.listdir(path)), spark.conf.get(TIDY)
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{i} {passage} tail {i}") for i in range(9)] + [(9, "short")], "doc_id long, text string")
    found = suffixes.without_repeats(docs, span=60)
    assert [x.split("-")[1:3] for x in set(os.listdir(path)) - before] == [["suffix", "spans"]] and spark.conf.get(TIDY) == setting
    assert sorted((r["doc_id"], len(r["spans"])) for r in found.collect()) == [*((i, 1) for i in range(9)), (9, 0)]
