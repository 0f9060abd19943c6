"""Personal data: the patterns against plain regular expressions, the transducers on disguises and on clean texts."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time

import pytest

from tallyforge.llm import personal


def plain(text):
    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and personal.luhn(re.sub("[^0-9]", "", m)), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return {k: [m.span() for m in re.finditer(p, text) if ok[k](m[0])] for k, p in rules.items()}


def test_patterns():
    r = random.Random(3)
    for letters in ("0123456789.@+- ()ab1.4 ", "0.1.2", "4 1-", "a@b.", "+1(2) "):
        for _ in range(1500):
            text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
            assert personal.plain(text) == plain(text), text


DISGUISED = [
    ("write to john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com", "john.doe@example.com"),
    ("jane dot roe at mail dot example dot org, thanks", "email", "jane dot roe at mail dot example dot org", "jane.roe@mail.example.org"),
    ("an jоhn@exаmple.com", "email", "jоhn@exаmple.com", "john@example.com"),
    ("é ｊｏｈｎ＠example．com", "email", "ｊｏｈｎ＠example．com", "john@example.com"),
    ("name@host dot com", "email", "name@host dot com", "name@host.com"),
    ("marie arobase exemple point fr", "email", "marie arobase exemple point fr", "marie@exemple.fr"),
    ("max (ät) beispiel (punkt) de", "email", "max (ät) beispiel (punkt) de", "max@beispiel.de"),
    ("j​o​hn@ex­ample.com", "email", "j​o​hn@ex­ample.com", "john@example.com"),
    ("192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1", "192.168.0.1"),
    ("host one nine two dot one six eight dot zero dot one.", "ip", "one nine two dot one six eight dot zero dot one", "192.168.0.1"),
    ("four one one one " + "one one one one " * 3, "card", "four one one one one one one one one one one one one one one one", "4111111111111111"),
    ("4lll 1111 1111 1l11", "card", "4lll 1111 1111 1l11", "4111 1111 1111 1111"),
    ("plus four nine, one seven zero, triple five, one two three four.", "phone", "plus four nine, one seven zero, triple five, one two three four", "+491705551234"),
    ("plus eins zwei drei vier fünf sechs sieben acht neun null", "phone", "plus eins zwei drei vier fünf sechs sieben acht neun null", "+1234567890"),
    ("+1 (O17) 555-77l3", "phone", "+1 (O17) 555-77l3", "+1 (017) 555-7713"),
    ("tel +4٩ ١٧٠ 555 1234", "phone", "+4٩ ١٧٠ 555 1234", "+49 170 555 1234"),
]
CLEAN = [
    "look at example.com or meet at noon. dot your i", "un deux trois, nous irons au bois", "the man at the shop. com is short", "point de vue, at the point of no return", "Preis: 1 200,50 € – 3 Stück",
    "one or two, three at most", "call at one one two", "Иван пошёл домой в 5 часов", "at dot com fever", "version 1.2.3 of 4.5.6", "ll Il O0 B8", "A – B • C · D", "",
    "a | 555-3384 12 | b", "5553384 I am", "I 40 5553 l O",
]


@pytest.mark.parametrize("text,kind,span,value", DISGUISED)
def test_disguises(text, kind, span, value):
    at = text.index(span)
    assert (kind, at, at + len(span), value, False) in personal.spans_of(text)
    assert span not in personal.masked(text) and f"[{kind.upper()}]" in personal.masked(text)


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert personal.spans_of(text) == []


def test_plain_spans_stay():
    for text in ("x | +1 (091) 555-3384 | y", "+1 (091) 555-3384 I am", "lol +1 (091) 555-3384 lol"):
        assert [s[3:] for s in personal.spans_of(text)] == [("+1 (091) 555-3384", True)]
    text = "x john@example.com, 4111 1111 1111 1111 and +1 (017) 555-7713, 10.0.0.1; bob [at] a [dot] io"
    found = personal.spans_of(text)
    assert [s[:3] for s in found if s[4]] == [(k, a, b) for k in personal.KINDS for a, b in plain(text)[k]]
    assert [s[3] for s in found if not s[4]] == ["bob@a.io"]


@pytest.mark.parametrize("part", ["a", "1", "@", "+1 (", "1.", "one ", "at dot ", "a at ", "a@b ", "l1 ", "．", "a.a@", "x at a dot ", "a-at-", "[at]", "one-", "plus "])
def test_long_texts_take_linear_time(part):
    text = part * (400_000 // len(part))
    start = time.process_time()
    personal.spans_of(text)
    assert time.process_time() - start < 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = personal.op13_personal(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        spans = plain(texts[r["doc_id"]] or "")
        said = ",".join(f"{k}:{a}:{b}" for k in personal.KINDS for a, b in spans[k])
        assert [r[f"n_{k}"] for k in personal.KINDS] == [len(spans[k]) for k in personal.KINDS] and r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["n_added"] == 0 and r["spans"] == said  # no table has disguises


def test_find(spark):
    rows = [(1, "a@b.co", 5), (1, "a@b.co", 5), (None, "é bob [at] a [dot] io", 6), (2, None, 7), (3, "", None), (4, "word " * 200_000 + "+1 (017) 555-7713", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"], s["plain"]) for s in r["spans"]]) for r in personal.find(docs).collect()), key=repr)
    one = (1, [("email", 0, 6, True)])
    assert got == sorted([one, one, (None, [("email", 2, 21, False)]), (2, []), (3, []), (4, [("phone", 1_000_000, 1_000_017, True)])], key=repr)
    assert sorted(map(str, (r["text"] for r in personal.mask(docs).where("doc_id is null or doc_id < 4").collect()))) == sorted(["[EMAIL]", "[EMAIL]", "é [EMAIL]", "None", ""])
    assert personal.find(docs.where("false")).count() == 0
