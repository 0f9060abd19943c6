"""Main text of pages: the host's suffix array against every run compared, and markup names."""

from __future__ import annotations

import random

from tallyforge.llm import html

SCHEMA = "page_id long, url string, html string"
WORDS = [f"w{i}" for i in range(4000)]


def words(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def expected(streams, least=3):
    """Blocks left of each stream (a list of blocks) when runs on `least` distinct contents go: every head compared."""
    where = {}
    flat = [[w for b in s for w in b.split(" ")] for s in streams]
    for own in flat:
        for i in range(len(own) - html.HEAD + 1):
            where.setdefault(tuple(own[i : i + html.HEAD]), set()).add(tuple(own))
    out = []
    for s, own in zip(streams, flat):
        covered = [False] * len(own)
        for i in range(len(own) - html.HEAD + 1):
            if len(where[tuple(own[i : i + html.HEAD])]) >= least:
                covered[i : i + html.HEAD] = [True] * html.HEAD
        gone, start = [False] * len(own), 0
        while start < len(own):
            end = start
            while end < len(own) and covered[end]:
                end += 1
            if end - start >= html.RUN:
                gone[start:end] = [True] * (end - start)
            at = 0
            for b in s:
                size = len(b.split(" "))
                if start <= at and at + size <= end:
                    gone[at : at + size] = [True] * size
                at += size
            start = max(end, start + 1)
        left, at = [], 0
        for b in s:
            size = len(b.split(" "))
            own_left = [w for w, g in zip(own[at : at + size], gone[at : at + size]) if not g]
            left += [" ".join(own_left)] if own_left else []
            at += size
        out.append("\n".join(left))
    return out


def test_runs_that_pages_repeat_go_whatever_their_names(spark):
    r = random.Random(4)
    frame, notice, inner = words(r, 60), words(r, 9), words(r, 30)
    streams = []
    for k in range(40):
        own = [words(r, r.randint(3, 80)) for _ in range(r.randint(1, 4))]
        if k % 2:
            own = [frame[: 200 + 5 * (k % 7)], *own, notice]
        if k % 5 == 0:
            own[0] = f"{own[0]} {inner} {words(r, 5)}"
        streams.append([" ".join(b.split()) for b in own])
    streams.append(streams[1])  # a copy is no evidence
    streams += [[words(r, 500)]] * 5
    pages = [(i, "http://Host.example/x", "".join(f"<div>{b}</div>" for b in s)) for i, s in enumerate(streams)]
    random.Random(1).shuffle(pages)
    got = {x["page_id"]: x for x in html.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    want = expected(streams)
    assert [got[i]["text"] for i in range(len(streams))] == want
    assert sum(got[i]["n_cut"] > 0 for i in range(len(streams))) >= 25
    assert want[-1] == streams[-1][0]  # five copies of one page stay


def test_articles_keep_what_they_quote(spark):
    r = random.Random(5)
    licence, banner = words(r, 40), words(r, 40)
    own = [words(r, 200) for _ in range(20)]
    page = lambda *ps: "<article>" + "".join(f"<p>{p}</p>" for p in ps) + "</article>"
    rows = [(i, "http://a.example/", page(t, licence) if i < 6 else page(t)) for i, t in enumerate(own)]
    rows += [(100 + i, "http://b.example/", page(banner, t)) for i, t in enumerate(own[:6])]
    near = words(r, 100)
    rows += [(200 + i, "http://c.example/", page(near, f"end {i}")) for i in range(4)]
    got = {x["page_id"]: x["text"] for x in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == (f"{t}\n{licence}" if i < 6 else t) for i, t in enumerate(own))
    assert all(got[100 + i] == t for i, t in enumerate(own[:6]))
    assert all(got[200 + i] == f"{near}\nend {i}" for i in range(4))


def test_names_of_sections(spark):
    kept = ['id="related-work"', 'class="social-history"', 'class="research"', 'class="share-of-income"']
    gone = ['class="related-posts"', 'id="cookie-banner"', 'class="social"', 'class="share-buttons"', 'id="comments"', 'class="x ad-2"', 'role="search"']
    rows = [(i, None, f"<div {a}>some text</div><p>rest</p>") for i, a in enumerate(kept + gone)]
    got = {x["page_id"]: x["text"] for x in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(rows))] == ["some text\nrest"] * len(kept) + ["rest"] * len(gone)


def test_edges(spark):
    long = "<p>" + " ".join(f"t{i}" for i in range(300_000))
    rows = [(None, None, None), (1, "x", ""), (1, "x", "<p>a"), (1, "x", "<p>a"), (2, "http://h/", long)]
    pages = spark.createDataFrame([(*x, "k", 1) for x in rows], SCHEMA + ", k1 string, known int")
    got = sorted(((x["page_id"] or 0, len(x["text"])) for x in html.extract(pages).collect()))
    assert got == [(0, 0), (1, 0), (1, 1), (1, 1), (2, len(long) - 3)]
    assert html.extract(pages.where("false")).count() == 0
