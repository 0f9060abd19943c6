"""Quality rules: the estimates against NumPy, single extremes, and odd inputs."""

from __future__ import annotations

import json
import random

import numpy as np

from tallyforge.llm import rules


def text(r, words=None, size=5, symbols=0, lines=0, repeats=0):
    own = ["".join(r.choice("abcdefghijklmnop") for _ in range(max(1, int(r.gauss(size, 1.2))))) for _ in range(words or int(r.lognormvariate(5.3, 0.5)) + 60)]
    for _ in range(symbols):
        own[r.randrange(len(own))] += "#"
    out = "\n".join(" ".join(own[i : i + 12]) for i in range(0, len(own), 12))
    return out + f"\n{own[0]}" * lines + (" " + " ".join(own[:3])) * repeats


def numpy_distances(rows):
    """Squared distance of each row (lang, source, five counts, failed) by the same estimates."""
    x = np.array([[np.rint(v * rules.UNIT) for v in (
        np.log((c + 1) / (n + 1)), np.log(1 + 100 * s / max(c, 1)), np.log(1 + 10 * p / max(n, 1)), np.log(1 + d), np.log(1 + n))] for _, _, n, c, s, d, p, _ in rows])
    ok = np.array([not r[-1] for r in rows])
    floors = np.array([rules._floor(i) ** 2 for i in range(rules.P)])

    def root(c):
        c = c.copy()
        np.fill_diagonal(c, np.maximum(np.diag(c), floors))
        return np.linalg.cholesky(c)

    def away(m, c, y):
        return (np.linalg.solve(root(c), (y - m).T) ** 2).sum(axis=0)

    def mcd(y):
        m = np.median(y, axis=0)
        best = None
        for start in ((m, np.diag((1.4826 * np.median(np.abs(y - m), axis=0)) ** 2)), (y.mean(axis=0), np.cov(y.T, bias=True))):
            own = start
            for _ in range(12):
                bins = np.floor(64 * np.log2(1 + away(*own, y)))
                near = y[bins <= np.sort(bins)[int(np.ceil(rules.SHARE * len(bins))) - 1]]
                new = near.mean(axis=0), rules.CONSISTENCY * np.cov(near.T, bias=True)
                same = np.allclose(new[1], own[1])
                own, n = new, len(near)
                if same:
                    break
            det = 2 * np.log(np.diag(root(own[1]))).sum()
            if best is None or det < best[0] - 1e-9:
                best = det, own, n
        return best[1], best[2]

    def towards(found, above):
        own, n = found
        w = n / (n + rules.SHRINK)
        return tuple(w * a + (1 - w) * b for a, b in zip(own, above))

    langs, both = np.array([str(r[0]) for r in rows]), np.array([json.dumps(r[:2]) for r in rows])
    whole = mcd(x[ok])[0]
    by_lang = {k: towards(mcd(x[ok & (langs == k)]), whole) for k in set(langs[ok])}
    out = np.zeros(len(rows))
    for k in set(both):
        mine = both == k
        lang = langs[mine][0]
        model = by_lang.get(lang, whole)
        if (ok & mine).any():
            model = towards(mcd(x[ok & mine]), model)
        out[mine] = away(*model, x[mine])
    return out


def corpus(r):
    rows = []
    for lang, source, n, size in (("en", "a", 150, 5), ("en", "b", 40, 6), ("de", "a", 120, 9), ("de", None, 5, 9), (None, "a", 1, 5)):
        rows += [(lang, source, text(r, size=size, lines=r.choice([0, 0, 0, 1]), symbols=r.choice([0, 0, 1, 3]))) for _ in range(n)]
    return rows


def test_distances_against_numpy(spark):
    r = random.Random(3)
    rows = corpus(r) + [("en", "a", text(r, symbols=400)) for _ in range(12)]
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, lang string, source string, text string")
    got = {x["doc_id"]: x for x in rules.verdicts(docs).collect()}
    counts = [(rows[i][0], rows[i][1], *(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for i in range(len(rows))]
    want = numpy_distances(counts)
    have = np.array([got[i]["distance"] for i in range(len(rows))])
    assert np.allclose(have, want, rtol=1e-6, atol=1e-6), np.abs(have - want).max()
    assert not any(got[i]["kept"] for i in range(len(rows) - 12, len(rows)))
    assert np.mean([got[i]["kept"] for i in range(len(rows) - 12)]) > 0.97
    assert abs(rules.quantile(0.999, 5) - 20.515) < 1e-3 and abs(rules.CONSISTENCY - 1.412) < 2e-3


def test_one_extreme_statistic_is_enough(spark):
    r = random.Random(4)
    rows = [("en", "a", text(r, symbols=r.choice([0, 1, 2]))) for _ in range(200)]
    odd = [text(r, words=200, size=16), text(r, words=200, symbols=60), text(r, words=200, repeats=55), text(r, words=200, lines=9), text(r, words=12_000)]
    rows += [("en", "a", t) for t in odd]
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, lang string, source string, text string")
    got = {x["doc_id"]: x for x in rules.verdicts(docs).collect()}
    assert [got[200 + k]["base_failed"] for k in range(5)] == [False] * 5
    assert [got[200 + k]["kept"] for k in range(5)] == [False] * 5, [got[200 + k]["distance"] for k in range(5)]


def test_odd_inputs(spark):
    r = random.Random(5)
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, None, None, None), (1, "xx", "s", ""), (2, "xx", "s", long), (2, "xx", "s", long), (3, "en", "a", text(r)), (4, "en", "a", "b " * 60)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, lang string, source string, text string, grp int, __words int")
    got = sorted(((x["doc_id"] or 0, x["n_words"], x["n_repeat_words"], x["base_failed"]) for x in rules.verdicts(docs).collect()))
    assert got[:4] == [(0, 0, 0, True), (1, 0, 0, True), (2, 60_000, 0, False), (2, 60_000, 0, False)] and got[5] == (4, 60, 60, True)
    assert rules.verdicts(docs.where("false")).count() == 0
    assert rules.verdicts(docs.where("doc_id = 1")).first()["kept"] is False
