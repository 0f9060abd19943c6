"""SimHash, suffix index, classifier, rules, languages: against brute force, with odd rows among the input."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tallyforge.llm import langid, quality, rules, simhash, suffixes

DOCS = "doc_id long, text string, lang string, source string, __found string, fp long"
ODD = [None, "", " \n ", "one", "one two", "Ünï çödé wörds hère", "a" * 3000, "x y " * 900, "line\nline\n\nline"]


def sample(n=60, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts = list(ODD)
    for _ in range(n):
        own = [r.choice(words) for _ in range(r.randint(5, 160))]
        texts.append(" ".join(own))
        if r.random() < 0.4:
            own[r.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
        if r.random() < 0.2:
            texts.append(texts[-1])
    return texts


def table(spark, texts):
    rows = [(i * 3, t, None if i % 7 == 0 else ("en", "fr")[i % 2], None if i % 11 == 0 else f"s{i % 3}", "clash", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id here at all", "en", "s1", "", 0)], DOCS)


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_against_all_pairs(spark):
    texts = sample()
    prints = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    expected = union(len(texts), pairs)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert len(got) == len(texts) + 1 and got[None]["component_id"] is not None or got[None]["doc_id"] is None
    assert [got[i * 3]["fp"] % (1 << 64) for i in range(len(texts))] == prints
    assert [got[i * 3]["component_id"] for i in range(len(texts))] == [3 * e for e in expected]


def test_trees_part_no_near_pair():
    r = np.random.default_rng(3)
    prints = r.integers(0, 1 << 63, 6000, dtype=np.uint64)
    near = prints[:2000].copy()
    for _ in range(3):
        near ^= np.uint64(1) << r.integers(0, 64, 2000, dtype=np.uint64)
    whole = np.concatenate((prints, near))
    trees = [simhash.Tree(shift, 5, whole[::7]) for shift in (0, 32)]
    together = np.zeros(2000, dtype=bool)
    for tree in trees:
        leaves, rows = tree.shards(whole)
        assert len(rows) < 3 * len(whole) and len(set(leaves.tolist())) > 8
        places = {}
        for leaf, row in zip(leaves.tolist(), rows.tolist()):
            places.setdefault(row, set()).add(leaf)
        together |= np.array([bool(places[i] & places[6000 + i]) for i in range(2000)])
    assert together.all()


def test_keep_one(spark):
    kept = simhash.keep_one(table(spark, ["a b c d", "a b c d", "other words stand here"]))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 6] and kept.columns[:4] == ["doc_id", "text", "lang", "source"]


def removed(texts, span):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + span] for b in data for i in range(len(b) - span + 1))
    out = []
    for b in data:
        mask = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                mask[i] += 1
                mask[i + span] -= 1
        gone = np.cumsum(mask)[: len(b)] > 0
        out.append((len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot_rows", [200_000, 1])
def test_suffixes_against_all_strings(spark, monkeypatch, hot_rows):
    r = random.Random(5)
    passage = " ".join(f"w{r.randint(0, 99)}" for _ in range(60))
    texts = [*sample(25), *(f"{i} {passage[: 150 + i]} tail {i}" for i in range(12)), passage * 2]
    real = suffixes.repeated_spans
    monkeypatch.setattr(suffixes, "repeated_spans", lambda docs, span, head, batches: real(docs, span, head, batches, hot_rows))
    docs = table(spark, texts).where("doc_id is not null")
    got = {r["doc_id"]: r for r in suffixes.without_repeats(docs, span=60).collect()}
    found = [(got[i * 3]["n_bytes"], sum(s["end"] - s["start"] for s in got[i * 3]["spans"]), hashlib.sha256(bytes(got[i * 3]["kept"])).hexdigest()) for i in range(len(texts))]
    assert found == removed(texts, 60)


def test_long_texts_are_read_in_blocks(monkeypatch):
    r = random.Random(2)
    text = "".join(r.choice("ab ") for _ in range(5000)).encode()
    whole = suffixes.places([text], 60, 20)
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    for a, b in zip(whole, suffixes.places([text], 60, 20)):
        assert (a == b).all()


def test_a_level_index_grows_geometrically(spark):
    index = suffixes.LevelIndex(spark)
    rows = [spark.createDataFrame([(h,) for h in batch], "h long") for batch in ([1, 2], [2, 3], [4], [4, 1, 5, 5])]
    hits = [sorted(r["h"] for r in index.add(b).collect()) for b in rows]
    assert hits == [[], [2], [], [1, 4, 5]] and [rank for rank, _, _ in index.levels] == [2]
    index.drop()


def test_classifier(spark):
    r = random.Random(4)
    texts, labels = list(ODD), []
    for i in range(300):
        good = r.random() < 0.7
        words = ["".join(r.choice("abcdeo") for _ in range(r.randint(2, 8))) for _ in range(r.randint(10, 60))]
        texts.append(" ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words))
        labels.append(((i + len(ODD)) * 3, int(good)))
    docs = table(spark, texts)
    marks = spark.createDataFrame([*labels, (None, 1), (0, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, marks).collect()}
    held = [(d, q) for d, q in labels if got[d]["held_out"]]
    assert len(held) > 50 and np.mean([got[d]["predicted"] == q for d, q in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(texts) + 1
    none = quality.quality_scores(docs, marks.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(docs.where("false"), marks).count() == 0


def test_interactions_need_pairs():
    r = np.random.default_rng(0)
    x = r.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert {0, 1} == set(model.pairs[0][:2]) and ((model.score(x) >= 0.5) == y).mean() > 0.9


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    twice = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice)


def test_rules(spark):
    texts = [*sample(80), *(" ".join(f"{w}###" for w in t.split()) for t in sample(8, 9)[len(ODD) :])]
    rows = {r["doc_id"]: r for r in rules.verdicts(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        own = rows[i * 3]
        n, *rest = counts(t)
        assert (own["n_words"], own["word_chars"], own["n_symbols"], own["n_dup_lines"], own["n_repeat_words"]) == (n, *rest), t
        assert own["base_failed"] == (n < 50 or 100 * rest[3] > 50 * n)
    marked = [rows[i * 3] for i, t in enumerate(texts) if t and "###" in t and not rows[i * 3]["base_failed"]]
    plain = [rows[i * 3] for i, t in enumerate(texts) if t and "###" not in t and not rows[i * 3]["base_failed"]]
    assert marked and not any(r["kept"] for r in marked) and all(r["kept"] for r in plain)
    assert rules.verdicts(table(spark, texts).where("false")).count() == 0
    assert not any(r["kept"] for r in rules.verdicts(table(spark, ["short", None])).collect())


def test_languages(spark):
    r = random.Random(8)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(30))
    texts = [*ODD, "123 456 !", *(make(("aeioubcd", "éèàuostr")[i % 2]) for i in range(80))]
    first = len(ODD) + 1
    rows = [(i, t, None if i < first else ("en", "fr")[(i - first) % 2]) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, len(ODD)))
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows[first:])
    empty = langid.identify(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).first()
    assert empty["lang_pred"] == "und"


def test_probabilities_sum_to_one():
    code, sizes = langid.codes(["some words, more words and words", "x"])
    seen, n = np.unique(code, return_counts=True)
    model = langid.train(np.array(["en"] * len(seen), dtype=object), seen.astype(np.int64), n)
    for context in (0, int(seen[3]) >> 6, 1234):
        assert abs(np.exp(model.log_table(np.arange(context * 64, context * 64 + 64))).sum() - 1) < 1e-3
