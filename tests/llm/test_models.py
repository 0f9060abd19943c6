"""Kneser-Ney against dictionaries, the forest's CASE expressions against a walk of its trees."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import langid, secrets


def symbols(text):
    """The symbols of a text with both ends marked, runs of what is not a letter as one 0."""
    own = [langid.symbol(c) for c in text]
    out = [0]
    for s in [*own, 0]:
        if s or out[-1]:
            out.append(s)
    return out[1:]


def naive_entropy(train, text):
    """Cross-entropy per symbol of a text under an interpolated Kneser-Ney model of four symbols, by dictionaries."""

    def grams(t):
        own = [0, 0, 0, *symbols(t)]
        return [tuple(own[i : i + 4]) for i in range(len(own) - 3)]

    four = Counter(g for t in train for g in grams(t))
    three = Counter(g[1:] for g in four)
    two = Counter(g[1:] for g in three)
    one = Counter(g[1:] for g in two)

    def discount(counts):
        a, b = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
        return a / (a + 2 * b) if a else 0.5

    def prob(g):
        counts = {4: four, 3: three, 2: two, 1: one}[len(g)]
        rest = prob(g[1:]) if len(g) > 1 else 1 / langid.SYMBOLS
        same = {k: n for k, n in counts.items() if k[:-1] == g[:-1]}
        total, d = sum(same.values()), discount(counts)
        if not total:
            return rest
        return max(same.get(g, 0) - d, 0) / total + d * len(same) / total * rest

    own = grams(text)
    return -sum(math.log(prob(g)) for g in own) / len(own)


def test_kneser_ney_against_dictionaries():
    r = random.Random(2)
    texts = {lang: [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(12)) for _ in range(6)] for lang, letters in (("aa", "abcdeé"), ("bb", "xyzwqß"))}
    lang, code, count = [], [], []
    for name, own in texts.items():
        c, n = np.unique(langid.codes(own)[0], return_counts=True)
        lang += [name] * len(c)
        code += c.tolist()
        count += n.tolist()
    model = langid.train(np.array(lang, dtype=object), np.array(code, dtype=np.int64), np.array(count, dtype=np.int64))
    asked = [texts["aa"][0], "abc xyz", "unseen words, 12!", "é", "bad cab"]
    got = model.entropies(asked)
    for i, t in enumerate(asked):
        for k, name in enumerate(model.langs):
            assert abs(got[i, k] - naive_entropy(texts[name], t)) < 1e-4, (t, name)


def walk(text, x):
    """The prediction of a tree in Spark's text, line by line."""
    lines = text.strip("\n").split("\n")
    at, depth = 0, len(lines[0]) - len(lines[0].lstrip())
    while True:
        line = lines[at].strip()
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        f, op, value = re.match(r"(?:If|Else) \(feature (\d+) (<=|>) (.+)\)", line).groups()
        holds = x[int(f)] <= float(value) if op == "<=" else x[int(f)] > float(value)
        if holds:
            at += 1
            depth = len(lines[at]) - len(lines[at].lstrip())
        else:
            at = next(i for i in range(at + 1, len(lines)) if len(lines[i]) - len(lines[i].lstrip()) == depth)


def test_forest_as_expressions(spark):
    trees = secrets.forest(spark, trees=4, depth=4)
    r = random.Random(1)
    rows = [[round(r.choice([0.0, 1.0, r.random(), r.uniform(0, 80)]), 4) for _ in secrets.FEATURES] for _ in range(300)]
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id int, " + ", ".join(f"{f} double" for f in secrets.FEATURES))
    x = F.struct(*secrets.FEATURES)
    got = sorted(table.select("id", *(secrets.tree_case(t, x).alias(f"t{k}") for k, t in enumerate(trees))).collect())
    for row, own in zip(got, rows):
        assert list(row[1:]) == [walk(t, own) for t in trees]
    assert len({tuple(row[1:]) for row in got}) > 3
