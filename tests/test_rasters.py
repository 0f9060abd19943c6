"""Pixels against plain loops: regions, shares, angles; odd rasters."""

from __future__ import annotations

import random

import numpy as np

from tallyforge.sources import rasters


def plain_regions(dark, least, gap):
    """Boxes of linked runs, by repeated merging."""
    groups = []
    for y, row in enumerate(dark):
        x = 0
        while x < len(row):
            if row[x]:
                a = x
                while x < len(row) and row[x]:
                    x += 1
                if x - a >= least:
                    near = [g for g in groups if any(0 < y - q <= gap + 1 and p < x and a < e for q, p, e in g)]
                    for g in near:
                        groups.remove(g)
                    groups.append([r for g in near for r in g] + [(y, a, x)])
            else:
                x += 1
    return groups


def test_regions_and_shares():
    r = random.Random(5)
    for _ in range(40):
        grey = np.full((60, 80), 255, dtype=np.uint8)
        for _ in range(r.randint(0, 7)):
            x, y = r.randint(0, 70), r.randint(0, 55)
            grey[y : y + r.randint(1, 25), x : x + r.randint(1, 50)] = r.choice([0, 30, 90])
        grey[np.random.default_rng(r.randint(0, 99)).random((60, 80)) < 0.01] = 0
        dark = grey < 60
        want = []
        for g in plain_regions(dark, 8, 2):
            y0, y1, x0, x1 = min(q for q, *_ in g), max(q for q, *_ in g) + 1, min(p for _, p, _ in g), max(e for *_, e in g)
            if y1 - y0 >= 10 and dark[y0:y1, x0:x1].mean() >= 0.55:
                want.append((x0, y0, x1, y1))
        assert rasters.dark_boxes(grey, 1.0) == sorted(want)
        boxes = np.array([[r.uniform(-5, 80), r.uniform(-5, 60), 0, 0] for _ in range(20)])
        boxes[:, 2:] = boxes[:, :2] + np.array([[r.uniform(0, 30), r.uniform(0, 30)] for _ in range(20)])
        for (x0, y0, x1, y1), got in zip(boxes, rasters.shares(grey, boxes)):
            own = dark[max(0, int(np.floor(y0))) : max(0, int(np.ceil(y1))), max(0, int(np.floor(x0))) : max(0, int(np.ceil(x1)))]
            assert got == (own.mean() if own.size else 0)


def test_skew():
    for angle in (-4.8, -0.35, 0.0, 0.5, 2.15, 5.0):
        grey, x = np.full((420, 600), 255, dtype=np.uint8), np.arange(50, 550)
        for line in range(60, 380, 30):
            grey[np.rint(line + (x - 300) * np.tan(np.radians(angle))).astype(int), x] = 0
        assert abs(rasters.skew_angle(grey) - angle) <= 0.1
        assert abs(rasters.skew_angle(rasters.straightened(grey, rasters.skew_angle(grey)))) <= 0.15
    assert rasters.skew_angle(np.zeros((0, 0))) == rasters.skew_angle(np.full((50, 50), 255, dtype=np.uint8)) == 0.0


def test_odd_rasters(spark):
    white = bytes([255]) * 400
    rows = [("a", 1, 20, 20, 1.0, bytes(400)), ("b", 1, 20, 20, 1.0, b"short"), ("c", 1, 20, 20, 1.0, None), ("d", 1, 0, 0, 1.0, b""), ("e", 1, 20, 20, 1.0, white)]
    pages = spark.createDataFrame(rows, rasters.RASTERS)
    assert [tuple(r) for r in rasters.dark_regions(pages).collect()] == [("a", 1, 0.0, 0.0, 20.0, 20.0)]
    words = spark.createDataFrame([(k, 1, 1, 1.0, 1.0, w, 5.0, "x") for k in "abcdef" for w in (6.0, None, 0.5)], "statement_id string, page int, word_idx int, x double, y double, width double, height double, text string")
    got = {(r["statement_id"], r["width"]): (r["redacted"], r["scanned"]) for r in rasters.occluded(words, pages).collect()}
    assert len(got) == 18 and {k for k, v in got.items() if v[0]} == {("a", 6.0)} and {k for (k, _), v in got.items() if v[1]} == {"a", "e"}
    assert {r["statement_id"]: r["angle"] for r in rasters.skew(pages).collect()} == dict.fromkeys("abcde", 0.0)
    assert rasters.deskewed(pages).where("grey is null or length(grey) in (0, 5, 400)").count() == 5
    empty = pages.where("false")
    assert rasters.dark_regions(empty).count() == rasters.skew(empty).count() == rasters.deskewed(empty).count() == 0


def test_few_pages_at_once(spark):
    """A task never holds the pixels of more than a few pages: painted, read or handed on."""
    import pandas as pd

    from tallyforge.plans import scans

    sheets = pd.DataFrame({"statement_id": [str(k) for k in range(40)], "angle": [0.5] * 40})
    assert [len(part) for part in scans.tilted([sheets])] == [16, 16, 8]
    white = bytes([255]) * 400
    pages = spark.createDataFrame([(str(k), 1, 20, 20, 1.0, bytes(400) if k % 2 else white) for k in range(40)] + [("n", 1, 20, 20, 1.0, None)], rasters.RASTERS).coalesce(1)
    held = {r["statement_id"]: r["mask"] for r in rasters.masks(pages).collect()}
    assert held["n"] is None and all(len(m) < 60 for k, m in held.items() if k != "n")
    assert rasters.as_mask(held["1"], 20, 20).all() and not rasters.as_mask(held["0"], 20, 20).any() and rasters.as_mask(None, 20, 20).size == 0


def test_straightness_is_skew_before_and_after(spark):
    from tallyforge.plans import scans

    angles = [-4.0, -0.3, 0.0, 0.25, 0.35, 3.5]
    pages = spark.createDataFrame([(str(k), a) for k, a in enumerate(angles)], "statement_id string, angle double").mapInPandas(scans.tilted, rasters.RASTERS)
    plain = lambda df, c: {r["statement_id"]: r[c] for r in df.collect()}
    found = rasters.straightness(pages)
    assert plain(found, "angle") == plain(rasters.skew(pages), "angle")
    assert plain(found, "left") == plain(rasters.skew(rasters.deskewed(pages)), "angle")


def test_skew_angles_joins_nothing(spark, tmp_path):
    """Two searches joined were sent to all executors, and the wait for that ended the query on larger tables."""
    from tallyforge.plans import scans

    spark.range(3).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    found = scans.skew_angles(spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("0", -4.0, 0.0), ("1", -3.5, 0.0), ("2", -3.0, 0.0)]


def tables(spark, folder, n=4):
    flags = "element_at(array('R', 'A', 'N'), cast(id % 3 + 1 as int))"
    spark.range(5 * n).selectExpr("id % cast({} as bigint) as l_orderkey".format(n), "id * 7 as l_partkey", "id * 31 as l_suppkey", "cast(id div {} as int) as l_linenumber".format(n), "id * 1.5d as l_extendedprice", f"{flags} as l_returnflag").write.parquet(f"{folder}/lineitem.parquet")


def python_steps(found):
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow") + plan.count("MapInPandas"), "grey" in plan


def test_dark_regions_are_found_where_pages_are_painted(spark, tmp_path):
    """Pixels went from one Python step to another, 128 KB a page; now a page is painted and read in one."""
    from tallyforge.plans import scans

    tables(spark, tmp_path)
    found = scans.dark_regions(spark, str(tmp_path))
    assert python_steps(found) == (1, False)
    rows = [(r, b) for r in scans.boxes(spark, str(tmp_path)).collect() for b in r["b"]]
    want = sorted((r["statement_id"], 1, b["x"] / 2, b["y"] / 2, (b["x"] + w) / 2, b["y"] / 2 + 12) for r, b in rows for w in [b["w"] if b["f"] == "R" else b["w"] * 45 // 100] if b["f"] == "R" or b["f"] == "A" and w >= 40)
    assert len(rows) == 20 and sorted(map(tuple, found.collect())) == want


def test_occluded_words_are_looked_up_where_pages_are_painted(spark, tmp_path):
    from tallyforge.plans import scans

    tables(spark, tmp_path)
    found = scans.occluded_words(spark, str(tmp_path))
    assert python_steps(found) == (1, False)
    want = sorted((r["statement_id"], b["n"], b["f"] == "R", True) for r in scans.boxes(spark, str(tmp_path)).collect() for b in r["b"])
    assert sorted(map(tuple, found.collect())) == want
    # a page without a sheet has no raster, and the others still meet their own
    pages = scans.boxes(spark, str(tmp_path))
    words = spark.createDataFrame([(k, 1, 1, 20.0, 20.0, 20.0, 8.0, "x") for k in "0x13"], "statement_id string, page int, word_idx int, x double, y double, width double, height double, text string")
    assert {r["statement_id"]: r["scanned"] for r in rasters.occluded(words, pages, render=scans.paint).collect()} == {"0": True, "x": False, "1": True, "3": True}


def test_stretches_and_counts_are_those_of_single_rows():
    r = np.random.default_rng(3)
    for width in (37, 64):
        for _ in range(20):
            grey = np.repeat((r.random((12, width)) < 0.3) * np.uint8(255), r.integers(1, 4, 12), axis=0)
            dark = grey < 60
            want = [(y, x, x + n) for y, row in enumerate(dark) for x in range(width) if row[x] and not (x and row[x - 1]) for n in [int(np.argmin(np.append(row[x:], False)))] if n >= 5]
            assert sorted((y, a, b) for top, bottom, a, b in rasters.stretches(grey, 5, 60) for y in range(top, bottom)) == want
            boxes = [tuple(int(v) for v in r.integers(-5, 45, 4)) for _ in range(200)]
            assert rasters.dark_parts(grey, boxes[:2], 60) == rasters.dark_parts(dark, boxes)[:2]


def test_ink_angle_is_the_plain_search():
    r = np.random.default_rng(8)
    for k in range(3):
        grey = np.where(r.random((160, 203)) < 0.03, 0, 255).astype(np.uint8)
        x = np.arange(20, 180)
        for line in range(20, 140, 15):
            grey[np.rint(line + (x - 100) * np.tan(np.radians((k - 1) * 2.35))).astype(int), x] = 0
        y, x = np.nonzero(grey < rasters.INK)
        best, score = 0.0, -1.0
        for a in sorted((i * 0.05 for i in range(-100, 101)), key=lambda a: (abs(a), a)):
            level = np.floor(y - x * np.tan(np.radians(a))).astype(int)
            own = (np.bincount(level - level.min()).astype(float) ** 2).sum()
            if own > score:
                best, score = a, own
        assert rasters.skew_angle(grey) == round(best, 2)


def test_pictures_that_come_again_are_searched_once(spark, tmp_path):
    """Every page was searched at 201 angles twice, its copies too, and its pixels went from one Python step to another."""
    from tallyforge.plans import scans

    rasters._angles.cache_clear()
    page = np.full((60, 80), 255, dtype=np.uint8)
    page[20:24] = 0
    assert [rasters.angles(page.copy(), 0.3) for _ in range(5)] == [(0.0, 0.0)] * 5 and rasters._angles.cache_info().misses == 1
    page[30:34] = 0
    rasters.angles(page, 0.3), rasters.angles(page.T, 0.3)
    assert rasters._angles.cache_info().misses == 3
    spark.range(3).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert python_steps(scans.skew_angles(spark, str(tmp_path))) == (1, False)
