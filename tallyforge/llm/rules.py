"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates. DataFrame functions only.

Each document is a vector of transformed statistics. For each language and source, each language, and all rows,
concentration steps look for the three quarters of the rows whose covariance has the least determinant: from two starts
(medians with median deviations; means and covariances of all rows), means and covariances are taken of the rows nearest
to the last estimate, until the determinants stay. The better of the two is kept. A group's estimate is shrunk towards
its language's, and that towards the one of all rows, by n / (n + SHRINK), so small groups need no rule of their own. A
document is rejected when its squared Mahalanobis distance exceeds a quantile of the chi-square distribution.

The statistics are integers (multiples of 1/256) and so are their sums, so results do not depend on the order of rows; a
sum of products holds 10 ** 11 rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

SYMBOLS = r"[#*$%&|<>]"
UNIT = 256
#: The vector: name, value from the counts, and the least spread that a group is taken to have: it only keeps a group
#: without variation in a statistic (no repeated line at all, say) from rejecting the first row that has any.
STATS = [
    ("word_len", "ln((word_chars + 1) / (n_words + 1.0D))", 0.08),
    ("symbol", "ln(1 + 100.0D * n_symbols / greatest(word_chars, 1))", 0.25),
    ("repeats", "ln(1 + 10.0D * n_repeat_words / greatest(n_words, 1))", 0.25),
    ("lines", "ln(1.0D + n_dup_lines)", 0.35),
    ("size", "ln(1.0D + n_words)", 0.50),
]
P = len(STATS)
SHARE, SHRINK = 0.75, 50


def chi_square(x: float, k: int) -> float:
    """Distribution function of chi-square with an odd number k of degrees of freedom."""
    out = math.erf(math.sqrt(x / 2))
    for i in range(1, k, 2):
        out -= (x / 2) ** (i / 2) * math.exp(-x / 2) / math.gamma(i / 2 + 1)
    return out


def quantile(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        low, high = ((low + high) / 2, high) if chi_square((low + high) / 2, k) < share else (low, (low + high) / 2)
    return high


#: The factor that makes the spread of the nearest share of normal rows stand for all of them.
CONSISTENCY = SHARE / chi_square(quantile(SHARE, P), P + 2)


def with_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The five counts of every whole text, beside the columns `keep`. A null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(*keep, text.alias("__text")).withColumn("__words", F.array_remove(F.split("__text", r"[\x20\x09-\x0D]+"), ""))
    step = step.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD)))
    step = step.select(
        *keep, "__words", F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    window = lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2))
    hashes = F.transform(F.sequence(F.lit(0), F.size("__words") - 3), window)
    step = step.withColumn("__hashes", F.when(F.size("__words") >= 3, hashes).otherwise(F.array().cast("array<bigint>"))).drop("__words")
    # only a text with a repeat is sorted: that brings equal windows together
    keys = F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    step = step.withColumn("__keys", F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), keys).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))).drop("__hashes")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter("__keys", lambda x, j: same(x, F.get("__keys", j - 1)) | same(x, F.get("__keys", j + 1)))
    step = step.withColumn("__places", F.sort_array(F.transform(twice, lambda x: x["p"].cast("long")))).drop("__keys")
    gaps = F.transform("__places", lambda p, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get("__places", j + 1) - p, F.lit(3).cast("long"))))
    return step.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("__places")


def _vector() -> list[Column]:
    return [F.round(F.expr(value) * UNIT).cast("long").alias(f"x{i}") for i, (_, value, _) in enumerate(STATS)]


def _floor(i: int) -> float:
    return STATS[i][2] * UNIT


def _far() -> list[tuple[str, Column]]:
    """Forward substitution with the Cholesky root: z_i in turn, then their squares' sum."""
    out = []
    for i in range(P):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}_{j}") * F.col(f"z{j}")
        out.append((f"z{i}", z / F.col(f"l{i}_{i}")))
    return out


def _with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance d2; null where a group has no estimate, as when no row passed the base rule."""
    rows = rows.join(estimate, "grp", "left")
    for name, z in _far():
        rows = rows.withColumn(name, z)
    rows = rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0")))
    return rows.drop(*(f"z{i}" for i in range(P)), *(c for c in estimate.columns if c != "grp"))


def _nearest(rows: DataFrame) -> DataFrame:
    """The rows of each group up to the distance that SHARE of them reach; distances in steps of 1/64 of a doubling."""
    rows = rows.withColumn("bin", F.floor(64 * F.log2(1 + F.col("d2"))).cast("int"))
    counts = rows.groupBy("grp", "bin").agg(F.count("*").alias("k"))
    group = Window.partitionBy("grp")
    upto = F.sum("k").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.select("grp", "bin", (upto >= F.ceil(SHARE * F.sum("k").over(group))).alias("enough"))
    edge, _ = materialise(reached.where("enough").groupBy("grp").agg(F.min("bin").alias("edge")), "mcd-edge")
    return rows.join(edge, "grp").where("bin <= edge")


CELLS = [(i, j) for i in range(P) for j in range(i + 1)]
MOMENTS = [*(f"m{i}" for i in range(P)), *(f"c{i}_{j}" for i, j in CELLS)]


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """n, means m and covariances c of each group, these times `factor`."""
    exact = lambda c: F.sum(c).cast("double")
    sums = [exact(F.col(f"x{i}")).alias(f"s{i}") for i in range(P)] + [exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in CELLS]
    out = rows.groupBy("grp").agg(F.count("*").cast("double").alias("n"), *sums)
    out = out.select("grp", "n", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)), *(f"s{i}_{j}" for i, j in CELLS))
    return out.select("grp", "n", *(f"m{i}" for i in range(P)), *((factor * (F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))).alias(f"c{i}_{j}") for i, j in CELLS))


def _rooted(moments: DataFrame) -> DataFrame:
    """The means, the Cholesky root l of the covariance, and its log determinant; no spread is below its floor."""
    out = moments
    for i, j in CELLS:
        cell = F.greatest(F.col(f"c{i}_{i}"), F.lit(_floor(i) ** 2)) if i == j else F.col(f"c{i}_{j}")
        for k in range(j):
            cell = cell - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(cell, F.lit(1.0))) if i == j else cell / F.col(f"l{j}_{j}"))
    return out.withColumn("logdet", sum((2 * F.ln(f"l{i}_{i}") for i in range(1, P)), 2 * F.ln("l0_0")))


def _estimate(moments: DataFrame) -> DataFrame:
    return materialise(_rooted(moments).select("grp", *(f"m{i}" for i in range(P)), *(f"l{i}_{j}" for i, j in CELLS)), "mcd")[0]


def estimates(rows: DataFrame, most_steps: int = 12) -> DataFrame:
    """MCD moments (n, m0.., c0_0..) for each grp of rows(grp, x0..). After `most_steps` the steps end in any case."""
    name = lambda k: F.concat(F.lit(f"{k}:"), F.col("grp")).alias("grp")
    middle, _ = materialise(rows.groupBy("grp").agg(*(F.percentile(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in range(P))), "mcd-med")
    off = rows.join(middle, "grp").select("grp", *(F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"x{i}") for i in range(P)))
    spread = off.groupBy("grp").agg(*((1.4826 * F.percentile(f"x{i}", F.lit(0.5))).alias(f"d{i}") for i in range(P)))
    cells = [(F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in CELLS]
    medians = middle.join(spread, "grp").select(name(0), *(f"m{i}" for i in range(P)), *cells)
    now = _estimate(medians.unionByName(_moments(rows, 1.0).select(name(1), *MOMENTS)))
    both = rows.select(F.explode(F.array(*(name(k) for k in (0, 1)))).alias("grp"), *(f"x{i}" for i in range(P)))
    last, done, active = now.select("grp", F.lit(None).cast("long").alias("last")), [], both
    for step in range(most_steps):
        found = _rooted(_moments(_nearest(_with_distance(active, now)), CONSISTENCY)).select("grp", "n", *MOMENTS, "logdet", F.round(F.col("logdet") * 1e6).cast("long").alias("mark"))
        found, _ = materialise(found.join(last, "grp").withColumn("still", F.coalesce(F.col("mark") == F.col("last"), F.lit(False))), "mcd-moments")
        done.append(found.where("still") if step < most_steps - 1 else found)
        left = found.where("not still")
        if not left.head(1):
            break
        # groups that stay as they are need no further step
        now, last = _estimate(left), left.select("grp", F.col("mark").alias("last"))
        active = both.join(last.select("grp"), "grp", "left_semi")
    ended = done[0]
    for part in done[1:]:
        ended = ended.unionByName(part)
    best = ended.groupBy(F.substring("grp", 3, 1 << 30).alias("own")).agg(F.min_by(F.struct("n", *MOMENTS), F.struct("logdet", "grp")).alias("b"))
    return materialise(best.select(F.col("own").alias("grp"), "b.*"), "mcd-best")[0]


def shrunk(own: DataFrame, parents: DataFrame) -> DataFrame:
    """Moments of each group drawn towards its parent's: own(grp, parent, n, ..), parents(grp, ..)."""
    above = parents.select(F.col("grp").alias("parent"), F.struct(*MOMENTS).alias("p"))
    weight = F.col("n") / (F.col("n") + SHRINK)
    both = own.join(above, "parent")
    return both.select("grp", "n", *((weight * F.col(c) + (1 - weight) * F.col(f"p.{c}")).alias(c) for c in MOMENTS))


def verdicts(docs: DataFrame, confidence: float = 0.9999, min_words: int = 50) -> DataFrame:
    """doc_id, the five counts, base_failed, distance (squared Mahalanobis) and kept for every row of `docs`.

    A document fails the base rule with fewer than `min_words` words or with more than half of them in repeated windows;
    such rows do not shape the estimates. A row beyond the `confidence` quantile of chi-square is rejected. A group
    without rows that pass the base rule uses its language's estimate, and failing that the estimate over all. Null
    languages and sources are groups of their own; a null text counts as empty and fails; a null doc_id is carried
    along; repeated rows are judged each and count each; ties at the edge of the nearest rows are all in; whole texts
    are counted, however long; an empty table gives no rows; other columns are ignored.
    """
    counted, _ = materialise(with_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("__lang"), F.col("source").cast("string").alias("__source"), "text"), "doc_id", "__lang", "__source"), "rules")
    failed = F.expr(f"n_words < {min_words} or 100 * n_repeat_words > 50 * n_words")
    label = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    keys = [label("__lang", "__source"), label("__lang"), F.lit("all")]
    vectors = counted.withColumn("base_failed", failed).select("*", *_vector(), *(k.alias(f"g{i}") for i, k in enumerate(keys)))
    good = vectors.where(~F.col("base_failed"))
    found = estimates(good.select(F.explode(F.array("g0", "g1", "g2")).alias("grp"), *(f"x{i}" for i in range(P))))
    names, _ = materialise(good.select(F.explode(F.array(F.struct(F.col("g0").alias("grp"), F.col("g1").alias("parent"), F.lit(0).alias("level")), F.struct(F.col("g1").alias("grp"), F.col("g2").alias("parent"), F.lit(1).alias("level")))).alias("s")).select("s.*").distinct(), "rules-groups")
    whole = found.where("grp = 'all'")
    langs, _ = materialise(shrunk(found.join(names.where("level = 1"), "grp"), whole).unionByName(whole.select("grp", "n", *MOMENTS)), "rules-langs")
    model = _estimate(shrunk(found.join(names.where("level = 0"), "grp"), langs).unionByName(langs))
    own = vectors
    for i in (0, 1):
        own = own.join(model.select(F.col("grp").alias(f"g{i}"), F.lit(True).alias(f"has{i}")), f"g{i}", "left")
    own = own.withColumn("grp", F.when(F.col("has0"), F.col("g0")).when(F.col("has1"), F.col("g1")).otherwise("all"))
    judged = _with_distance(own, model)
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= quantile(confidence, P))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance"))


def op4_rules(spark, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
