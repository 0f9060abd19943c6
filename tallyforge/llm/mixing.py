"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Slot t of the mix is the point frac(t / golden ratio), in whole numbers modulo 2^31; the point falls into one source's
stretch of the cumulative target shares. The k-th slot of a source takes the k-th block of its shuffled words, going
round again after the last. Blocks have equally many words; a source's last slot takes what its target still needs, a
source that the points gave too few slots (one smaller than a block may have none) gets the rest at the end of the
schedule, and slots beyond the target are dropped. So each source meets its target to the word, however small it is.

Ranks and running sums are made in two levels (within chunks, and over chunks), so no source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

#: The weights, dealt to the sources in code point order.
WEIGHTS = [5, 2, 1]
RING, GOLDEN = 1 << 31, 1327217885
#: Slots in a chunk, hexadecimal digits that deal a stream into parts, stretches of the points' range.
CHUNK, PART_DIGITS, STRETCHES = 65536, 3, 1024


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """For each `key` of sizes(key, source, size): no, source_size, target, and its stretch lo..hi of the mix.

    Weights go round in code point order, null last. A target stops at `most` times its source's size; what is over goes
    to the others by weight, again and again: that ends where each target is the lesser of its cap and a common level
    times its weight, and the level is found by one pass over the sources in the order in which they reach their caps.
    """
    total = sizes.groupBy("key", "source").agg(F.sum("size").cast("long").alias("source_size"))
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    rows = total.withColumn("no", F.row_number().over(whole) - 1)
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("no") % len(WEIGHTS) + 1).cast("double"))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    everyone = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "no")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("mix", share * F.sum("source_size").over(everyone))
    level = (F.col("mix") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    rows = rows.withColumn("level", level)
    reached = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "no", "level"))
    rows = rows.withColumn("level", F.min(reached).over(everyone)["level"])
    rows = rows.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")))
    upto = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    high = F.sum("target").over(upto) / F.sum("target").over(everyone)
    rows = rows.withColumn("hi", F.coalesce(high, F.lit(0.0)))
    rows = rows.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("no")), F.lit(0.0)))
    return rows.select("key", "no", "source_size", "target", "lo", "hi", "mix")


def _prefix(rows: DataFrame, group: str, chunk: str, amount: Column) -> DataFrame:
    """For each group and chunk: the sum of `amount` over the group's earlier chunks."""
    sums = rows.groupBy(group, chunk).agg(F.sum(amount).cast("long").alias("__sum"))
    earlier = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(group, chunk, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).cast("long").alias("__before"))


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """The slots: slot, no (the source), block (in its stream), round (how often it has gone through), words (how many
    of the block's words the slot takes, all but for the last slot of a source)."""
    first = sources.agg(F.max("mix").alias("mix")).first()
    slots = int(round((first["mix"] or 0.0) / block_words))
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % RING) * GOLDEN % RING).alias("at"))
    points = points.withColumn("u", (F.col("at") + 0.5) / RING).withColumn("stretch", F.floor(F.col("u") * STRETCHES).cast("int"))
    over = F.sequence(F.floor(F.col("lo") * STRETCHES).cast("int"), F.floor(F.col("hi") * STRETCHES).cast("int"))
    pieces = sources.where("hi > lo").select("no", "lo", "hi", F.explode(over).alias("stretch"))
    dealt = points.join(pieces, "stretch").where("u >= lo and u < hi").select("slot", "no", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    dealt, _ = materialise(dealt, "mix-slots")
    ahead = _prefix(dealt, "no", "chunk", F.lit(1))
    within = F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("__at", within).join(ahead, ["no", "chunk"]).select("slot", "no", (F.col("__before") + F.col("__at")).alias("rank"))
    blocks = F.ceil(F.col("source_size") / block_words)
    goal = F.floor(F.col("target") + 0.5).cast("long")
    rounds = F.floor(F.col("goal") / F.col("source_size"))
    need = rounds * F.col("blocks") + F.ceil((F.col("goal") - rounds * F.col("source_size")) / block_words)
    wanted = sources.where("source_size > 0").select("no", "source_size", blocks.alias("blocks"), goal.alias("goal")).withColumn("need", need)
    given = dealt.groupBy("no").agg(F.count("*").alias("given"))
    short = wanted.join(given, "no", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < need")
    late = short.select(F.lit(slots).cast("long").alias("slot"), "no", F.explode(F.sequence(F.col("given"), F.col("need") - 1)).alias("rank"))
    taking = ranked.unionByName(late).join(wanted, "no").where("rank < need")
    block = (F.col("rank") % F.col("blocks")).cast("long")
    round_ = F.floor(F.col("rank") / F.col("blocks"))
    left = F.col("goal") - round_ * F.col("source_size") - block * block_words
    return taking.select("slot", "no", block.alias("block"), round_.alias("round"), F.least(F.lit(block_words), F.col("source_size") - block * block_words, left).cast("long").alias("words"))


def placed(docs: DataFrame, block_words: int = 128, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """The sources' targets, and each document's place in its source's shuffled stream of words."""
    source = F.col("source").cast("string")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("key"), source.alias("source"), word_count(F.col("text")).alias("size"))
    sizes, _ = materialise(sizes, "mix-sizes")
    sources, _ = materialise(targets(sizes), "mix-targets")
    rows = sizes.join(sources.select("key", "no", "source_size", "target"), "key").select("doc_id", "size", "no", "source_size", "target", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")).alias("__order"))
    rows = rows.withColumn("part", F.substring("__order", 1, PART_DIGITS))
    ahead = _prefix(rows, "no", "part", F.col("size"))
    running = Window.partitionBy("no", "part").orderBy("__order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("size").over(running), F.lit(0))).join(ahead, ["no", "part"])
    return sources, rows.select("doc_id", "size", "no", "source_size", "target", (F.col("__before") + F.col("__in")).cast("long").alias("start"))


def mixed(docs: DataFrame, block_words: int = 128, most: int = 2, seed: int = 5) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) and first (how often the block
    with the document's first word is taken) for every row of `docs`.

    A null text has no words, a null source is a source of its own and comes last, a null doc_id is carried along;
    documents without a word take nothing; repeated rows are documents of their own; ties in the shuffle go by doc_id
    and size; texts of any length are cut into blocks; an empty table gives no rows; other columns are ignored. No block
    is taken more than `most` times.
    """
    sources, rows = placed(docs, block_words, seed)
    rows, _ = materialise(rows, "mix-places")
    times = schedule(sources, block_words).where(F.col("round") < most).groupBy("no", "block", "words").agg(F.count("*").alias("times"))
    own = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    cut = rows.where("size > 0").select("*", F.explode(own).alias("block")).join(times, ["no", "block"], "left")
    begin = F.col("block") * block_words
    inside = F.least(begin + F.col("words"), F.col("start") + F.col("size")) - F.greatest(begin, F.col("start"))
    often = F.coalesce("times", F.lit(0))
    head = (F.col("start") >= begin) & (F.col("start") < begin + F.col("words"))
    sums = cut.groupBy("no", "start", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum(F.greatest(inside, F.lit(0)) * often), F.lit(0)).cast("long").alias("taken"), F.sum(F.when(head, often).otherwise(0)).cast("int").alias("first"))
    none = rows.where("size = 0").select("no", "start", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).alias("first"))
    return sums.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "first")


def mix_documents(docs: DataFrame, block_words: int = 128) -> DataFrame:
    """Whole documents in the mix: each row of `docs` as often as the schedule takes the word it begins with.

    Rows of one doc_id are taken alike, null doc_ids too; documents without a word, among them null texts, are not in
    the mix; columns stay as they are, whatever their names. Ties, empty tables and long texts as in `mixed`.
    """
    often = mixed(docs, block_words).groupBy("doc_id").agg(F.max("first").alias("times")).where("times > 0")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("own"))
    out = rows.join(often, rows["own"].eqNullSafe(often["doc_id"])).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select("row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("first")
