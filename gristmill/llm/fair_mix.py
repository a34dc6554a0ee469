"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, repeated up to ``repeats`` times.  An item's virtual
finish time is the number of its source's words up to and with it, divided by the source's target.  Items are
taken in order of finish time until the budget, the sum of all targets, is spent.

Both running sums are taken in blocks: items carry a block number that keeps the order (leading digits of the shuffle
key within a source; slices of virtual time over all), blocks are summed first, and only rows inside one block meet in
a task.  A source with a third of all rows is then as many blocks as its rows need.

Rows: null or empty text has size 0 and takes 0 words.  Sources are ordered by code point, null last; null is a source
of its own.  Ties in shuffle key or time are settled by doc_id and a hash of the text.  Repeated rows are items of
their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.storage import materialize

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Rows of a block, up to so many blocks; beyond those, blocks have more rows, so that one task can go over all blocks' sums.
BLOCK_ROWS, BLOCK_BITS = 1024, 20
WORD_GAP = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than the six ASCII white-space ones; null has none."""
    gaps = F.size(F.split(F.coalesce(text, F.lit("")), WORD_GAP))  # one more than the gaps
    ends = F.when(F.coalesce(text, F.lit("")).rlike(r"^[\x20\x09-\x0D]|^$"), 1).otherwise(0) + F.when(F.coalesce(text, F.lit("")).rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return (gaps - ends).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target of every source.

    Levels: sources are capped in order of ``repeats * size / weight``; the first level at which no uncapped source
    exceeds its cap is where repeated resharing ends.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w", weight.cast("long")).withColumn("cap", F.lit(repeats) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order, every = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("total", F.sum("source_size").over(every)).withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    by = by.withColumn("level", (F.col("total") - F.col("spent")) / F.col("left"))
    # levels rise up to the first that fits and fall after it; before it, every source is at its cap
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    fits = F.max(F.when(F.col("level") <= F.col("ratio"), 1).otherwise(0)).over(order)
    return by.select("source", "source_size", F.when(fits == 1, F.col("w") * level).otherwise(F.col("cap").cast("double")).alias("target"))


def shuffle_key(seed: str = "mix") -> Column:
    """A key that any engine can repeat: the first 48 bits of the MD5 of seed and doc_id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """``sizes``: a stored table of doc_id, source, size, tie.  Adds source_size, target, taken, epochs."""
    rows = sizes.count()
    bits = min(BLOCK_BITS, (rows // BLOCK_ROWS).bit_length())  # 2 ** bits blocks hold a source that has all rows
    keyed = sizes.withColumn("key", shuffle_key(seed)).withColumn("block", F.shiftright("key", 48 - bits) if bits else F.lit(0).cast("long"))
    tgt = targets(sizes, weights, repeats)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    # running words within a source: sums of blocks, then rows inside a block
    blocks = keyed.groupBy("source", "block").agg(F.sum("size").alias("in_block"))
    w = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), F.coalesce(F.sum("in_block").over(w), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumn("within", F.sum("size").over(inside)).withColumn("rank", F.row_number().over(Window.partitionBy("source", "block").orderBy("key", "doc_id", "tie")))
    queued = keyed.join(blocks, keyed["source"].eqNullSafe(blocks["b_source"]) & (keyed["block"] == blocks["b_block"])).drop("b_source", "b_block")
    t = tgt.select(F.col("source").alias("t_source"), "source_size", "target")
    queued = queued.join(t, queued["source"].eqNullSafe(t["t_source"])).drop("t_source").withColumn("cum", F.col("before") + F.col("within"))
    queued = materialize(queued.select("doc_id", "source", "size", "tie", "source_size", "target", "cum", "block", "rank"), "mix-queue")

    # virtual finish times of every repetition that can end by time 1; slices of time hold about as many words each
    slices = 1 << bits
    items = queued.where("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    items = items.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("cum")) / F.col("target")).withColumn("slice", F.floor(F.col("finish") * slices).cast("long"))
    total = tgt.agg(F.sum("target").alias("budget"))
    per = items.groupBy("slice").agg(F.sum("size").alias("in_slice"))
    upto = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("ahead", F.coalesce(F.sum("in_slice").over(upto), F.lit(0))).crossJoin(total)  # one row beside the slices
    per = per.withColumn("state", F.when(F.col("ahead") + F.col("in_slice") <= F.col("budget") + 0.5, 0).when(F.col("ahead") > F.col("budget") + 0.5, 2).otherwise(1))
    # only the slice in which the budget ends needs its rows in order
    marked = items.join(per.select(F.col("slice").alias("p_slice"), "ahead", "budget", "state"), F.col("slice") == F.col("p_slice")).where("state < 2")
    edge = Window.partitionBy("slice").orderBy("finish", F.col("source").asc_nulls_last(), "block", "rank", "epoch").rowsBetween(Window.unboundedPreceding, 0)
    cut = marked.where("state = 1").withColumn("run", F.col("ahead") + F.sum("size").over(edge)).where("run <= budget + 0.5")
    took = marked.where("state = 0").select("source", "block", "rank").unionByName(cut.select("source", "block", "rank"))
    took = took.groupBy("source", "block", "rank").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("k_source"), F.col("block").alias("k_block"), F.col("rank").alias("k_rank"), "n")
    out = queued.join(took, queued["source"].eqNullSafe(took["k_source"]) & (queued["block"] == took["k_block"]) & (queued["rank"] == took["k_rank"]), "left")
    epochs = F.coalesce(F.col("n"), F.lit(0))
    return out.select("doc_id", "source", "size", "tie", "source_size", "target", (F.col("size") * epochs).alias("taken"), epochs.cast("int").alias("epochs"))


def sized(docs: DataFrame) -> DataFrame:
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), F.xxhash64("text").alias("tie")), "mix-sizes")


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(sized(docs)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns."""
    took = mix(sized(docs), **options).select("doc_id", "tie", "epochs").groupBy("doc_id", "tie").agg(F.sum("epochs").alias("epochs"), F.count(F.lit(1)).alias("rows"))
    took = materialize(took, "mix-epochs")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("t"))
    per = F.col("epochs")
    if took.where("rows > 1").limit(1).count():  # copies of one row share what they take, the first ones one more
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("i", "t").orderBy(F.xxhash64("doc"))))
        per = F.floor(F.col("epochs") / F.col("rows")) + F.when(F.col("k") <= F.col("epochs") % F.col("rows"), 1).otherwise(0)
    out = rows.join(took.where("epochs > 0"), F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tie"))).withColumn("n", per.cast("int")).where("n > 0")
    return out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc.*")
