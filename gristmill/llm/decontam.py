"""Benchmark decontamination by a prefix-filtered join of word windows.

A window is ``size`` consecutive words of an item (an item with fewer words is one window).  A text that holds a window
holds each of its words, so one word decides where to look: the rarest by its count over all documents, ties by the
word, then by place.  Windows next to each other share their rarest occurrence; such a run is one segment of the item,
at most ``2 * size - 1`` words long.  Words of documents join segments on that word.  Inside the join, candidates must
leave room for the segment's shortest window (length and positional bounds) and agree with it on the longer half beside
the rare word.  What is left is verified word by word over every window of the segment.

Every step reads the corpus once, whatever the benchmark's size.  Up to ``BLOCK`` segments, rows of bounded size, are sent to
all tasks.  More are joined by a shuffle on the rare word, to which a document's word goes with the words around it that
a segment can reach; words that are no segment's are left out before it while the rare words are few enough to send.

Rows: null text has no words; documents without words are clean.  Repeated rows get equal results.  Items without words
or with a null text never occur; a null item_id counts for hits but has no name to list.  Items that share an id are
one item in the counts.  An empty table of documents gives an empty result, an empty benchmark leaves all clean.
Other columns may have any names.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.storage import materialize

WINDOW = 10
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Segments (at most 2 * WINDOW - 1 words) that one broadcast holds, and a tenth of the words that one does.
BLOCK = 20_000


def words(text: Column) -> Column:
    """Maximal runs of letters, digits and non-ASCII characters, with A-Z lowered."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, upper, upper.lower())).otherwise(F.lower(t))
    return F.array_remove(F.split(lowered, GAP), "")


def count_words(text: Column) -> Column:
    """How many ``words`` there are, as the text stands: one more than the gaps, less those at the ends."""
    t, gap = F.coalesce(text.cast("string"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    ends = F.when(t.rlike(f"^{gap}|^$"), 1).otherwise(0) + F.when(t.rlike(gap + r"\z"), 1).otherwise(0)
    return (F.size(F.split(t, gap + "+")) - ends).cast("long")


def segments(texts: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """item, key (the rare word), off (its place in the segment), seg (words), win (words of a window), before, after (words to compare first)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = materialize(items.withColumn("row", F.xxhash64("item", "words")), "decontam-items")
    placed = items.select("row", "item", F.posexplode("words").alias("pos", "word"))
    vocabulary = materialize(placed.select("word").distinct(), "decontam-vocabulary")
    # an outer explode: for an inner one, the optimizer would cut the words once more to see whether there are any
    said = texts.select(F.explode_outer("words").alias("word"))
    few = vocabulary.count() <= block * 10
    counts = (said.join(F.broadcast(vocabulary), "word") if few else said).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts if few else counts.join(vocabulary, "word"), "decontam-counts")
    placed = placed.join(counts, "word", "left").select("row", "item", "pos", "word", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = placed.groupBy("row", "item").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "word"))).alias("t"))
    ranked = ranked.select("row", "item", F.transform("t", lambda x: x["word"]).alias("words"), F.transform("t", lambda x: F.struct(x["n"].alias("n"), x["word"].alias("word"), x["pos"].alias("pos"))).alias("t"))
    ranked = ranked.withColumn("win", F.least(F.lit(size), F.size("words")))
    wins = ranked.select("row", "item", "words", "win", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("win")), lambda w: F.struct(F.array_min(F.slice("t", w + 1, F.col("win"))).alias("rare"), w.alias("at")))).alias("w"))
    runs = wins.groupBy("row", "item", F.col("w.rare.word").alias("key"), F.col("w.rare.pos").alias("pos")).agg(F.min("w.at").alias("lo"), F.max("w.at").alias("hi"), F.first("words").alias("words"), F.first("win").alias("win"))
    seg = F.slice("words", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("win"))
    out = runs.select("item", "key", (F.col("pos") - F.col("lo")).cast("int").alias("off"), seg.alias("seg"), F.col("win").cast("int").alias("win"))
    half = F.floor(F.col("win") / 2).cast("int")  # of win - 1 words beside the rare one, a side has at least half
    before = F.when(F.col("off") >= half, F.slice("seg", F.col("off") - half + 1, half))
    after = F.when(F.col("off") + half < F.size("seg"), F.slice("seg", F.col("off") + 2, half))
    return materialize(out.withColumns({"half": half, "before": before, "after": after}), "decontam-segments")


def hits(texts: DataFrame, segs: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """d_id, d_tie, item, start, stop (words of the document) of every occurrence.  ``texts``: d_id, d_tie, words."""
    at = texts.select("d_id", "d_tie", "words", F.posexplode_outer("words").alias("pos", "key"))
    if segs.count() <= block:
        near = at.withColumn("ahead", F.lit(0)).join(F.broadcast(segs), "key")
    else:
        keys = materialize(segs.select("key").distinct(), "decontam-keys")
        at = at.join(F.broadcast(keys), "key", "left_semi") if keys.count() <= block * 10 else at.where("key is not null")
        reach = 2 * size - 2  # words of a segment beside its rare one
        around = F.slice("words", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(reach)) + 1 + reach)
        at = at.select("d_id", "d_tie", "key", F.greatest(F.col("pos") - reach, F.lit(0)).alias("ahead"), F.least(F.col("pos"), F.lit(reach)).alias("pos"), around.alias("words"))
        near = at.join(segs, "key")
    half, p = F.col("half"), F.col("pos")
    left = F.col("before").isNotNull() & (p >= half) & (F.slice("words", F.greatest(p - half + 1, F.lit(1)), half) == F.col("before"))
    right = F.col("after").isNotNull() & (p + half < F.size("words")) & (F.slice("words", p + 2, half) == F.col("after"))
    near = near.where((F.size("words") >= F.col("win")) & (left | right))
    shift = F.col("pos") - F.col("off")
    whole = F.filter(F.sequence(F.lit(0), F.size("seg") - F.col("win")), lambda w: (w + shift >= 0) & (F.slice("words", F.greatest(w + shift + 1, F.lit(1)), F.col("win")) == F.slice("seg", w + 1, F.col("win"))))
    shifted = F.col("shift") + F.col("ahead")
    span = F.when(F.size("whole") > 0, F.struct((shifted + F.array_min("whole")).alias("start"), (shifted + F.array_max("whole") + F.col("win")).alias("stop")))
    near = near.select("d_id", "d_tie", "item", shift.alias("shift"), "ahead", "win", whole.alias("whole"))
    # an outer explode holds the check above the join, whose condition then stays compiled
    near = near.select("d_id", "d_tie", "item", F.explode_outer(F.array(span)).alias("at")).where("at is not null")
    return near.select("d_id", "d_tie", "item", "at.start", "at.stop")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("d_id"), F.xxhash64(F.col("text").cast("string")).alias("d_tie"), words(F.col("text")).alias("words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """d_id, d_tie, n_hit, items (sorted names) of the documents with an occurrence, stored."""
    texts = _texts(docs)
    every = hits(texts, segments(texts, benchmark, size, block), size, block).distinct()
    order = Window.partitionBy("d_id", "d_tie").orderBy("start", "stop", "item")
    reached = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = every.withColumn("fresh", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reached)))
    return materialize(every.groupBy("d_id", "d_tie").agg(F.sum("fresh").cast("long").alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items")), "decontam-hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without an occurrence, with their own columns."""
    dirty = contaminated(docs, benchmark, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.withColumn("i", F.col("doc.doc_id").cast("long")).withColumn("t", F.xxhash64(F.col("doc.text").cast("string")))
    return rows.join(dirty.select("d_id", "d_tie"), F.col("i").eqNullSafe(F.col("d_id")) & (F.col("t") == F.col("d_tie")), "left_anti").select("doc.*")


def op10_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    dirty = contaminated(docs, benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), count_words(F.col("text")).alias("n_words"))
    out = rows.join(dirty, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("tie") == F.col("d_tie")), "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
