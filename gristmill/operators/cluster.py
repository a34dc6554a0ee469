"""Form-letter campaigns by MinHash banding, and families of campaigns as connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.shingles import U, mixed, shingle_sets
from gristmill.functions.text import campaign_form, collapse, family_form, words
from gristmill.operators.components import connected_components
from gristmill.operators.skew import lookup, with_least
from gristmill.storage import discard, materialize, scratch_path

BUCKET = ["band", "bucket"]
_SLICE = 256


def banding(threshold: float, permutations: int = 128) -> tuple[int, int]:
    """Bands and rows whose candidates are least wrong about a similarity threshold.

    Two sets of similarity s share a band with the probability 1 - (1 - s ** rows) ** bands.  What lies below the threshold under
    that curve, and above the threshold over it, counts as error; both are integrated at midpoints.
    """
    n = 1000
    below, above = threshold * (np.arange(n) + 0.5) / n, threshold + (1 - threshold) * (np.arange(n) + 0.5) / n

    def error(bands: int, rows: int) -> float:
        wrong = (1 - (1 - below**rows) ** bands).mean() * threshold
        missed = ((1 - above**rows) ** bands).mean() * (1 - threshold)
        return wrong + missed

    return min(((b, r) for b in range(1, permutations + 1) for r in range(1, permutations // b + 1)), key=lambda x: error(*x))


def configured(declared: dict) -> dict:
    """What ``campaigns`` takes, from a collection's settings: threshold, min_size and min_chars, each with its default."""
    bands, rows = banding(float(declared.get("threshold", 0.45)))
    return {"bands": bands, "rows": rows, "least": int(declared.get("min_size", 5)), "min_chars": int(declared.get("min_chars", 100))}


class MinHash:
    """Least values of a set under ``bands * rows`` hash functions, and a key for every band of them."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        n = bands * rows
        numbers = mixed(np.arange(1, 2 * n + 1, dtype=U) + U(seed << 32))
        self.turn, self.stretch, self.shape = numbers[:n, None], numbers[n:, None] | U(1), (bands, rows)
        self.weights = mixed(np.arange(1, rows + 1, dtype=U)) | U(1)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.shape[0] * self.shape[1], np.iinfo(U).max, U)
        for i in range(0, len(shingles), 2048):  # so that long texts need no more memory
            np.minimum(least, ((shingles[None, i : i + 2048] ^ self.turn) * self.stretch).min(axis=1), out=least)
        return mixed((mixed(least).reshape(self.shape) * self.weights).sum(axis=1, dtype=U))


def signatures(texts: DataFrame, key: str, bands: int, rows: int, form: str = "form", short_ok: bool = False) -> DataFrame:
    """key, bands (array of longs, one a band) of the five-word shingles of each text.

    A text of fewer words is one shingle with ``short_ok``, else it has no bands and is left out.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(bands, rows)
        for batch in batches:
            for i in range(0, len(batch), _SLICE):
                b = batch.slice(i, _SLICE)
                found = [hasher.keys(s).astype(np.int64) if len(s) else None for s in shingle_sets(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], [key, "bands"])

    enough = F.size(words(F.col(form))) >= (1 if short_ok else 5)
    return texts.where(enough).select(F.col(key).cast("long").alias(key), form).mapInArrow(sign, f"{key} long, bands array<long>")


def buckets(sigs: DataFrame, key: str) -> DataFrame:
    """band, bucket, key of every bucket that several texts share: all candidate pairs, in as many rows as members."""
    rows = sigs.select(F.col(key), F.posexplode("bands").alias(*BUCKET))
    shared = rows.groupBy(*BUCKET).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select(*BUCKET)
    return lookup(rows, shared, BUCKET, key)


def eligible(comments: DataFrame, min_chars: int = 100) -> DataFrame:
    """row_idx, form of texts long enough to compare."""
    rows = comments.select("row_idx", campaign_form("text").alias("form"))
    return rows.where((F.length("form") >= min_chars) & (F.size(words(F.col("form"))) >= 5))


def distinct_forms(comments: DataFrame, min_chars: int = 100) -> tuple[DataFrame, DataFrame]:
    """row_idx, h of every eligible comment; h, v (its first row), copies, form of every normal form.  Both stored."""
    texts = materialize(eligible(comments, min_chars).withColumn("h", F.md5("form")), "campaign-texts")
    firsts = texts.groupBy("h").agg(F.min("row_idx").alias("v"), F.count(F.lit(1)).alias("copies"))
    return texts, materialize(texts.select(F.col("row_idx").alias("v"), "form").join(firsts, "v"), "campaign-forms")


def leaders(members: DataFrame) -> DataFrame:
    """band, bucket, v: the buckets of the texts that a pass in ascending order would pick, each striking out all it shares a bucket with.

    ``members`` (band, bucket, v) is stored.  Rounds: an open text that is the least open one of all its buckets is picked; the
    members of its buckets are struck.  A bucket never has two that are picked.  Few rounds settle all.
    """
    spark, path, open_, first = members.sparkSession, scratch_path(members.sparkSession, "leaders"), members, True
    while first or open_.limit(1).count():
        told = materialize(with_least(open_, BUCKET, "v", "m"), "leader-least")
        heads = materialize(told.groupBy("v").agg(F.min("m").alias("m")).where("v = m").select("v"), "leader-heads")
        told.where("v = m").join(heads, "v").select(*BUCKET, "v").write.mode("append").parquet(path)
        # the buckets of those picked, then who is in them
        taken = told.where("v = m").join(heads, "v", "left_semi").select(*BUCKET)
        struck = materialize(lookup(told.select(*BUCKET, "v"), taken, BUCKET, "v").select("v").distinct(), "leader-struck")
        rest = materialize(told.select(*BUCKET, "v").join(struck, "v", "left_anti"), "leader-open")
        discard(told, heads, struck, *([] if first else [open_]))
        open_, first = rest, False
    return spark.read.schema(members.select(*BUCKET, "v").schema).parquet(path)


def campaigns(comments: DataFrame, bands: int = 25, rows: int = 5, least: int = 5, min_chars: int = 100) -> DataFrame:
    """row_idx, campaign_id, campaign_size of clustered comments, stored.

    Equal normal forms are compared once: they stand as their first row, and count with all their rows.  A comment in
    several clusters ends in the one with the largest id; the size stays that of the whole cluster.
    """
    texts, forms = distinct_forms(comments, min_chars)
    members = materialize(buckets(materialize(signatures(forms, "v", bands, rows), "campaign-signatures"), "v"), "campaign-buckets")
    heads = leaders(members)
    near = lookup(members, heads.withColumnRenamed("v", "leader"), BUCKET, "v").select("leader", "v").distinct()
    alone = forms.select("v").join(members.select("v").distinct(), "v", "left_anti").select(F.col("v").alias("leader"), "v")
    near = materialize(near.unionByName(alone), "campaign-near")
    sizes = near.join(forms.select("v", "copies"), "v").groupBy("leader").agg(F.sum("copies").alias("campaign_size")).where(F.col("campaign_size") >= least)
    ids = sizes.withColumn("campaign_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("campaign_size"), "leader")) - 1)  # a row a campaign
    best = lookup(near, ids, ["leader"], "v").groupBy("v").agg(F.max(F.struct("campaign_id", "campaign_size")).alias("c")).select("v", "c.campaign_id", "c.campaign_size")
    by_form = forms.join(best, "v").select("h", F.col("campaign_id").cast("int").alias("campaign_id"), "campaign_size")
    out = materialize(lookup(texts.select("row_idx", "h"), by_form, ["h"], "row_idx").select("row_idx", "campaign_id", "campaign_size"), "campaign-tags")
    discard(texts, forms, members, near)
    return out


def with_campaigns(comments: DataFrame, tagged: DataFrame) -> DataFrame:
    """All comments, with null for those in no campaign."""
    return comments.join(tagged, "row_idx", "left")


def tagged_sizes(tagged: DataFrame) -> DataFrame:
    """campaign_id, tagged: how many comments ended in each campaign."""
    return tagged.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("tagged"))


def canonical(comments: DataFrame, tagged: DataFrame, label: str = "label") -> DataFrame:
    """campaign_id and its most common label text (the one seen first among equals)."""
    prints = comments.select("row_idx", F.sha2(label, 256).alias("_p")).join(tagged.select("row_idx", "campaign_id"), "row_idx")
    counts = prints.groupBy("campaign_id", "_p").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("f"))
    best = counts.groupBy("campaign_id").agg(F.max_by("f", F.struct("n", -F.col("f"))).alias("row_idx"))  # whose text it is
    return best.join(comments.select("row_idx", F.col(label).alias("canonical")), "row_idx").select("campaign_id", "canonical")


def families(canon: DataFrame, sizes: DataFrame, bands: int = 37, rows: int = 3) -> DataFrame:
    """campaign_id, family_id, family_label.  ``sizes``: campaign_id, tagged.

    The family takes the id of its campaign with most tagged comments (the smaller id among equals) and that one's
    first eight words.
    """
    canon = materialize(canon.withColumn("form", collapse(family_form("canonical"))), "family-texts")
    members = materialize(buckets(materialize(signatures(canon, "campaign_id", bands, rows, short_ok=True), "family-signatures"), "campaign_id"), "family-buckets")
    parts = connected_components(with_least(members, BUCKET, "campaign_id", "first").select(F.col("first").alias("a"), F.col("campaign_id").alias("b")))
    out = canon.join(sizes, "campaign_id").join(parts, F.col("campaign_id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "campaign_id"))
    best = out.groupBy("part").agg(F.max_by(F.struct("campaign_id", "form"), F.struct("tagged", -F.col("campaign_id"))).alias("m"))
    label = F.array_join(F.slice(words(F.col("m.form")), 1, 8), " ")
    best = best.select("part", F.col("m.campaign_id").alias("family_id"), label.alias("l"))
    return out.join(best, "part").select("campaign_id", "family_id", F.when(F.col("l") != "", F.col("l")).otherwise(F.concat(F.lit("campaign-"), F.col("family_id").cast("string"))).alias("family_label"))
