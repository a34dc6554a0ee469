"""From raw export rows to comments: ids, filters, texts, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gristmill.functions.text import combined_text, strip
from gristmill.operators.skew import nth


def first_filled(*columns: Column) -> Column:
    """The first value that isn't missing or blank."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in columns])


def with_id(rows: DataFrame, *candidates: str, order: str = "row_idx") -> DataFrame:
    return rows.withColumn("id", F.coalesce(first_filled(*map(F.col, candidates)), F.concat(F.lit("comment_"), F.col(order).cast("string"))))


def guard_by_share(rows: DataFrame, column: str, share: float = 0.9) -> DataFrame:
    """Drop rows without ``column`` only if more than ``share`` of all rows have it."""
    present = F.coalesce(strip(column) != "", F.lit(False))
    use = rows.agg((F.avg(present.cast("double")) > share).alias("_use"))  # one row
    return rows.crossJoin(F.broadcast(use)).where(~F.coalesce("_use", F.lit(False)) | present).drop("_use")


def with_text(rows: DataFrame, body: str, attachment: str) -> DataFrame:
    return rows.withColumn("text", combined_text(body, attachment)).where(strip("text") != "")


def distinct_ids(rows: DataFrame, tracking: str = "tracking", order: str = "row_idx", mark: str | None = None) -> DataFrame:
    """The second and later rows of an id get its tracking number, else their count, as a suffix; ``mark`` names a column that tells them.

    Counted on ids alone, so that no text is sorted, and in blocks, so that an id with a third of all rows is many tasks.
    """
    places = nth(rows.select("id", order), ["id"], order, "_nth").where("_nth > 1").select(F.col(order).alias("_at"), "_nth")
    suffix = F.coalesce(first_filled(F.col(tracking)), F.concat(F.lit("dup"), F.col("_nth").cast("string")))
    later = rows.join(places, F.col(order) == F.col("_at"), "left").drop("_at")
    later = later.withColumn(mark, F.col("_nth").isNotNull()) if mark else later
    return later.withColumn("id", F.when(F.col("_nth").isNull(), F.col("id")).otherwise(F.concat("id", F.lit("#"), suffix))).drop("_nth")


def order_hash(key: Column, seed: str) -> Column:
    """A number any engine can repeat: the first 32 bits of the MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long")


def sample_rows(rows: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """``n`` rows, the same ones on every run."""
    return rows.orderBy(order_hash(F.col(key), seed), key).limit(n)


def united(parts: list[DataFrame]) -> DataFrame:
    """Tables whose columns differ one below the other: a column that one lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def counted(rows: DataFrame, kind: str | None = None, public: str = "Public Submission", error: str | None = None, repeated: str | None = None) -> tuple[DataFrame, Observation]:
    """``rows`` as they are, and the counters rows, other_kinds, repeated_ids, failed, which come with whatever writes them.

    ``kind``, ``error`` and ``repeated`` name columns; the last one is true for later rows of an id, as ``distinct_ids`` finds them.
    No job is run for the counters: they are there (``.get``) when the first action over the rows has ended.
    """
    told = Observation("run")
    none = F.lit(0).cast("long")
    other = F.count_if(~F.coalesce(F.col(kind) == public, F.lit(False))) if kind else F.max(none)
    failed = F.count_if(strip(error) != "") if error else F.max(none)
    again = F.count_if(F.col(repeated)) if repeated else F.max(none)
    return rows.observe(told, F.count(F.lit(1)).alias("rows"), other.alias("other_kinds"), again.alias("repeated_ids"), failed.alias("failed")), told
