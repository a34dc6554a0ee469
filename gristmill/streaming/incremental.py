"""Incremental ingest: new files are read once, each batch loses its repeats and is merged by key, however old its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.files import holds_parquet


def merge(batch: DataFrame, target: str, key: str = "id") -> None:
    """Append the rows whose keys ``target`` lacks, each key once.

    Of the target, only row groups whose keys can lie between the batch's least and greatest are read.  A batch that is done
    again adds nothing, so a place in a stream that is kept after the append loses no row and doubles none.
    """
    spark = batch.sparkSession
    once = batch.dropDuplicates([key])
    if holds_parquet(spark, target):
        low, high = batch.agg(F.min(key), F.max(key)).first()
        known = spark.read.parquet(target).select(key).where(F.col(key).between(low, high))
        once = once.join(known, key, "left_anti")
    once.write.mode("append").parquet(target)


def ingest_new(spark: SparkSession, source: str, target: str, state: str, key: str = "id") -> int:
    """Append the rows of new parquet files below ``source`` whose keys ``target`` doesn't have; how many rows it has then."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(lambda batch, _: merge(batch, target, key)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).count()


def follow_listing(listed: DataFrame, target: str, state: str, key: str = "id") -> int:
    """Append what a streamed listing has beyond the place in ``state``; how many rows ``target`` has then.

    A run that breaks off, in the service or here, goes on where its last whole batch ended.
    """
    spark = listed.sparkSession

    def append(batch: DataFrame, _: int) -> None:
        batch.persist()  # the service is asked once
        try:
            merge(batch, target, key)
        finally:
            batch.unpersist()

    query = listed.writeStream.foreachBatch(append).option("checkpointLocation", state).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(target).count() if holds_parquet(spark, target) else 0


def fetch_window(known: DataFrame, posted: str = "posted") -> DataFrame:
    """From when to list again: the day before the newest known row."""
    return known.agg(F.date_format(F.date_sub(F.max(F.to_date(posted)), 1), "yyyy-MM-dd").alias("since"))


def to_cursor(c: Column) -> Column:
    """An ISO time as a listing's filter takes it: blanks instead of T and Z."""
    return F.trim(F.translate(c, "TZ", "  "))


def from_cursor(c: Column) -> Column:
    return F.concat(F.replace(F.trim(c), F.lit(" "), F.lit("T")), F.lit("Z"))


def withdrawn_candidates(listed: DataFrame, known: DataFrame, mark: str, modified: str = "modified", key: str = "id") -> DataFrame:
    """Known rows that were modified after the high-water mark, in parts of a second too if ``modified`` has them.

    ``modified`` is a time, or text that sorts as one; the mark itself moves by ``remote.next_mark``.
    """
    return listed.where(F.col(modified) > mark).join(known.select(key), key, "left_semi")
