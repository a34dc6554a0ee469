"""The comment table over the driver's tables, and the same as SQL.

``documents`` are the comments; ``events`` gives their times, ``labels`` an analysis, ``benchmark`` quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LICENSE = r"licen[cs]e|copyright"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, id, text, lang, source, submitter, organization, received, posted, analysis, truth."""
    d, e, g = (table(spark, sf_dir, t) for t in ("documents", "events", "labels"))
    e = e.select(F.col("event_id").alias("doc_id"), F.to_date("ts").alias("received"))
    out = d.join(e, "doc_id", "left").join(g.select("doc_id", "quality", "toxic"), "doc_id", "left")
    position = F.when(F.col("toxic") == 1, F.array(F.lit("Position: Oppose"))).when(F.col("quality") == 1, F.array(F.lit("Position: Support"))).otherwise(F.array().cast("array<string>"))
    concern = F.when(F.col("text").rlike("(?iu)" + LICENSE), F.array(F.lit("Concern: license"))).otherwise(F.array().cast("array<string>"))
    stances = F.concat(position, F.array(F.concat(F.lit("Concern: "), F.col("lang"))), concern)
    day = F.date_format("received", "yyyy-MM-dd")
    return out.select(
        F.col("doc_id").alias("row_idx"),
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("id"),
        "text",
        "lang",
        "source",
        F.when(F.col("doc_id") % 11 == 0, "Anonymous Anonymous").otherwise(F.concat(F.lit("Submitter "), (F.col("doc_id") % 97).cast("string"))).alias("submitter"),
        F.when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise("").alias("organization"),
        F.coalesce(day, F.lit("")).alias("received"),
        F.coalesce(F.date_format(F.date_add("received", (F.col("doc_id") % 33).cast("int")), "yyyy-MM-dd"), F.lit("")).alias("posted"),
        F.when(F.col("quality").isNotNull(), F.struct(stances.alias("stances"), F.when((F.col("toxic") == 0) & (F.col("quality") == 0), "Unclear").alias("verified_stance"))).alias("analysis"),
        F.col("quality").alias("truth"),
    )


#: the same columns for the oracle; stances as a list, null without a label
COMMENTS_SQL = r"""
comments AS (
  SELECT d.doc_id AS row_idx, 'DOC-' || CAST(d.doc_id AS VARCHAR) AS id, d.text, d.lang, d.source,
    CASE WHEN d.doc_id % 11 = 0 THEN 'Anonymous Anonymous' ELSE 'Submitter ' || CAST(d.doc_id % 97 AS VARCHAR) END AS submitter,
    CASE WHEN d.doc_id % 7 = 0 THEN d.source ELSE '' END AS organization,
    coalesce(strftime(CAST(e.ts AS DATE), '%Y-%m-%d'), '') AS received,
    coalesce(strftime(CAST(e.ts AS DATE) + CAST(d.doc_id % 33 AS INTEGER), '%Y-%m-%d'), '') AS posted,
    g.quality AS truth, g.toxic AS toxic,
    CASE WHEN g.quality IS NULL THEN NULL WHEN g.toxic = 1 THEN 'Oppose' WHEN g.quality = 1 THEN 'Support' ELSE 'Unclear' END AS pos,
    (g.quality IS NOT NULL) AS analysed,
    regexp_matches(d.text, '(?i)licen[cs]e|copyright') AS licensed
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels g ON g.doc_id = d.doc_id)
"""
