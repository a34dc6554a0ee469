"""A training corpus from raw documents: five stages, each stored and read again as the next one's documents.

Quality rules with controlled risk, near-duplicate removal, benchmark decontamination, mixing of sources, token files.
SQL can't express the tokenizer and the hashing, so there is no SQL for the whole; a test compares ``run`` with a plain program.

Rows, stage by stage (all but the last return the columns they got, whatever their names):

* quality rules: null, empty and short texts fail the base rule and go; a null language is a stratum; without labels only the
  base rule is in use; repeated rows are judged alike.
* near-duplicates: rows that share a doc_id are one document; of a group its least doc_id stays; rows with a null doc_id all stay.
* benchmark decontamination: a document without words stays; null item texts never occur; an empty benchmark leaves all.
* source mixing: a null source is one of the sources, last in order; documents without words are in no mix; rows come as often
  as the mix takes them.  Ties of the shuffle key go by doc_id, then text.
* token output: null text counts as empty; documents by doc_id (null first), then text; each row is a document.

An empty table gives an empty result at every stage, and texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import decontam, fair_mix, minmax, risk_rules, token_files
from gristmill.storage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return risk_rules.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax.keep_one(spark, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fair_mix.mixed_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_output(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("token output", token_output),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(chr(32), chr(45))}")
    return docs
