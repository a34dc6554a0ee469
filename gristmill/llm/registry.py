"""Queries of this subpackage, by name, and the SQL that gives the same rows where SQL can.

Every module is imported with this one, so that whoever may do without the subpackage learns of a missing library at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_pipeline import run
from gristmill.llm import chat, decontam, divergence, fair_mix, fim, langid, licenses, minmax, quality_bt, risk_rules, secrets, sql, token_files, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bradley_terry": quality_bt.op1_bradley_terry,
    "op2_token_planes": token_files.op2_token_planes,
    "op3_risk_rules": risk_rules.op3_risk_rules,
    "op4_fair_mix": fair_mix.op4_fair_mix,
    "op5_chat_round_trip": chat.op5_chat_round_trip,
    "op6_lang_embeddings": langid.op6_lang_embeddings,
    "op7_linked_secrets": secrets.op7_linked_secrets,
    "op8_warc_segments": warc.op8_warc_segments,
    "op9_min_max": minmax.op9_min_max,
    "op10_prefix_join": decontam.op10_prefix_join,
    "op11_fill_middle": fim.op11_fill_middle,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_license_join": licenses.op13_license_join,
    "pipeline": run,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE_SQL)
