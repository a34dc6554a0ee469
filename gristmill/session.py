"""Session defaults of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "gristmill", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return b.config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
