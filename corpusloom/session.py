"""The session the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "corpusloom", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive plans and Arrow; ``conf`` wins.

    Without a master from outside it is local with one thread a core.
    """
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
    }
    master = os.environ.get("CORPUSLOOM_MASTER")
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
