"""Session settings that the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "voltlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword names use two underscores for each dot."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    if master or "SPARK_MASTER" in os.environ:
        b = b.master(master or os.environ["SPARK_MASTER"])
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
