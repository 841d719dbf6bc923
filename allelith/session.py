"""One place for the session settings every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "allelith", cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with adaptive execution and UTC time; on a cluster spark-submit's own settings win."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        # checkpoints that nothing refers to any more go
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("ALLELITH_DRIVER_MEMORY", "8g"),
    } | extra
    builder = SparkSession.builder.appName(app).master(os.environ.get("ALLELITH_MASTER", f"local[{cores}]"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
