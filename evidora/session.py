"""Sessions for local runs; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(master: str = "local[*]", partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution, and as many shuffle partitions as twice the cores unless told otherwise."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if here not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (here, os.environ.get("PYTHONPATH"))))
    builder = SparkSession.builder.master(master).appName("evidora").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("EVIDORA_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions or max(8, 2 * spark.sparkContext.defaultParallelism)))
    return spark
