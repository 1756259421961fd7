"""Session defaults for tests, bench and the command line tools."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", app: str = "arborinfo", **conf: str) -> SparkSession:
    """A session with adaptive execution and Arrow on; ``conf`` overrides any setting.

    On a cluster pass ``master=None`` so that spark-submit decides, and set
    ``spark.checkpoint.dir`` to a shared folder.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Recording the Python call site of every Column costs more than most of our plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if master and master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = "8"
        settings["spark.driver.memory"] = "12g"
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
