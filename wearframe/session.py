"""Spark session settings used by the benchmark and the tests."""

import os

from pyspark import SparkConf
from pyspark.sql import SparkSession


def build_session(app="wearframe", master=None, shuffle_partitions=None):
    """A session with adaptive execution, UTC time and Arrow transfer.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset, so that
    spark-submit and adaptive coalescing decide them, and set ``spark.checkpoint.dir``
    to a folder that all executors share.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if master and master.startswith("local") and not master.startswith("local-cluster"):
        # one machine: its own folder serves all executors, unless the defaults or the environment name one
        builder = builder.config("spark.driver.memory", "12g")
        if not SparkConf().get("spark.checkpoint.dir", None):
            builder = builder.config("spark.checkpoint.dir", os.environ.get("WEARFRAME_CHECKPOINTS", "/tmp/wearframe-checkpoints"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
