"""Session settings shared by the tests, the bench and the command-line jobs."""

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app="pricebook", master=None, shuffle_partitions=None):
    """A session with the settings the library relies on.

    On a cluster ``master`` and the sizes come from spark-submit; only the
    semantic settings (UTC, AQE) are forced here.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        b = b.config("spark.driver.memory", os.environ.get("PRICEBOOK_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_dir(spark):
    """The shared checkpoint folder named by the cluster.

    A folder of our own is set only where the setting is missing and the
    session is local (tests); a cluster must name a shared one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="pricebook-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path
