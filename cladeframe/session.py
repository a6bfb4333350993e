"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: str = "8", app: str = "cladeframe", memory: str = "20g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative plan with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = os.path.join(tempfile.mkdtemp(prefix="cladeframe-"), "checkpoint")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
