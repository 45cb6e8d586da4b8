"""Session helper: the settings every entry point and test shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer switched on."""
    builder = (
        SparkSession.builder.master(master)
        .appName("quarry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reliable(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder that spark.checkpoint.dir names, or, where it names none and
    all runs on one machine, in one of our own.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
            base = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        sc.setCheckpointDir(base)
    return df.checkpoint()
