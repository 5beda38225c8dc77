"""Session defaults and lineage cuts.

``cut`` writes a DataFrame to the checkpoint folder the session names in
``spark.checkpoint.dir`` (all executors share it). Only where no folder is set, as in
tests on one machine, a fresh temporary one is taken.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for sessions this library starts itself; a session that is passed in keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str = "archivolt", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine for tests, the bench and trying things out."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name).config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` read back from a checkpoint in the shared folder, so that later steps don't repeat what led to it.

    On a cluster the session must name that folder: one of the driver's own machine, which executors don't see, is never taken.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="archivolt-checkpoint-"))
    return df.checkpoint(eager)


def width(spark: SparkSession) -> int:
    """The number of partitions that shuffles of this session make."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
