"""Session defaults for local runs; a cluster brings its own settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local[cores] session as tests and the benchmark use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("penstock")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows, written to the folder that spark.checkpoint.dir names; where that is unset, a local master gets a folder of its own, any other an error."""
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        base = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="spark-checkpoints-")
        context.setCheckpointDir(base)
    return rows.checkpoint()
