"""Session and shared-folder settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "veil") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, for cut lineage. Unset, it is a temporary one on a single machine, and an error on a
    cluster, whose executors and driver share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-veil-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """The same rows with lineage cut in the shared folder, so a lost executor does not replay earlier rounds."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def splits_for(df: DataFrame) -> int:
    """Into how many splits rows are dealt for steps that cost far more than their bytes: two a core, and 16 for each split of ``df``, which
    must be settled. Given to ``repartition``, the number stands; splits of a join are put together again by their bytes."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, 16 * df.rdd.getNumPartitions())
