"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """Local session with the settings the tests and the bench use; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mnemospark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MNEMOSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``directory`` (a file or a folder)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for checkpoints and written tables: the session's ``spark.checkpoint.dir``.

    Only where that is unset on a local master (tests, one machine) a temporary one is made. A cluster without the setting
    is an error: its machines share no temporary folder.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="mnemospark-checkpoint-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the reliable checkpoint folder all executors share (see ``shared_folder``)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as parquet below the checkpoint folder, until the session ends. For rows with lists of
    words, which take about a tenth of a checkpoint's bytes there.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.parquet(folder)


def busy_partitions(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a stage that computes much on little data, which AQE would coalesce by size: three a core and at
    least the session's shuffle partitions. Passed to ``repartition``, which AQE leaves alone.
    """
    return max(least, 3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
