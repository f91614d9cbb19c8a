"""Session set-up and the shared folder used for checkpoints and scratch tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "*", app: str = "skyloom", memory: str = "8g") -> SparkSession:
    """Session for tests and benches; a cluster brings its own configuration."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.

    It is read from the session. Only a local master, where driver and tasks
    are one process, may do without the setting; on a cluster a machine-local
    folder would lose rows, so that is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="skyloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def _scratch_root(spark: SparkSession) -> str:
    """This application's folder below the shared one; Hadoop deletes it when the driver ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark).rstrip('/')}/skyloom-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_stored(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that is no longer read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nobody holds; by itself it does when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame to the shared folder and continue from the files.

    Cuts the lineage and survives the loss of executors, and several
    consumers of one costly stage read it instead of recomputing it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
