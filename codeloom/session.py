"""Session helpers: table access, lineage cuts in the shared checkpoint folder, fresh scratch folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "codeloom") -> SparkSession:
    """A session with the settings the library expects (UTC, AQE); used by tests, bench and the command line."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or where it is unset a temporary one (tests only)."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if conf:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(conf)
        return conf
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="codeloom-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written once to the shared folder, so a lost executor loses nothing.

    Spark removes the files once the frame is no longer referenced where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set, as ``build_session`` does; a session of another origin must set it itself, or clear the folder after a run.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Inputs of at least this size for each wanted partition are read as they are split on disk.
SPREAD_BYTES = 64 * 1024 * 1024


def spread(df: DataFrame, key: str, times: int = 3) -> DataFrame:
    """The same rows, spread by a key over all cores before work that costs far more per byte than a shuffle does.

    A file with few row groups otherwise keeps a few cores busy. Only inputs under ``SPREAD_BYTES`` for each of ``times``
    partitions a core are moved; a larger one has splits enough. The number of partitions is fixed, so that AQE does not
    join them again for being small.
    """
    wanted = max(1, df.sparkSession.sparkContext.defaultParallelism * times)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(wanted, key) if size < wanted * SPREAD_BYTES else df


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system interface; a missing path is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
