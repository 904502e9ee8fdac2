"""Session settings and size-checked physical helpers shared by all jobs."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long texts travel to Python workers in small batches.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # Keep the map-side cut of per-key top-k also for the larger k of samples and vocabularies.
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
    # Keyed streaming state with TTL needs the RocksDB provider.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "msgsieve", master: str | None = None,
                  shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Session with the settings the jobs rely on (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="msgsieve-"), "msgsieve"), "zip", root, "msgsieve")
        spark.sparkContext.addPyFile(archive)
        # The start-up worker of stateful streams reads only the environment.
        paths = [root, spark.sparkContext.environment.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")]
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in paths if x)
        _shipped.add(app)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and streaming state.

    The cluster names it in ``spark.checkpoint.dir``; only when that is unset
    (tests on one machine) is a temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="msgsieve-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch files that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as files under ``path``, for steps that repeat.

    A checkpoint keeps the size that its plan was guessed to have, and a join
    multiplies the guesses of its sides: over some twenty rounds the number
    alone fills the driver.  Files have the size that they have.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input with too few splits (small files, one row group).

    Large inputs already have more splits than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
