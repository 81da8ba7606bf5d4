"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options results depend on: months and dates are cut in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: str | int = "*", partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kuchikomi")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    if shared:
        builder = builder.config(CHECKPOINT_SETTING, shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


@functools.cache
def _temporary_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local-mode session without the setting gets a temporary folder of its own, removed at exit; a cluster without it
    is an error, because a folder of one machine would be lost with that machine.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by the whole cluster")
        folder = _temporary_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Most rows and bytes of one Arrow batch where whole texts or their tokens pass through Python.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are small from now on, never larger than the session says; a task holds several copies of each on both sides."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for setting, limit in BATCH_LIMITS.items():
        if not 0 < size(spark.conf.get(setting)) <= limit:
            spark.conf.set(setting, str(limit))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
