"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_owner: ContextVar[list[str] | None] = ContextVar("stage_owner", default=None)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC, the zone every timestamp rule here is written in."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs
    in one process (tests, a laptop) a temporary folder is created; executors on other
    machines would each write to a disk of their own.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return prepare(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quotelake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    Used where several later steps read the same rows. The files survive lost executors,
    and as Parquet they keep column pruning and size statistics, which a cached or
    checkpointed frame would not.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    owner = _owner.get()
    if owner is not None:
        owner.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owning(paths: list[str]):
    """Note in ``paths`` the folders that :func:`stage` writes in this block, so that their owner can release them."""
    token = _owner.set(paths)
    try:
        yield paths
    finally:
        _owner.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged folders that nothing will read again, and empty the list."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
