"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_shared: list[DataFrame] = []


def build_session(master: str = "local[*]", app: str = "hydroseries", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Joins carry no broadcast hints: the optimiser broadcasts a side only below
    ``autoBroadcastJoinThreshold`` (planned or measured size) and adaptive
    execution splits skewed partitions of the joins that stay shuffled.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Ordered frames cost far more per byte than a scan: keep tasks apart although their input is small.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests, a laptop) a temporary folder of this machine is used, and only by a local
    master: executors of a cluster would each write to their own disk.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return spark.conf.get("spark.checkpoint.dir", None) or named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the data survives the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def share(df: DataFrame) -> DataFrame:
    """Keep an intermediate result that several branches of one job read.

    Blocks go to memory and executor disk and are recomputed from lineage when an
    executor is lost. Nothing runs until the job does; ``release_shared`` frees the blocks.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _shared.append(df)
    return df


def release_shared(since: int = 0) -> None:
    while len(_shared) > since:
        _shared.pop().unpersist()


@contextmanager
def shared_until_done() -> Iterator[None]:
    """Blocks kept inside are freed at the end, so that repeated loads and streams do not pile them up."""
    before = len(_shared)
    try:
        yield
    finally:
        release_shared(before)
