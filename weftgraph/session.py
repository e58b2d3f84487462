"""A session with the settings the plans expect."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "weftgraph", **conf: object) -> SparkSession:
    """Get or create a session: adaptive plans, UTC, Arrow. Everything else is the cluster's business."""
    builder = SparkSession.builder.appName(name)
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in {**fixed, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset and all runs on one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftgraph-checkpoints-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


@contextmanager
def stored(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes rows as Parquet to the shared folder, once, and reads them from there; the files go at the end.

    For what is read many times, a few columns or rows of it at a time; `saved` is for what is small.
    """
    folder = f"{shared(spark)}/stored-{uuid.uuid4()}"

    def keep(df: DataFrame) -> DataFrame:
        df.write.parquet(at := f"{folder}/{uuid.uuid4()}")
        return spark.read.parquet(at)

    try:
        yield keep
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
