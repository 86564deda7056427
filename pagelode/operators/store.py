"""Lineage cuts and written tables in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether an action's shuffle files go once it has ended, instead of when the driver's heap fills up.
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder where it is unset and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pagelode-checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` for joins with tables that grow with it: Spark takes a page that an expression makes for 20 bytes, and would send all of them through the driver."""
    return df.hint("merge")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside removes its shuffle files as soon as it has ended."""
    before = spark.conf.get(CLEANS)
    spark.conf.set(CLEANS, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANS, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from Parquet files in the shared folder."""
    to = fresh_path(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables; nothing may read them any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
