"""Shared pieces of the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of longs that may be broadcast: a hashed relation of them stays under about 64 MB.
BROADCAST_KEYS = 1_000_000
#: Rows of an Arrow batch that carries whole texts.
TEXT_ROWS = 500
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; a local one where it is unset and Spark runs in one process (tests)."""
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
    """The rows of ``df`` written to the shared checkpoint folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from Parquet files in the shared folder; smaller than a checkpoint."""
    to = fresh_path(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


@contextmanager
def held(spark: SparkSession, **settings: str):
    """Session settings, dots written as __, for what is executed inside."""
    settings = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what is executed inside; rows that carry whole sets are large."""
    return held(spark, **{ARROW_ROWS: str(rows)})


Batches = Iterator[pa.RecordBatch]


def over_texts(docs: DataFrame, run: Callable[[Batches], Batches], schema) -> DataFrame:
    """mapInArrow over rows with whole texts, in bounded memory.

    The session's Arrow batches shrink to TEXT_ROWS rows at most and stay so, as
    the result may run later; a finished task hands its free memory back.
    """
    spark = docs.sparkSession
    rows = int(spark.conf.get(ARROW_ROWS))
    if not 0 < rows <= TEXT_ROWS:
        spark.conf.set(ARROW_ROWS, str(TEXT_ROWS))
    return docs.mapInArrow(released(run), schema)


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``; when it ends, free memory of Arrow and of the allocator goes back to the system, as workers idle on."""

    def outer(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return outer


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_KEYS) -> DataFrame:
    """A broadcast hint if ``rows`` (counted beforehand) is within ``limit``; else Spark's own choice."""
    return F.broadcast(df) if rows <= limit else df


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def learning_sample(
    docs: DataFrame, labels: DataFrame, label: str, ids: Column, bound: int
) -> DataFrame:
    """(doc_id, text, <label>) of about ``bound`` labelled rows of each label value, at most.

    A value's rows are thinned by a hash of the id at a rate taken from exact
    counts, so the sample is the same on every run and its size doesn't grow
    with the tables. ``ids`` says which ids may be learned from.
    """
    rows = labels.where(F.col(label).isNotNull() & ids).select("doc_id", label).distinct()
    counts = rows.groupBy(label).count()
    kept = (
        rows.join(F.broadcast(counts), label)
        .where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * bound / F.col("count"))
        .select("doc_id", label)
    )
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(kept), "doc_id")


def stands_for(labels: DataFrame, label: str, ids: Column, bound: int) -> dict:
    """How many labelled rows each row of learning_sample() stands for, by label value; 1 where none are left out."""
    rows = labels.where(F.col(label).isNotNull() & ids).select("doc_id", label).distinct()
    return {r[label]: max(1.0, r["count"] / bound) for r in rows.groupBy(label).count().collect()}
