"""A watch job: one stream of events, several checks, each with its own sink.

The job runs until what has arrived is read (``availableNow``). For each batch
every check works on the same rows and writes its result below the batch's
number, so a batch that runs again after a restart replaces what it wrote. A
check that fails leaves an error row in place of its result, and the others go
on; what a check returns as None is skipped. The last row of a batch says how
many checks ran and failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "batch long, check_name string, state string, error string"
#: Characters of an error.
ERROR = 200


def run_checks(rows: DataFrame, batch: int, checks: dict[str, Callable[[DataFrame], DataFrame | None]], folder: str) -> list[tuple]:
    """Run every check over the rows of a batch; (batch, check_name, state, error) of each, written as the batch's run."""
    spark, told = rows.sparkSession, []
    rows = rows.persist()
    try:
        for name, check in checks.items():
            try:
                out = check(rows)
                if out is None:
                    told.append((batch, name, "skipped", None))
                    continue
                out.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/checks/{name}/run={batch}")
                told.append((batch, name, "done", None))
            except Exception as e:  # noqa: BLE001 - a failed check must not stop the others
                told.append((batch, name, "failed", " ".join(str(e).split())[:ERROR]))
        spark.createDataFrame(told, RUNS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs/run={batch}")
    finally:
        rows.unpersist()
    return told


def watch(events: DataFrame, checks: dict[str, Callable[[DataFrame], DataFrame | None]], folder: str) -> None:
    """Run the job over what the stream ``events`` has to read; it goes on where it stopped before."""
    each = lambda rows, batch: run_checks(rows, batch, checks, folder) and None
    query = events.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, check_name, state, error) of all batches."""
    return spark.read.schema(RUNS).parquet(f"{folder}/runs/*")


def results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/checks/{name}/*")
