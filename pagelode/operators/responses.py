"""Cache of responses with a ledger of what they cost, safe against batches that come twice.

A cache is a folder of versions and batches. Each batch writes one ledger folder
and one version: the rows of the version before that no new response replaces,
and the batch's last response of each key. The manifest, renamed into place at
the end, names the version, the batches in it and nothing that a failed batch
left. A batch whose number the manifest has changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import words as W
from pagelode.functions.text import names_of

RESPONSES = "key string, command string, body string, cost double, detail string, ts long"
LEDGER = "batch long, ts long, command string, cost double, detail string"
#: Characters of a ledger row's detail.
DETAIL = 120


class ResponseCache:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The last whole state: version, and the ledger folder of each batch."""
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(self.folder))] if self.files.exists(self.path(self.folder)) else []
        last = max((n for n in names if n.startswith("manifest-")), default=None)
        if last is None:
            return {"version": None, "at": 0, "batches": {}}
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.folder}/{last}").collect()))

    def responses(self) -> DataFrame:
        """The last response of each key."""
        version = self.manifest()["version"]
        return self.spark.read.schema(RESPONSES).parquet(f"{self.folder}/{version}") if version else self.spark.createDataFrame([], RESPONSES)

    def ledger(self) -> DataFrame:
        """One row for each response that was paid for."""
        paths = [f"{self.folder}/{p}" for p in self.manifest()["batches"].values()]
        return self.spark.read.schema(LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER)

    def fresh(self, now: int) -> DataFrame:
        """The responses that are still within their command's time."""
        ttl = F.coalesce(names_of(W.TTL)[F.col("command")], F.lit(W.DEFAULT_TTL))
        return self.responses().where(F.lit(now) - F.col("ts") <= ttl)

    def apply(self, batch: int, rows: DataFrame) -> bool:
        """Put a batch of responses (RESPONSES) into the cache and its costs into the ledger; False if the batch is in already."""
        state = self.manifest()
        if str(batch) in state["batches"]:
            return False
        tag = uuid.uuid4().hex
        rows = rows.select(*(c.split()[0] for c in RESPONSES.split(", ")))
        rows.select(F.lit(batch).cast("long").alias("batch"), "ts", "command", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.substring(F.coalesce("detail", F.lit("")), 1, DETAIL).alias("detail")).write.parquet(f"{self.folder}/ledger-{batch}-{tag}")
        columns = [c for c in rows.columns if c != "key"]
        last = rows.where("key is not null").groupBy("key").agg(F.max(F.struct("ts", *(c for c in columns if c != "ts"))).alias("r"))
        last = last.select("key", *(F.col(f"r.{c}").alias(c) for c in columns))
        both = self.responses().withColumn("newer", F.lit(0)).unionByName(last.withColumn("newer", F.lit(1)))
        merged = both.groupBy("key").agg(F.max(F.struct("ts", "newer", *(c for c in columns if c != "ts"))).alias("r"))
        merged.select("key", *(F.col(f"r.{c}").alias(c) for c in columns)).write.parquet(f"{self.folder}/version-{tag}")
        after = {"version": f"version-{tag}", "at": state["at"] + 1, "batches": {**state["batches"], str(batch): f"ledger-{batch}-{tag}"}}
        self._publish(after)
        return True

    def _publish(self, state: dict) -> None:
        draft, final = self.path(f"{self.folder}/_manifest-{uuid.uuid4().hex}"), self.path(f"{self.folder}/manifest-{state['at']:012d}")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self.files.rename(draft, final):
            raise RuntimeError(f"another writer published state {state['at']} of {self.folder}")
