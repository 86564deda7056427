"""Exact deduplication through a log-structured merge index of text digests.

Entries (digest, doc_id) are cut into memtables of at most MEMTABLE_ROWS rows.
A memtable merges equal digests to the smallest identifier and the number of
rows, before its shuffle, and is flushed as one run: BUCKETS files by the hash
of the digest, each sorted by digest, with Bloom filters for point lookups. All
runs lie in one bucketed table, so compaction merges them bucket by bucket
without a shuffle, keeping the smallest identifier and the sum of rows.

Digests with several rows are hits. Their filter, a bitmap of hash slots of
SLOTS bits a hit, is probed by every document before anything else is done for
it: only documents that pass are joined with the hits, and their normalised
texts are compared byte for byte before the digest is believed. The others are
alone with their text and are never dealt again.

Only DataFrame and SQL operations are used.

Defined results: a null text counts as empty; repeated rows of one doc_id are
rows of their group like any other and share their fate; ties of text go to the
smallest doc_id; a null doc_id never becomes keep_id while its group has
another one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import BROADCAST_KEYS, cut, fresh_path, partitions, small_side

MEMTABLES = 4
MEMTABLE_ROWS = 50_000_000
#: Bits of the filter for each hit, bits of a bitmap (fixed by bitmap_construct_agg), and bytes of bitmaps that may be broadcast.
SLOTS = 16
BITMAP_BITS = 32_768
FILTER_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


class DigestIndex:
    """Runs of (digest, keep_id, n) in one bucketed table below a folder of the shared store."""

    def __init__(self, spark, path: str, buckets: int | None = None):
        self.spark, self.path, self.levels = spark, path, []
        self.name, self.versions = f"digests_{uuid.uuid4().hex}", 0
        self.buckets = buckets or partitions(spark)
        self.rows = 0

    def _write(self, merged: DataFrame, mode: str) -> None:
        table = f"{self.name}_{self.versions}"
        (
            # the same hash as the buckets': a task writes the bucket it holds
            merged.repartition(self.buckets, "digest")
            .write.mode(mode)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", f"{self.path}/{table}")
            .option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.expected.ndv#digest", str(max(1000, self.rows // self.buckets)))
            .saveAsTable(table)
        )

    def flush(self, entries: DataFrame, rows: int | None = None) -> None:
        """Flush a memtable of (doc_id, digest) as one run; ``rows``, counted if not given, sizes its filters."""
        rows = entries.count() if rows is None else rows
        self.rows = max(self.rows, rows)
        memtable = entries.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        self._write(memtable, "append")
        self.levels.append(rows)

    def runs(self) -> DataFrame:
        return self.spark.table(f"{self.name}_{self.versions}")

    def compact(self) -> DataFrame:
        """Merge all runs into one, within buckets; the smallest identifier of each digest stays."""
        merged = self.runs().groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        self.versions += 1
        self.rows = sum(self.levels)
        self._write(merged, "overwrite")
        self.spark.sql(f"DROP TABLE {self.name}_{self.versions - 1}")  # its files stay in the shared folder
        self.levels = [self.rows]
        return self.runs()

    def lookup(self, digests: list[str]) -> DataFrame:
        """Point lookup; the digests reach the scan as pushed filters, so Bloom filters skip row groups."""
        return self.runs().where(F.col("digest").isin(digests)).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


class Filter:
    """Bitmaps of the hash slots of digests: a digest whose slot is empty isn't among them."""

    def __init__(self, digests: DataFrame, count: int, limit: int = FILTER_BYTES):
        self.buckets = max(1, -(-count * SLOTS // BITMAP_BITS))
        self.fits = self.buckets * BITMAP_BITS // 8 <= limit
        slot = self._slot(F.col("digest"))
        self.bitmaps = digests.groupBy(F.floor(slot / BITMAP_BITS).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(slot % BITMAP_BITS).alias("bitmap"))

    def _slot(self, digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.buckets * BITMAP_BITS))

    def flagged(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a column maybe: false if the column digest surely isn't among the digests; always true if the filter is too large to broadcast."""
        if not self.fits:
            return rows.withColumn("maybe", F.lit(True))
        slot = self._slot(F.col("digest"))
        byte = F.conv(F.hex(F.substring("bitmap", F.floor(slot % BITMAP_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = rows.withColumn("bucket", F.floor(slot / BITMAP_BITS).cast("int")).join(F.broadcast(self.bitmaps), "bucket", "left")
        return found.withColumn("maybe", F.coalesce(F.floor(byte / F.pow(F.lit(2), slot % 8)) % 2 == 1, F.lit(False))).drop("bucket", "bitmap")


def exact_dedup(
    docs: DataFrame,
    path: str | None = None,
    digest: Callable[[Column], Column] = sha256,
    memtable_rows: int = MEMTABLE_ROWS,
    broadcast_keys: int = BROADCAST_KEYS // 4,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept.

    ``digest`` maps the normalised text to a string; any function of the text
    gives right results, since hits are verified on their bytes.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "digests")
    total = docs.count()
    memtables = max(MEMTABLES, -(-total // memtable_rows))
    entries = docs.select("doc_id", digest(normalised(F.col("text"))).alias("digest")).withColumn("memtable", F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).cast("int"))
    entries.write.partitionBy("memtable").parquet(f"{path}/entries")
    entries = spark.read.schema(entries.schema).parquet(f"{path}/entries")
    index = DigestIndex(spark, path)
    for m in range(memtables):
        index.flush(entries.where(F.col("memtable") == m), total // memtables + 1)
    hits = index.compact().where("n > 1").select("digest", "keep_id", F.col("n").alias("group_size"))
    count = hits.count()
    known = Filter(hits, count, filter_bytes)
    bodies = docs.select("doc_id", normalised(F.col("text")).alias("body")).withColumn("digest", digest(F.col("body")))
    bodies = known.flagged(bodies).where("maybe").drop("maybe").join(small_side(hits.select("digest"), count, broadcast_keys), "digest", "left_semi")
    # equal least and greatest text: every text of the digest has the same bytes; both merge before the shuffle
    clashing = cut(bodies.groupBy("digest").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo <> hi").select("digest"))
    labelled = entries.select("doc_id", "digest")
    if count <= broadcast_keys:
        labelled = labelled.join(F.broadcast(hits), "digest", "left")
    else:  # only what passes the filter is dealt
        flagged = known.flagged(labelled)
        lone = flagged.where("not maybe").select("doc_id", "digest", F.lit(None).cast(hits.schema["keep_id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
        labelled = flagged.where("maybe").drop("maybe").join(hits, "digest", "left").select(lone.columns).unionByName(lone)
    alone = F.col("group_size").isNull()
    labelled = labelled.select("doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    if not clashing.isEmpty():
        split = bodies.join(clashing, "digest", "left_semi").groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        again = bodies.join(clashing, "digest", "left_semi").join(split, ["digest", "body"]).select("doc_id", "digest", "keep_id", "group_size")
        labelled = labelled.join(clashing, "digest", "left_anti").unionByName(again.select(labelled.columns))
    return labelled.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
