"""Sharding by longest-processing-time scheduling.

Equal texts form a group that stays together. Groups go, largest first, to the
least loaded shard, which a heap yields. A heap over every group of a large
corpus would not fit one machine, so only groups above 1/HEAVY of all bytes
are scheduled one by one (there are fewer than HEAVY of them); the others are
first gathered by hash into BUNDLES bundles, each scheduled as one group. The
driver so sees at most HEAVY + BUNDLES rows at any scale, and shards differ by
less than the largest scheduled item.

Defined results: a null text has no bytes, forms one group with the empty text
and has crc32 0; repeated rows are separate rows of one group; rows with equal
ids get different slots; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.common import cut

HEAVY = 4096
BUNDLES = 4096
SLOT_CELLS = 1024


def lpt(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Key to shard for (size, key) items: largest first, each to the least loaded shard; ties by key, then by shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard(docs: DataFrame, shards: int = 16, heavy: int = HEAVY, bundles: int = BUNDLES) -> DataFrame:
    """(doc_id, size, text_crc32, grp, shard, slot) of every row; slot counts from 0 without gaps inside a shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("grp"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundle = F.pmod(F.xxhash64(F.lit(11), "grp"), F.lit(bundles))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"))
    is_heavy = F.col("size") * F.lit(heavy) > F.lit(total)
    large = groups.where(is_heavy).select("grp", "size").collect()  # fewer than ``heavy`` rows
    rest = groups.where(~is_heavy).groupBy(bundle.alias("bundle")).agg(F.sum("size").alias("size")).collect()  # at most ``bundles`` rows
    large.sort(key=lambda r: r["grp"])
    plan = lpt([(r["size"], i) for i, r in enumerate(large)] + [(r["size"], len(large) + r["bundle"]) for r in rest], shards)
    direct = spark.createDataFrame([(r["grp"], plan[i]) for i, r in enumerate(large)], "grp long, heavy_shard int")
    by_bundle = spark.createDataFrame([(r["bundle"], plan[len(large) + r["bundle"]]) for r in rest], "bundle long, bundle_shard int")
    placed = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(direct), "grp", "left")
        .join(F.broadcast(by_bundle), "bundle", "left")
        .withColumn("shard", F.coalesce("heavy_shard", "bundle_shard"))
        .select("doc_id", "size", "text_crc32", "grp", "shard")
    )
    return with_slots(placed)


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds slot: rows are numbered inside cells of (shard, hash of id), then each cell is shifted by the rows before it."""
    celled = placed.withColumn("cell", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(SLOT_CELLS)).cast("int"))
    counts = celled.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))  # at most shards * SLOT_CELLS rows
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "grp")
    numbered = celled.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(shift), ["shard", "cell"]).withColumn("slot", (F.col("inside") + F.col("shift")).cast("long")).drop("cell", "inside", "shift")
