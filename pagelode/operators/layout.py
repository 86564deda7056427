"""Places of a site's pages in a drawing: rings by depth, children inside their parent's sector.

Places within a family are ranks: all families are sorted by ranges at once, so
a page with very many children is ranked by many tasks, and no window holds a
family or a ring. Sectors are then shared out level by level, each level joining
only its own pages with the one above.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.operators.store import cut

#: Radius of the first ring and its steps, centre, share of a sector that children fill.
RING_START, RING_STEP, CENTRE, FILLED = 150, 130, (550.0, 550.0), 0.9


def ranked(rows: DataFrame, family: str, *order: Column) -> DataFrame:
    """``rows`` with i, the place in the family in this order from 0, and n, the family's size."""
    spark = rows.sparkSession
    sort = [F.asc(family), *order]
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(pieces, *sort).sortWithinPartitions(*sort).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a row a range
    offsets, total = [], 0
    for part in range(pieces):
        offsets.append((part, total))
        total += counts.get(part, 0)
    placed = placed.join(F.broadcast(spark.createDataFrame(offsets, "part int, offset long")), "part").withColumn("at", F.col("at") + F.col("offset")).drop("part", "offset")
    families = placed.groupBy(family).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    return placed.join(families, family).withColumn("i", F.col("at") - F.col("first")).drop("at", "first")


def layout(tree: DataFrame, lost: DataFrame, inlinks: DataFrame) -> DataFrame:
    """(node, depth, x, y) of the pages of a tree (node, depth, parent; depth 0 is the start) and, on the outermost ring with depth -1, of those that nothing reaches.

    Children stand in order of their inlinks, most first; equal ones by node.
    """
    known = tree.join(inlinks, "node", "left").na.fill(0, ["inlinks"])
    ranks = cut(ranked(known.where("depth > 0"), "parent", F.desc("inlinks"), F.asc("node")))
    step = 2 * math.pi / F.col("n")
    level = cut(ranks.where("depth = 1").select("node", "depth", (step * F.col("i")).alias("centre"), (step * FILLED).alias("span")))
    placed, deepest = known.where("depth = 0").select("node", "depth", F.lit(0.0).alias("centre")), 0
    while not level.isEmpty():
        placed, deepest = placed.unionByName(level.drop("span")), deepest + 1
        above = level.select(F.col("node").alias("parent"), F.col("centre").alias("c"), F.col("span").alias("s"))
        span = F.col("s") / F.col("n")
        below = ranks.where(F.col("depth") == deepest + 1).join(above, "parent")
        level = cut(below.select("node", "depth", (F.col("c") - F.col("s") / 2 + span * (F.col("i") + 0.5)).alias("centre"), span.alias("span")))
    radius = F.when(F.col("depth") > 0, RING_START + RING_STEP * F.col("depth")).otherwise(0)
    outside = ranked(lost.select("node", F.lit(0).alias("family")), "family", F.asc("node"))
    outer = RING_START + RING_STEP * (deepest + 1)
    shown = placed.select("node", "depth", "centre", radius.alias("radius")).unionByName(outside.select("node", F.lit(-1).alias("depth"), (2 * math.pi * F.col("i") / F.col("n")).alias("centre"), F.lit(outer).alias("radius")))
    return shown.select("node", "depth", (CENTRE[0] + F.col("radius") * F.cos("centre")).alias("x"), (CENTRE[1] + F.col("radius") * F.sin("centre")).alias("y"))
