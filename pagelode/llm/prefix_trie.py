"""Trie of the prefixes that conversations share, summed by leaf-peeling message passing.

Turns are dealt by ranges of (conversation, turn, digest), so a conversation of
any length is numbered by many tasks: each counts within its range, and the few
conversations that straddle ranges get what lies before. From there on a turn is
its number, a 128-bit digest and a length in bytes; texts aren't shuffled.

A prefix is named by the XOR of hashes of its (position, digest) pairs, 128 bits
in all, which running windows over bounded cells yield, again without a whole
conversation in one task. Equal names are one node.

Every node follows the member whose hashed id is greatest; nodes that follow the
same member form a run, a stretch of that conversation from some depth to its
end. As hashed ids are in random order, a walk from the root to any node crosses
O(log conversations) runs on average, whatever the shape of the trie, so long
conversations cost no rounds. Peeling works on runs: each holds the counter of
its nodes' children outside it. A run whose counter is zero is finished: it sends
leaves and saved bytes of its subtree to the node above its top, and counters
above go down, until only the root's run finishes. Running sums along each run
then give every node its subtree's totals.

Defined results: rows without conv_id belong to no conversation; null role or
text counts as empty; turns go null first, and rows of equal turn by digest of
role and text, so repeated rows are turns of their own; conversations without
rebuilt turns are members of the root only; an empty table has no root and gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagelode.llm.common import partitions, small_side, written

#: Conversations of one family take their first turns from the family's first.
FAMILY = 5
#: At most HEAD - 1 turns are taken.
HEAD = 9
#: Positions or depths that one window holds.
CELL = 1024
#: Ids whose text is joined in one piece before it is hashed.
PIECE = 4096
NODE = ["depth", "a", "b"]


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def head_of(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD).cast("int")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, digest, bytes): the turns of each conversation, numbered from 1."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest")]
    ranged = turns.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("conv_id", "digest", "bytes", F.spark_partition_id().alias("part"))

    def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            at = np.arange(len(conv))
            fresh = np.append(True, conv[1:] != conv[:-1])
            local = at - np.maximum.accumulate(np.where(fresh, at, 0)) + 1
            if conv[0] == last:
                local[conv == last] += count
            last, count = conv[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], [*batch.schema.names, "local"])

    local = written(ranged.mapInArrow(count_up, "conv_id long, digest binary, bytes long, part int, local long"), "turns")
    # at most two conversations of a range can go on in another one
    ends = local.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    ends = ends.select(F.explode(F.array("lo", "hi")).alias("conv_id")).distinct()
    pieces = local.join(F.broadcast(ends), "conv_id").groupBy("conv_id", "part").agg(F.max("local").alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.select("conv_id", "part", F.sum("rows").over(earlier).alias("before")).where("before is not null")  # at most a row a range
    return local.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("p"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every conversation, and (conv_id, length, pos, digest, bytes) of its rebuilt turns."""
    sizes = turns.groupBy("conv_id").agg(F.max("p").alias("n"))
    bases = sizes.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    found = sizes.select("conv_id", "n", base_of(F.col("conv_id")).alias("base"), head_of(F.col("conv_id")).alias("h")).join(bases, "base", "left")
    taken = F.least(F.coalesce("base_n", F.lit(0)), "h")
    convs = written(found.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    own = turns.join(convs, "conv_id").where("p > h").select("conv_id", "length", (F.col("taken") + F.col("p") - F.col("h")).alias("pos"), "digest", "bytes")
    heads = turns.where((F.col("p") < HEAD) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "p", "digest", "bytes")
    lent = heads.join(convs, "base").where("p <= h").select("conv_id", "length", F.col("p").alias("pos"), "digest", "bytes")
    return convs.select("conv_id", "length"), own.unionByName(lent)


def running(rows: DataFrame, key: str, at: str, long: Column, totals: dict[str, tuple], cell: int, down: bool = False) -> DataFrame:
    """``rows`` with running totals over ``at`` within ``key``: {new column: (column, aggregate, operation)}.

    Windows cover cells of ``cell`` positions; groups marked by ``long`` may
    have several cells and get what lies before each from the cells' totals.
    ``rows`` are read twice, so they should be a table.
    """
    order = (lambda c: F.desc(c)) if down else F.asc
    rows = rows.withColumn("cell", F.floor(F.col(at) / cell))
    cells = rows.where(long).groupBy(key, "cell").agg(*(agg(column).alias(new) for new, (column, agg, _) in totals.items()))
    before = Window.partitionBy(key).orderBy(order("cell")).rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select(key, "cell", *(agg(new).over(before).alias(f"{new}_before") for new, (_, agg, _) in totals.items()))
    before = before.where(F.col(f"{next(iter(totals))}_before").isNotNull())
    inside = Window.partitionBy(key, "cell").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.repartition(key, "cell").select("*", *(agg(column).over(inside).alias(new) for new, (column, agg, _) in totals.items()))
    count = before.count()
    if count:
        out = out.join(small_side(before, count), [key, "cell"], "left")
        out = out.withColumns({new: F.coalesce(op(F.col(new), F.col(f"{new}_before")), F.col(new)) for new, (_, _, op) in totals.items()})
    return out.drop("cell", *(f"{new}_before" for new in totals))


def prefixes(turns: DataFrame, cell: int) -> DataFrame:
    """(conv_id, length, depth, a, b, x, y, bytes): the name (a, b) of each rebuilt prefix; its parent's is (a ^ x, b ^ y)."""
    hashed = written(turns.select("conv_id", "length", F.col("pos").alias("depth"), "bytes", F.xxhash64(F.lit(1), "pos", "digest").alias("x"), F.xxhash64(F.lit(2), "pos", "digest").alias("y")), "steps")
    xor = lambda p, q: p.bitwiseXOR(q)
    return written(running(hashed, "conv_id", "depth", F.col("length") >= cell, {"a": ("x", F.bit_xor, xor), "b": ("y", F.bit_xor, xor)}, cell), "prefixes")


def nodes_of(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """One row a node: its name, parent's name, members, run, children, and parent's run and conv_id."""
    member = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max(F.xxhash64("conv_id")).alias("run")]
    root = convs.agg(*member).where("n_convs > 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "n_convs", "conv_id", "run", *(F.lit(None).cast("long").alias(c) for c in ("up_a", "up_b")), F.lit(0).cast("long").alias("bytes"))
    below = paths.groupBy(*NODE).agg(*member, F.max("x").alias("x"), F.max("y").alias("y"), F.max("bytes").alias("bytes"))
    below = below.select(*NODE, "n_convs", "conv_id", "run", F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b"), "bytes")
    nodes = written(below.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("up_depth", F.col("depth") - 1)
    parents = nodes.select(F.col("depth").alias("up_depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.col("run").alias("up_run"))
    return written(counted.join(parents, ["up_depth", "up_a", "up_b"], "left"), "tree")


def peel(tree: DataFrame) -> DataFrame:
    """(up_depth, up_a, up_b, saved, leaves): subtree totals of every finished run, addressed to the node above its top."""
    top = ~F.col("run").eqNullSafe(F.col("up_run"))
    pending = tree.groupBy("run").agg(
        (F.sum("n_children") - F.count("*") + 1).alias("remaining"),  # children outside the run
        F.sum("own_saved").alias("saved"),
        F.sum("own_leaves").alias("leaves"),
        F.max(F.col("depth")).alias("bottom"),
        *(F.max(F.when(top, F.col(c))).alias(c) for c in ("up_run", "up_depth", "up_a", "up_b")),
    )
    pending, finished = written(pending, "runs"), []
    while True:
        finished.append(pending.where("remaining = 0"))
        waiting = pending.where("remaining > 0")
        if waiting.isEmpty():
            break
        sent = finished[-1].groupBy(F.col("up_run").alias("run")).agg(F.count("*").alias("done"), F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        received = waiting.join(sent, "run", "left").withColumns(
            {
                "remaining": F.col("remaining") - F.coalesce("done", F.lit(0)),
                "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)),
                "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)),
            }
        )
        pending = written(received.select(*pending.columns), "runs")
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def digests_of_ends(ends: DataFrame, piece: int) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes where conversations end.

    Ids are joined in pieces of at most ``piece`` ids; a node's pieces stream
    through one hash in order, so no list of all of them forms.
    """
    pieces = ends.groupBy(*NODE, F.floor(F.col("conv_id") / piece).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    kinds = "depth long, a long, b long, ends_sha256 string"
    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            rows = []
            for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != at:
                    if at is not None:
                        rows.append((*at, state.hexdigest()))
                    at, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*at, state.hexdigest()), strict=True))], schema)

    return ordered.mapInArrow(hash_all, kinds)


def trie(conversations: DataFrame, cell: int = CELL, piece: int = PIECE) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(numbered(conversations))
    paths = prefixes(turns, cell)
    tree = nodes_of(convs, paths)
    tree = tree.withColumns({"own_saved": (F.col("n_convs") - 1) * F.col("bytes"), "own_leaves": (F.col("n_children") == 0).cast("long")})
    light = peel(tree).where("up_run is not null").groupBy("up_depth", "up_a", "up_b").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    light = light.select(F.col("up_depth").alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"), "more_saved", "more_leaves")
    whole = written(
        tree.join(light, NODE, "left").withColumns(
            {"own_saved": F.col("own_saved") + F.coalesce("more_saved", F.lit(0)), "own_leaves": F.col("own_leaves") + F.coalesce("more_leaves", F.lit(0))}
        ),
        "contributions",
    )
    add = lambda p, q: p + q
    summed = running(whole, "run", "depth", F.lit(True), {"saved_tokens": ("own_saved", F.sum, add), "n_leaves": ("own_leaves", F.sum, add)}, cell, down=True)
    zero = [F.lit(0).cast("long").alias(c) for c in NODE]
    ends = paths.where("depth = length").select(*NODE, "conv_id").unionByName(convs.where("length = 0").select(*zero, "conv_id"))
    out = summed.join(digests_of_ends(ends, piece), NODE, "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
