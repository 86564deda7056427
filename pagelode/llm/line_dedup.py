"""Line deduplication over range-partitioned line hashes.

Hashes of all lines long enough are range-partitioned by (hash, document,
position) and sorted that way inside each partition, so a very frequent line
spreads over as many partitions as it needs. Each partition is streamed once:
the first document of a run of equal hashes keeps its lines, later ones lose
them. A run may start in an earlier partition; the first and last run of every
partition (a few numbers each) are chained on the driver beforehand. The
result is one compressed bitmap of kept lines per document, not the text.

Defined results: a null or empty text is one empty line, which is too short to
be dropped; repeated lines inside the document that keeps them all stay; rows
with one doc_id and the same text share a bitmap, with different texts each has
its own, and all of them count as that document; rows with a null doc_id keep
every line; an empty table gives an empty result; further columns of the input
stay, whatever their names (see ``apply_bitmaps``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import cut, lower_ascii, over_texts, partitions, unused, written

MIN_KEY = 10
BLANKS = " \t\n\x0b\x0c\r"
#: Bitmaps are broadcast up to so many bytes in all, with ROW_BYTES for each row's keys.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(BLANKS)))


def text_hash(text: Column) -> Column:
    """Tells the rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(h1, h2, doc_id, pos, th) of every line whose key has ``min_key`` code points; h1 and h2 make a 128-bit hash, th is the row's text_hash."""
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_hash(F.col("text")).alias("th"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_key)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "pos", "th")


def _columns(batch: pa.RecordBatch):
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First key, last key and the first document of the last key's run within this partition."""
    first = last = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc, _, _ = _columns(b)
        if first is None:
            first = (h1[0], h2[0], doc[0])
        new = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        if len(new) or last is None or (h1[0], h2[0]) != last[:2]:
            at = new[-1] + 1 if len(new) else 0
            last = (h1[at], h2[at], doc[at])
    if first is not None:
        values = [TaskContext.get().partitionId(), *map(int, first), *map(int, last)]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], ["part", "f1", "f2", "fdoc", "l1", "l2", "ldoc"])


def chained(ends: list) -> dict[int, tuple[int, int, int]]:
    """For each partition the run that reaches into it: hash and first document."""
    out: dict[int, tuple[int, int, int]] = {}
    run = None
    for e in sorted(ends, key=lambda x: x["part"]):
        if run is not None and (e["f1"], e["f2"]) == run[:2]:
            out[e["part"]] = run
            if (e["l1"], e["l2"]) == run[:2]:
                continue
        run = (e["l1"], e["l2"], e["ldoc"])
    return out


def _late(carried: dict[int, tuple[int, int, int]]):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = carried.get(TaskContext.get().partitionId())
        for b in batches:
            if not b.num_rows:
                continue
            h1, h2, doc, pos, th = _columns(b)
            new = np.empty(len(h1), bool)
            new[0] = run is None or (h1[0], h2[0]) != run[:2]
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            starts = np.flatnonzero(new)
            first = np.empty(len(h1), np.int64)
            index = np.cumsum(new) - 1
            inside = index >= 0
            first[inside] = doc[starts[index[inside]]]
            if not new[0]:
                first[~inside] = run[2]
            run = (h1[-1], h2[-1], first[-1])
            late = doc > first
            if late.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[late], pa.int64()), pa.array(th[late], pa.int64()), pa.array(pos[late].astype(np.int32), pa.int32())], ["doc_id", "th", "pos"])

    return stream


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps, dropped = [], []
        for n, gone in zip(b.column("n_lines").to_pylist(), b.column("gone").to_pylist(), strict=True):
            keep = np.ones(n, np.uint8)
            if gone:
                keep[gone] = 0
            dropped.append(int(n - keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        arrays = [b.column("doc_id"), b.column("th"), b.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "n_lines", "n_dropped", "keep_bitmap"])


def line_dedup(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(doc_id, th, n_lines, n_dropped, keep_bitmap) of every document that loses lines.

    th: text_hash of the row. keep_bitmap: zlib of the bits of the lines, first line in the highest bit.
    Documents without a row keep all their lines.
    """
    spark = docs.sparkSession
    order = ["h1", "h2", "doc_id", "pos"]
    # written first: finding the ranges would work all lines out a second time
    runs = cut(written(hashed_lines(docs, min_key), "lines").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order))
    ends = runs.mapInArrow(_ends, "part long, f1 long, f2 long, fdoc long, l1 long, l2 long, ldoc long").collect()  # a row per partition
    late = runs.mapInArrow(_late(chained(ends)), "doc_id long, th long, pos int")
    gone = late.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
    sizes = docs.select("doc_id", text_hash(F.col("text")).alias("th"), F.size(split_lines(F.col("text"))).cast("long").alias("n_lines")).dropDuplicates(["doc_id", "th"])
    return gone.join(sizes, ["doc_id", "th"]).mapInArrow(_bitmaps, "doc_id long, th long, n_lines long, n_dropped long, keep_bitmap binary")


def _applied(text_at: int, map_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, maps = b.column(text_at).to_pylist(), b.column(map_at).to_pylist()
            for i, m in enumerate(maps):
                if m is not None:
                    lines = (texts[i] or "").split("\n")
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(m), np.uint8), count=len(lines))
                    texts[i] = "\n".join(line for line, k in zip(lines, keep, strict=True) if k)
            arrays = [pa.array(texts, pa.string()) if i == text_at else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, b.schema.names)

    return run


def apply_bitmaps(docs: DataFrame, maps: DataFrame, dropped: str = "n_dropped", bitmap: str = "keep_bitmap") -> DataFrame:
    """``docs`` with dropped lines cut from text; adds n_dropped and keep_bitmap (null: nothing dropped).

    A column of ``docs`` that already has one of these two names is an error;
    ``dropped`` and ``bitmap`` give them others.
    """
    taken = {c.lower() for c in docs.columns} & {dropped.lower(), bitmap.lower()}
    if taken:
        raise ValueError(f"docs has columns named {sorted(taken)}")
    maps = cut(maps)
    size = maps.agg(F.coalesce(F.sum(F.octet_length("keep_bitmap") + ROW_BYTES), F.lit(0))).first()[0]
    doc, th = unused("__doc", docs), unused("__th", docs)
    side = maps.select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("n_dropped").alias(dropped), F.col("keep_bitmap").alias(bitmap))
    found = (F.col("doc_id") == F.col(doc)) & (text_hash(F.col("text")) == F.col(th))
    joined = docs.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, found, "left").drop(doc, th)
    names = joined.columns
    return over_texts(joined, _applied(names.index("text"), names.index(bitmap)), joined.schema)
