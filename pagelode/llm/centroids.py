"""Centroid clustering: Lloyd's rounds in whole numbers, nearest centroids by annulus search.

Vectors become integers, floor(SCALE * x), and lie packed in a written table.
Each round sends the centroids to the tasks. There the centroids are sorted by
norm. The few whose norms are nearest to a vector's give an upper bound u of its
least distance; by the triangle inequality only centroids whose norm lies within
u of the vector's, its annulus, can be as near. Two binary searches find them,
and they are compared exactly, ties included, by smaller number. Vectors are
taken in order of their norm, so a block shares one slice of the sorted
centroids and one matrix product.

Tasks emit sums and counts of each centroid's vectors, which Spark adds; the
driver sees (components + 1) rows a centroid, however many vectors there are.

Defined results: vectors that are null, of another length or with a null or
non-finite component are left out; a null vec_id is clustered like any other,
but starts no centroid unless vectors with an id are too few; rows that share a
vec_id are separate vectors, and of equal start hashes the least components come
first; fewer vectors than centroids make as many centroids as vectors; an empty
table gives an empty result; further columns are ignored. Components beyond
LIMIT after scaling are an error, since their distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import written

SCALE = 1024
#: Largest integer component: 64 squared differences of twice as much fit a long.
LIMIT = 1 << 27
#: Components below this have squared distances that doubles hold exactly.
EXACT = 1 << 22
#: Centroids next in norm whose least distance bounds a vector's annulus.
PROBES = 4
#: Vectors that share a slice of the sorted centroids.
BLOCK = 512


class Centroids:
    """Integer centroids sorted by norm, with their numbers."""

    def __init__(self, rows: list[list[int]]):
        values = np.array(rows, dtype=np.int64)
        squares = (values * values).sum(axis=1)
        order = np.lexsort((np.arange(len(rows)), squares))
        self.number, self.values, self.squares = order, values[order], squares[order]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.small = bool(np.abs(values).max(initial=0) < EXACT)

    def annulus(self, vectors: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the range of sorted centroids that may be nearest."""
        norms = np.sqrt(squares.astype(np.float64))
        at = np.searchsorted(self.norms, norms)
        least = np.full(len(vectors), np.iinfo(np.int64).max)
        for near in range(-PROBES // 2, (PROBES + 1) // 2):
            gap = vectors - self.values[(at + near).clip(0, len(self.norms) - 1)]
            least = np.minimum(least, (gap * gap).sum(axis=1))
        bound = np.sqrt(least.astype(np.float64))
        slack = 1e-9 * (norms + bound) + 1e-6  # rounding of the roots loses no boundary tie
        return np.searchsorted(self.norms, norms - bound - slack, "left"), np.searchsorted(self.norms, norms + bound + slack, "right")

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smaller one of equals) and squared distance of each row of ``vectors``."""
        squares = (vectors * vectors).sum(axis=1)
        low, high = self.annulus(vectors, squares)
        exact = np.float64 if self.small and np.abs(vectors).max(initial=0) < EXACT else np.int64
        number, distance = np.empty(len(vectors), np.int32), np.empty(len(vectors), np.int64)
        order = np.argsort(squares, kind="stable")
        for start in range(0, len(order), BLOCK):
            rows = order[start : start + BLOCK]
            first, last = low[rows].min(), high[rows].max()
            these = first + np.argsort(self.number[first:last])  # by number: the first least distance is the smaller number's
            products = vectors[rows].astype(exact) @ self.values[these].astype(exact).T
            found = squares[rows, None] + self.squares[these] - 2 * products.astype(np.int64)
            found[(these < low[rows, None]) | (these >= high[rows, None])] = np.iinfo(np.int64).max
            best = found.argmin(axis=1)
            number[rows], distance[rows] = self.number[these[best]], found[np.arange(len(rows)), best]
        return number, distance


def packed(embeddings: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors with ``dims`` finite components: floor(scale * x) as little-endian 32-bit integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pc.fill_null(pc.equal(pc.list_value_length(batch.column("e")), dims), False)
            batch = batch.filter(whole)
            x = batch.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            finite = np.isfinite(x).all(axis=1)  # a null component is NaN here
            x = np.floor(x[finite] * scale)
            if np.abs(x).max(initial=0) > LIMIT:
                raise ValueError(f"a component beyond {LIMIT} after scaling: its distances would not fit a long")
            data = pa.array([row.tobytes() for row in x.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(finite)), data], ["vec_id", "v"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    return rows.mapInArrow(pack, "vec_id long, v binary")


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(-1, dims)


def partial_sums(vectors: DataFrame, centroids: Centroids, dims: int) -> DataFrame:
    """(cluster, dim, part) sums of each task; dim -1 counts the vectors."""
    k = len(centroids.number)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x = unpacked(batch.column("v"), dims)
            number, _ = centroids.nearest(x)
            order = np.argsort(number, kind="stable")
            present, starts = np.unique(number[order], return_index=True)
            if len(present):
                sums[present, 1:] += np.add.reduceat(x[order], starts, axis=0)
                sums[present, 0] += np.diff(np.append(starts, len(order)))
        there = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(there, dims + 1).astype(np.int32)),
                pa.array(np.tile(np.arange(-1, dims, dtype=np.int32), len(there))),
                pa.array(sums[there].ravel()),
            ],
            ["cluster", "dim", "part"],
        )

    return vectors.select("v").mapInArrow(add, "cluster int, dim int, part long")


def assigned(vectors: DataFrame, centroids: Centroids, dims: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = centroids.nearest(unpacked(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(assign, "vec_id long, cluster int, distance long")


def start(vectors: DataFrame, k: int, salt: str, dims: int) -> list[list[int]]:
    """Components of the ``k`` vectors with the least sha256 of salt and id."""
    rank = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(rank.asc_nulls_last(), "v").limit(k).select("v").collect()
    return [np.frombuffer(r["v"], "<i4").tolist() for r in rows]


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = SCALE, salt: str = "3:") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors, and the final centroids."""
    spark = embeddings.sparkSession
    vectors = written(packed(embeddings, dims, scale), "vectors")
    rows = start(vectors, k, salt, dims)
    kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not rows:
        return spark.createDataFrame([], kinds), []
    for _ in range(rounds):
        sums = partial_sums(vectors, Centroids(rows), dims).groupBy("cluster", "dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
        found = {(r["cluster"], r["dim"]): int(r["total"]) for r in sums.collect()}  # at most k * (dims + 1) rows
        rows = [[found[c, d] // found[c, -1] for d in range(dims)] if (c, -1) in found else row for c, row in enumerate(rows)]
    placed = written(assigned(vectors, Centroids(rows), dims), "assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in rows]
    facts = spark.createDataFrame(
        [(c, total, sum(inertia.values()), digests[c]) for c, total in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return placed.join(F.broadcast(facts), "cluster").select(*(x.split()[0] for x in kinds.split(", "))), rows
