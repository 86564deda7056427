"""Byte-level BPE encoding and decoding with segment trees of pair ranks.

A piece's bytes are leaves of a segment tree: leaf i holds the rank of the pair
that starts at byte i (with i itself in the low bits, so equal ranks resolve to
the leftmost). The root is the next merge. A merge touches three leaves: the
merged token's, the swallowed token's and the left live neighbour's, each a
logarithmic point update; so a piece of n bytes takes O(n log n), however long.

The trees of many pieces of up to TREE_BYTES bytes are rows of one array and
advance together, a merge of each at a time; longer pieces take a tree of their
own. Pieces repeat, so each task keeps the packed ids of those it has met, in
two generations of at most CACHE_PIECES each: the older one is dropped when the
younger one is full. Neither holds pieces over CACHE_CHARS.

Ids travel as little-endian unsigned 32-bit integers in one binary, which is
also how a training shard stores them.

Defined results: a null text encodes like the empty one, to no ids, and decodes
to no bytes; repeated rows are encoded separately; equal ranks resolve to the
leftmost pair; an empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pagelode.llm.common import over_texts

CACHE_PIECES = 60_000
CACHE_CHARS = 48
TREE_BYTES = 64
#: Pieces whose trees advance together, and characters of texts that are split at once.
TREES = 8192
SLICE_CHARS = 1_000_000
#: A leaf or node without a pair.
NONE = np.int64(1 << 62)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    none = 1 << 62
    mask = (1 << 31) - 1
    get = ranks.get
    leaves = 1 << max(0, (n - 2).bit_length())
    tree = [none] * (2 * leaves)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[leaves + i] = rank << 31 | i
    for i in range(leaves - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    end = list(range(1, n + 1))
    before = list(range(-1, n))

    def put(i: int, value: int) -> None:
        i += leaves
        tree[i] = value
        i >>= 1
        while i:
            left, right = tree[2 * i], tree[2 * i + 1]
            least = left if left < right else right
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while tree[1] != none:
        i = tree[1] & mask
        gone = end[i]
        stop = end[gone]
        end[i] = stop
        before[stop] = i
        if gone < n - 1:
            put(gone, none)
        rank = get(piece[i : end[stop]]) if stop < n else None
        put(i, none if rank is None else rank << 31 | i)
        p = before[i]
        if p >= 0:
            rank = get(piece[p:stop])
            put(p, none if rank is None else rank << 31 | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Merges:
    """Pairs of token ids that merge, from the ranks: every way to cut a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks.get(bytes([c]), -1) for c in range(256)], np.int64)
        cuts = [(ranks[t[:k]] << 32 | ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        cuts.sort()
        self.keys, self.merged = (np.array(x, np.int64) for x in zip(*cuts, strict=True)) if cuts else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64))

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of pairs of tokens that start at ``at``."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.merged[place] << 8 | at, NONE)

    def together(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of at most ``width`` bytes (a power of two): one tree a row."""
        rows, length = len(pieces), np.array([len(p) for p in pieces])
        place = np.arange(width)
        alive = place < length[:, None]
        token = np.zeros((rows, width + 1), np.int64)
        token[:, :width][alive] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (rows, 1))
        before = np.tile(np.arange(-1, width), (rows, 1))
        tree = np.full((rows, 2 * width), NONE)
        pair = place < length[:, None] - 1
        tree[:, width:][pair] = self.leaves(token[:, :width][pair], token[:, 1:][pair], np.broadcast_to(place, pair.shape)[pair])
        at = width // 2
        while at:
            tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
            at //= 2
        flat = tree.reshape(-1)
        row = np.arange(rows)
        while True:
            root = tree[row, 1]
            open_ = root != NONE
            row, root = row[open_], root[open_]
            if not len(row):
                break
            i, new = root & 255, root >> 8
            gone = after[row, i]
            stop = after[row, gone]
            token[row, i], after[row, i], before[row, np.minimum(stop, width)] = new, stop, i
            alive[row, gone] = False
            left = before[row, i]
            has_left, has_right = np.flatnonzero(left >= 0), np.flatnonzero(stop < length[row])
            value = np.full(len(row), NONE)
            value[has_right] = self.leaves(new[has_right], token[row[has_right], stop[has_right]], i[has_right])
            lrow, lat = row[has_left], left[has_left]
            nodes = np.concatenate([gone, i, lat]) + width
            base = np.concatenate([row, row, lrow]) * (2 * width)
            flat[base + nodes] = np.concatenate([np.full(len(row), NONE), value, self.leaves(token[lrow, lat], new[has_left], lat)])
            while nodes[0] > 1:
                nodes = nodes >> 1
                under = base + 2 * nodes
                flat[base + nodes] = np.minimum(flat[under], flat[under + 1])
        data = token[:, :width][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def packed(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece."""
        raws = [p.encode() for p in pieces]
        whole = [self.ranks.get(raw) for raw in raws]
        out = [b"" if x is None else struct.pack("<I", x) for x in whole]
        size = np.array([len(raw) if x is None else 0 for raw, x in zip(raws, whole, strict=True)], np.int64)
        for k in np.flatnonzero(size > TREE_BYTES).tolist():
            ids = merge_piece(raws[k], self.ranks)
            out[k] = struct.pack(f"<{len(ids)}I", *ids)
        width = 2
        while width <= TREE_BYTES:
            found = np.flatnonzero((size > width // 2) & (size <= width)).tolist()
            for at in range(0, len(found), TREES):
                part = found[at : at + TREES]
                for k, ids in zip(part, self.together([raws[k] for k in part], width), strict=True):
                    out[k] = ids
            width *= 2
        return out


class Pieces:
    """Packed ids of the pieces a task has met, in two generations."""

    def __init__(self, merges: Merges, limit: int = CACHE_PIECES):
        self.merges, self.limit, self.young, self.old = merges, limit, {}, {}

    def of(self, pieces: set[str]) -> dict[str, bytes]:
        """A table that has all of ``pieces``."""
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = [p for p in pieces if p not in young]
        young.update((p, old[p]) for p in new if p in old)
        new = [p for p in new if p not in young]
        long = {}
        for piece, ids in zip(new, self.merges.packed(new), strict=True):
            (young if len(piece) <= CACHE_CHARS else long)[piece] = ids
        return young | long if long else young


def encode_texts(texts: list[str | None], split, pieces: Pieces) -> list[bytes]:
    """Packed ids of each text; ``split`` yields its pieces."""
    parts = [split(t) if t else [] for t in texts]
    table = pieces.of(set().union(*parts))
    return [b"".join(map(table.__getitem__, x)) for x in parts]


def _sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about SLICE_CHARS of ``column``; a longer value is a slice of its own."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        start = size = 0
        for at, n in enumerate(sizes):
            if at > start and size + n > SLICE_CHARS:
                yield b.slice(start, at - start)
                start, size = at, 0
            size += n
        if b.num_rows > start:
            yield b.slice(start)


def encode(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every row. ``pattern`` splits texts; each match is merged separately.

    ``decoded`` adds bytes, what the packed ids decode to, in the same pass.
    """
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        tokens = {rank: token for token, rank in shared.value.items()} if decoded else {}
        pieces = Pieces(Merges(shared.value))  # a task's own, so that an idle worker holds none
        for b in _sliced(batches, "text"):
            packed = encode_texts(b.column("text").to_pylist(), split, pieces)
            more = {"bytes": pa.array([decode_ids(x, tokens) for x in packed], pa.binary())} if decoded else {}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(packed, pa.binary()), *more.values()], ["doc_id", "ids", *more])

    return over_texts(docs.select("doc_id", "text"), run, "doc_id long, ids binary" + ", bytes binary" * decoded)


def decode_ids(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    """Concatenated tokens of packed ids."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, bytes): what stored ids decode to."""
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in read_ranks(ranks_path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, "ids"):
            out = [decode_ids(ids, shared.value) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])

    return over_texts(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, bytes binary")
