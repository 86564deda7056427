"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts are compared as words (lower-cased, without ASCII punctuation). Every word
n-gram of an item is a seed, however frequent: an edited copy keeps any of them,
and often only common ones. Seeds of one item that lie close open a window;
windows that share too few words with the item to reach the score are dropped,
which loses nothing, and the others are aligned with the item word by word
(Smith-Waterman, linear gaps). The score is the alignment's share of a perfect
copy's, so edited and paraphrased copies score high and chance hits low. A copy
without SEED_WORDS words in a row left isn't found.

Test items are sent to the workers in blocks of BLOCK_ITEMS or BLOCK_CHARS, so
what the driver holds and broadcasts doesn't grow with the corpus nor, beyond a
block, with the benchmark.

Defined results: null and empty texts and items match nothing; an item of fewer
than MIN_WORDS words is common speech and counts only where it makes up half of
a document's words or more; repeated rows match alike and rows with one doc_id
give one result; ties go to the smallest item and the first place; items with
one id but several texts are separate; no items or documents give an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import over_texts
from pagelode.llm.near_dedup import PLACES, mixed

SEED_WORDS = 3
SCORE = 0.4
MIN_WORDS = 6
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 16_000_000
CELLS = 1 << 20
#: Bytes of ASCII that are no letter or digit become spaces.
APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(APART).split() if text else []


def seed_codes(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and codes of the n-grams all of whose words are known (id above 0)."""
    size = len(ids) - n + 1
    if size < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids[:size] > 0
    for i in range(1, n):
        known &= ids[i : i + size] > 0
    at = np.flatnonzero(known)
    code = np.zeros(len(at), np.uint64)
    for i in range(n):
        code += mixed(ids[at + i].astype(np.uint64)) * PLACES[i % 5]
    return at, mixed(code)


class Items:
    """A block of test items: vocabulary, word ids, and the n-grams of each item."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n = n
        self.item_id, self.words = [], []
        self.vocabulary: dict[bytes, int] = {}
        for item, text in rows:
            found = split_words(text)
            if found:
                self.item_id.append(item)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64))
        owner, at, code = [], [], []
        for i, w in enumerate(self.words):
            p, c = seed_codes(w, min(n, len(w))) if len(w) >= n else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            owner.append(np.full(len(p), i))
            at.append(p)
            code.append(c)
        self.owner = np.concatenate(owner).astype(np.int64) if owner else np.zeros(0, np.int64)
        self.at = np.concatenate(at).astype(np.int64) if at else np.zeros(0, np.int64)
        self.code = np.concatenate(code).astype(np.uint64) if code else np.zeros(0, np.uint64)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.short = [i for i, w in enumerate(self.words) if len(w) < n]

    def ids(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        found = split_words(text)
        return np.fromiter((get(w, 0) for w in found), np.int64, len(found))


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of word sequences, and where in the window it ends.

    All pairs advance together, an item word at a time; a row's horizontal gaps
    come from a running maximum, which is exact for linear gap costs.
    """
    rows, width = max(map(len, items)), max(map(len, windows))
    a = np.full((len(items), rows), -2, np.int32)
    w = np.full((len(items), width), -1, np.int32)
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[k, : len(x)], w[k, : len(y)] = x, y
    slide = np.arange(width, dtype=np.int32) * -GAP
    before = np.zeros((len(items), width + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(rows):
        step = np.where(a[:, i : i + 1] == w, MATCH, MISMATCH)
        cell = np.maximum(np.maximum(before[:, :-1] + step, before[:, 1:] + GAP), 0)
        cell = np.maximum.accumulate(cell + slide, axis=1) - slide
        before[:, 1:] = cell
        top = cell.argmax(1)
        value = cell[np.arange(len(items)), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


def windows_of(items: Items, ids: np.ndarray, seeds, least_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(item, start, stop) windows of a document around the seeds it holds."""
    codes, first, owner, offset = seeds
    at, code = seed_codes(ids, items.n)
    out: list[tuple[int, int, int]] = []
    if len(at) and len(codes):
        place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = codes[place] == code
        at, place = at[hit], place[hit]
        n = first[place + 1] - first[place]
        k = np.repeat(first[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        i, length = owner[k], items.length[owner[k]]
        slack = 4 + length // 4
        start = np.repeat(at, n) - offset[k]
        apart = i * (len(ids) + 1)  # windows of different items never touch
        stop = apart + np.minimum(len(ids), start + length + slack)
        start = apart + np.maximum(0, start - slack)
        order = np.argsort(start, kind="stable")
        i, start, stop, apart = i[order], start[order], np.maximum.accumulate(stop[order]), apart[order]
        head = np.flatnonzero(np.append(True, (start[1:] > stop[:-1]) | (i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(i))[: len(head)] - 1
        out += zip(i[head].tolist(), (start - apart)[head].tolist(), (stop - apart)[tail].tolist(), strict=True)
    brief = 2 * items.length < len(ids)  # items too short for this document
    out = [x for x in out if items.length[x[0]] >= least_words or not brief[x[0]]]
    for i in items.short:
        if brief[i]:
            continue
        word = items.words[i]
        for p in np.flatnonzero(ids[: len(ids) - len(word) + 1] == word[0]).tolist():
            if (ids[p : p + len(word)] == word).all():
                out.append((i, p, p + len(word)))
                break
    return out


def can_reach(words: np.ndarray, window: np.ndarray, least: float, least_words: int) -> bool:
    """Whether a window could align at ``least``: an alignment that does matches at least that share of the item's words, in a bounded stretch."""
    size = len(words)
    need = max(least * size - 1e-9, min(least_words, size))
    known, there = np.unique(words, return_counts=True)
    place = np.minimum(np.searchsorted(known, window), len(known) - 1)
    hit = known[place] == window
    if np.minimum(np.bincount(place[hit], minlength=len(known)), there).sum() < need:
        return False
    # 2 m - edits >= 2 least size and m <= size, so at most (3 - 2 least) size words of the document take part
    stretch = int((3 - 2 * least) * size) + 1
    total = np.append(0, np.cumsum(hit))
    return bool((total[stretch:] - total[:-stretch]).max() >= need) if len(window) > stretch else True


def _matches(items_of, least: float, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = items_of()
        order = np.argsort(items.code, kind="stable")
        codes, first = np.unique(items.code[order], return_index=True)
        seeds = (codes, np.append(first, len(order)), items.owner[order], items.at[order])
        for b in batches:
            found = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = items.ids(text)
                found += [(doc, i, s, ids[s:e]) for i, s, e in windows_of(items, ids, seeds, least_words) if can_reach(items.words[i], ids[s:e], least, least_words)]
            found.sort(key=lambda x: (len(x[3]), len(items.words[x[1]])))
            out = []
            while found:
                width = len(found[-1][3])
                part = found[-max(1, min(256, CELLS // max(1, width))) :]
                del found[-len(part) :]
                score, end = align([items.words[x[1]] for x in part], [x[3] for x in part])
                for (doc, i, s, _), value, stop in zip(part, score.tolist(), end.tolist(), strict=True):
                    share = value / (MATCH * len(items.words[i]))
                    if share >= least and value >= MATCH * min(least_words, len(items.words[i])):
                        out.append((doc, items.item_id[i], share, s, s + stop + 1))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "start", "stop"])

    return run


def item_blocks(benchmark: DataFrame, block: int = BLOCK_ITEMS) -> Iterator[list[tuple[int, str]]]:
    """Items in order, at most ``block`` of them or about BLOCK_CHARS at a time."""
    rows, chars = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if rows and (len(rows) == block or chars + len(r["text"]) > BLOCK_CHARS):
            yield rows
            rows, chars = [], 0
        rows.append((r["item_id"], r["text"]))
        chars += len(r["text"])
    if rows:
        yield rows


def matches(docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, least: float = SCORE, least_words: int = MIN_WORDS, block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, start, stop) of every window that aligns with a test item; positions count words.

    The text from start to stop holds the copy, which ends at stop.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    schema = "doc_id long, item_id long, score double, start long, stop long"
    out = spark.createDataFrame([], schema)
    for part in item_blocks(benchmark, block):
        shared = spark.sparkContext.broadcast(part)

        def items_of(shared=shared):
            return Items(shared.value, seed_words)

        out = out.unionByName(over_texts(texts, _matches(items_of, least, least_words), schema))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated document: the item with the best score (ties: the smallest id) and how many items match."""
    found = matches(docs, benchmark, **options)
    best = F.max(F.struct("score", (-F.col("item_id")).alias("m"), (-F.col("start")).alias("s"), "stop"))
    return found.groupBy("doc_id").agg(best.alias("b"), F.count_distinct("item_id").alias("n_items")).select(
        "doc_id", (-F.col("b.m")).alias("item_id"), F.col("b.score").alias("score"), (-F.col("b.s")).alias("start"), F.col("b.stop").alias("stop"), "n_items"
    )
