"""Near-duplicate detection with bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles; equal sets
become one class right away. A sketch keeps the K least hashes of a set, so two
sets of similarity 0.75 share about three quarters of the least K values of
their union. Inverted lists of the retained values yield the pairs with any
overlap; pairs whose union sketch holds fewer than LEAST_SHARED common values
are filtered (a pair at the threshold falls below with a chance under 1e-6);
the others are confirmed on their full sets.

Very frequent values (a line or passage in many documents, a large group of
near copies) would make lists whose pairs grow with the square. A list longer
than LONG_LIST is not paired. A similar pair that shares only such values must
hold LEAST_SHARED of them in either sketch, so only documents with that many
(or all, for smaller sets) go on; they fall into regions connected by long-list
values, and a region is cut into blocks of like set sizes. First every block is
compared with itself and with the region's representative, which ships each set
once and links most of a group of near copies. Documents connected with the
representative need no further links among themselves; only the others are then
compared, block by block, with each other and with those. Exact intersections of two blocks come from one matrix product,
and what leaves it is a spanning forest of the links found, never the pairs.

Components come from partitions contracted on their own, then from large and
small stars on tables; no link or label reaches the driver. Inside, a distinct set is a node with a
number of its own; ids come back at the end.

Defined results: a document without words (or a null text) has no shingles and
is linked with nothing; fewer words than a shingle make one shingle; each row
counts by its own text, also where rows share a doc_id, and all rows of a
class's least id are kept; rows without an id take the component of their class
and are kept only if no row of it has an id; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import BROADCAST_KEYS, arrow_rows, cut, over_texts, small_side

WORDS = 5
SHARE = (75, 100)
K = 32
LEAST_SHARED = 10
LONG_LIST = 64
#: Edges that one task contracts at most.
EDGE_ROWS = 200_000
#: Rows with a value that occurs more often don't meet in one task.
HOT_VALUE = 1024
#: Documents and set members of a block at most.
BLOCK_DOCS = 512
BLOCK_MEMBERS = 400_000
#: Rows of an Arrow batch that carries texts or whole sets.
BATCH_ROWS = 500
COLUMNS = 4096
WORD_CACHE = 150_000
#: Fixed odd multipliers that place a word inside its shingle, and the finaliser's.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


class WordHashes(dict):
    """64-bit hash of a word, worked out once; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = out
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX[0]
    x = (x ^ (x >> np.uint64(33))) * MIX[1]
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text."""
    found = text.encode().lower().split() if text else []  # bytes: only A-Z are lowered, only x20 and x09-x0D split
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = len(h) - words + 1
    if n < 1:
        acc = np.full(1, len(h), np.uint64)
        for i, x in enumerate(h):
            acc = mixed(acc + np.uint64(i + 1)) ^ x
        return mixed(acc)
    acc = np.zeros(n, np.uint64)
    for i in range(words):
        acc += h[i : i + n] * PLACES[i % 5] if i < 5 else mixed(h[i : i + n] + np.uint64(i))
    return np.unique(mixed(acc))


def _sketched(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, key, sketch = [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, words, hashes)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketch.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "th", "n", "key", "sketch"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [shingle_set(t, words, hashes).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["key", "members"])

    return run


def _confirmed(share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("ma").to_pylist(), b.column("mb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(share[1] * both >= share[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of 0/1 matrices over the members both lists have."""
    lv, rv = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out

    def places(sets, values):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return row[hit], at[hit]

    (lr, lc), (rr, rc) = places(left, lv), places(right, rv)
    for at in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - at)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        i, j = (lc >= at) & (lc < at + width), (rc >= at) & (rc < at + width)
        x[lr[i], lc[i] - at] = 1
        y[rr[j], rc[j] - at] = 1
        out += x @ y.T
    return out


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph on range(n)."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _block_links(share: tuple[int, int]):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Links of a work item as a spanning forest (a, b, starred); documents connected with the representative hang on it, starred."""
        ids = np.array(table.column("node").to_pylist(), np.int64)
        side = np.array(table.column("side").to_pylist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        left, right = np.flatnonzero(side != 2), np.flatnonzero((side != 1) & (side != 3))  # 0: one block against itself, 3: its representative
        edges: list[tuple[int, int]] = []
        if len(left) and len(right):
            both = intersections([sets[i] for i in left], [sets[i] for i in right])
            size = np.array([len(s) for s in sets], np.float32)
            linked = share[1] * both >= share[0] * (size[left][:, None] + size[right][None, :] - both)
            x, y = np.nonzero(linked)
            pairs = np.stack([left[x], right[y]], 1)
            edges = forest(len(ids), pairs[pairs[:, 0] != pairs[:, 1]])
        chief = np.flatnonzero(side == 3)
        around = _reached(len(ids), edges, int(chief[0])) if len(chief) else set()
        plain = [(int(ids[i]), int(ids[j])) for i, j in edges if i not in around]
        starred = [(int(ids[i]), int(ids[chief[0]])) for i in sorted(around)]
        a, b = zip(*plain, *starred, strict=True) if plain or starred else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "starred": pa.array([False] * len(plain) + [True] * len(starred), pa.bool_())})

    return run


def _reached(n: int, edges: list[tuple[int, int]], start: int) -> set[int]:
    """What ``edges`` connect with start, itself included."""
    beside: list[list[int]] = [[] for _ in range(n)]
    for i, j in edges:
        beside[i].append(j)
        beside[j].append(i)
    found, waiting = {start}, [start]
    while waiting:
        for j in beside[waiting.pop()]:
            if j not in found:
                found.add(j)
                waiting.append(j)
    return found


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around the least node of each of its components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = [(x, top) for x in parent if (top := root(x)) != x]
    for at in range(0, len(stars), 50_000):
        a, b = zip(*stars[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """(id, label) of every end of (a, b) edges: label is the least id reachable.

    Partitions of at most ``edge_rows`` edges, a bounded piece of work, are
    contracted to stars on their own. What spans partitions then goes through
    rounds in which each node hangs larger neighbours and itself onto its least
    neighbour, then least neighbours onto each other (large and small stars),
    until nothing changes; edges that fit one partition need no round.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        hung = both.join(least, "a")
        if large:
            moved = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    def fingerprint(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    found = cut(edges.select("a", "b").where("a <> b"))
    parts = max(1, -(-found.count() // edge_rows))
    packed = found.coalesce(1) if parts == 1 else found.repartition(parts)
    now = cut(packed.mapInArrow(_contracted, "a long, b long"))
    mark, before = fingerprint(now) if parts > 1 else None, None
    while mark != before:
        before = mark
        now = cut(star(star(now, True), False))
        mark = fingerprint(now)
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return ends.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def near_dedup(
    docs: DataFrame,
    words: int = WORDS,
    share: tuple[int, int] = SHARE,
    k: int = K,
    least_shared: int = LEAST_SHARED,
    long_list: int = LONG_LIST,
    block_docs: int = BLOCK_DOCS,
    hot_value: int = HOT_VALUE,
) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept) of every row; th is the xxhash64 of its text."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):  # every Python step below ends in a written table before this block does
        return _near_dedup(texts, words, share, k, least_shared, long_list, block_docs, hot_value)


def _near_dedup(texts: DataFrame, words: int, share: tuple[int, int], k: int, least_shared: int, long_list: int, block_docs: int, hot_value: int) -> DataFrame:
    sketched = cut(over_texts(texts, _sketched(words, k), "doc_id long, th long, n long, key binary, sketch array<long>"))
    # one node stands for all rows with the same set; its number is fixed by the written table
    heads = sketched.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("n", "sketch")).alias("s")).select("key", "doc_id", "s.*")
    heads = cut(heads.withColumn("node", F.monotonically_increasing_id()))

    lists = _lists(heads, max(hot_value, long_list))
    short_lists = lists.where(F.col("count") <= long_list)
    members = F.collect_list(F.struct("n", "node"))
    short = short_lists.groupBy("v").agg(F.sort_array(members).alias("nodes"))  # at most long_list each
    firsts = short.select(F.posexplode("nodes").alias("i", "x"), "nodes")
    pairs = firsts.select("x", F.explode(F.slice("nodes", F.col("i") + 2, F.size("nodes"))).alias("y"))
    pairs = (
        pairs.where(F.col("x.n") * share[1] >= F.col("y.n") * share[0])  # sorted by size: x is the smaller
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        .distinct()
    )
    sa = heads.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    sb = heads.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    need = F.least(F.lit(least_shared), F.ceil(F.size(union) * (least_shared / k)))
    likely = cut(pairs.join(sa, "a").join(sb, "b").where(shared >= need).select("a", "b"))

    wanted = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    long_lists = lists.where(F.col("count") > long_list)
    share_of_values = F.least(F.lit(least_shared), F.ceil(F.max("kept_values") * (least_shared / k)))
    heavy = cut(long_lists.groupBy("node", "n").agg(F.count("*").alias("hot"), share_of_values.alias("need")).where("hot >= need").select("node", "n"))
    links = _linked(_members(texts, heads, wanted, words), likely, share)
    if not heavy.isEmpty():
        links = links.unionByName(_linked_in_regions(_members(texts, heads, heavy.select("node"), words), long_lists, heavy, share, block_docs))

    found = components(links).withColumnRenamed("id", "node")
    labelled = heads.select("key", "doc_id", "node").join(found, "node", "left")
    linked = labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least_id"))
    labelled = labelled.join(linked, "label", "left").select("key", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"))
    columns = ["doc_id", "th", F.col("n").alias("n_shingles")]
    filled = sketched.where("n > 0").join(labelled, "key").select(*columns, "component_id")  # a hot key's rows are split by AQE
    out = filled.unionByName(sketched.where("n = 0").select(*columns, F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _lists(heads: DataFrame, hot_value: int) -> DataFrame:
    """(v, node, n, kept_values, count) of the retained values that several nodes hold; count says how many."""
    posted = heads.select("node", "n", F.size("sketch").alias("kept_values"), F.explode("sketch").alias("v"))
    lengths = cut(posted.groupBy("v").count().where("count > 1"))
    hot = lengths.where(F.col("count") > hot_value)
    n_hot = hot.count()
    if not 0 < n_hot <= BROADCAST_KEYS:
        return cut(posted.join(lengths, "v"))
    # rows of hot values get their count where they are; only the others are dealt by value
    tagged = posted.join(F.broadcast(hot), "v", "left")
    calm = lengths.where(F.col("count") <= hot_value)
    rest = tagged.where("count is null").drop("count").join(calm, "v")
    return cut(rest.unionByName(tagged.where("count is not null").select(rest.columns)))


def _members(texts: DataFrame, heads: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, members) of the wanted nodes, from whole texts of their rows."""
    wanted = cut(heads.join(wanted, "node", "left_semi").select("node", "key", "doc_id"))
    n = wanted.count()
    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    picked = texts.join(small_side(ids, n), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = over_texts(picked.select("text"), _sets(words), "key binary, members binary")
    # rows of a wanted id may hold other texts; copies of a text under one id count once
    return sets.join(small_side(wanted.select("key", "node"), n, BROADCAST_KEYS // 4), "key").drop("key").dropDuplicates(["node"])


def _linked(sets: DataFrame, likely: DataFrame, share) -> DataFrame:
    ma = sets.select(F.col("node").alias("a"), F.col("members").alias("ma"))
    mb = sets.select(F.col("node").alias("b"), F.col("members").alias("mb"))
    return likely.join(ma, "a").join(mb, "b").mapInArrow(_confirmed(share), "a long, b long")


def _regions(long_lists: DataFrame, heavy: DataFrame) -> DataFrame:
    """(node, region) of nodes connected by long-list values."""
    inside = cut(long_lists.join(heavy.select("node"), "node", "left_semi").select("v", "node"))
    hubs = cut(inside.groupBy("v").agg(F.min("node").alias("hub")))
    edges = inside.join(small_side(hubs, hubs.count()), "v").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return components(edges).withColumnRenamed("id", "node").withColumnRenamed("label", "region")


def _linked_in_regions(sets: DataFrame, long_lists: DataFrame, heavy: DataFrame, share, block_docs: int) -> DataFrame:
    base = share[1] / share[0]  # similar sets have sizes in one class or in neighbouring ones
    cls = F.floor(F.log(F.col("n")) / F.log(F.lit(base)) + 1e-9).cast("int")
    sized = cut(heavy.join(_regions(long_lists, heavy), "node").withColumn("cls", cls))
    room = F.greatest(F.lit(16), F.least(F.lit(block_docs), F.floor(F.lit(BLOCK_MEMBERS) / F.pow(F.lit(base), F.col("cls") + 1)))).cast("int")

    def classes_of(of: DataFrame, by: list[str]) -> DataFrame:
        """Classes with their number of blocks and a node."""
        sums = of.groupBy(*by).agg(F.count("*").alias("n_nodes"), F.min("node").alias("first"))
        return cut(sums.withColumn("blocks", F.ceil(F.col("n_nodes") / room).cast("int")))

    def blocked(of: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
        """Nodes with the number of their block."""
        found = of.join(small_side(classes.select(*by, "blocks"), classes.count(), BROADCAST_KEYS // 4), by)
        return found.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def compared(dealt: DataFrame) -> DataFrame:
        """Links within work items: (item..., node, side) rows; side 1 against side 2, side 0 on both, side 3 against all but itself."""
        by = [c for c in dealt.columns if c not in ("node", "side")]
        dealt = cut(dealt)
        return sets.join(small_side(dealt, dealt.count(), BROADCAST_KEYS // 4), "node").groupBy(*by).applyInArrow(_block_links(share), "a long, b long, starred boolean")

    # every block with itself, and with its region's representative where sizes allow a link
    by = ["region", "cls"]
    classes = classes_of(sized, by)
    chief = classes.groupBy("region").agg(F.max(F.struct("n_nodes", "cls", "first")).alias("m")).select("region", F.col("m.cls").alias("chief_cls"), F.col("m.first").alias("node"))
    every = classes.join(chief, "region").where(F.abs(F.col("cls") - F.col("chief_cls")) <= 1)
    visits = every.select("region", "cls", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", F.lit(3).alias("side"))
    item = blocked(sized, classes, by).select("region", "cls", "block", "node", F.lit(0).alias("side"))
    links = cut(compared(item.join(chief.select("node"), "node", "left_anti").select(item.columns).unionByName(visits)))

    single = classes.groupBy("region").agg(F.sum("blocks").alias("n")).where("n = 1").select("region")

    # what hangs on a region's representative needs no more links inside; the others meet each other and it
    settled = links.where("starred").select(F.col("a").alias("node"), F.lit(0).alias("apart")).distinct()
    marked = cut(sized.join(settled, "node", "left").withColumn("apart", F.coalesce("apart", F.lit(1))))
    by = ["region", "apart", "cls"]
    classes = classes_of(marked, by)
    # the blocks of documents that are apart are items with each block of the classes around them
    others = classes.select("region", F.col("apart").alias("apart2"), F.col("cls").alias("cls2"), F.col("blocks").alias("blocks2"))
    mine, theirs = [*by, "block"], ["apart2", "cls2", "block2"]
    left = classes.where("apart = 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*mine)
    facing = left.join(others, "region").where(F.abs(F.col("cls") - F.col("cls2")) <= 1).withColumn("block2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
    # a pair of blocks that are both apart is one item, by order; regions of one block have met already
    facing = facing.where((F.col("apart2") == 0) | (F.struct("cls", "block") <= F.struct(F.col("cls2").alias("cls"), F.col("block2").alias("block"))))
    facing = cut(facing.join(single, "region", "left_anti").select(*mine, *theirs))
    if facing.isEmpty():
        return links.select("a", "b")
    parted = blocked(marked.select("region", "apart", "cls", "node"), classes, by)
    same = (F.col("apart2") == 1) & (F.col("cls") == F.col("cls2")) & (F.col("block") == F.col("block2"))
    columns = [*mine, *theirs]
    one = parted.select(*mine, "node").join(facing, mine).select(*columns, "node", F.when(same, 0).otherwise(1).alias("side"))
    two = parted.select("region", F.col("apart").alias("apart2"), F.col("cls").alias("cls2"), F.col("block").alias("block2"), "node").join(facing.where(~same), ["region", *theirs])
    more = compared(one.unionByName(two.select(*columns, "node", F.lit(2).alias("side"))))
    return links.select("a", "b").unionByName(more.select("a", "b"))
