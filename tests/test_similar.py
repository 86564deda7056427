"""Near duplicates: what is left on disk, and pairs that marks rule out."""

import os
import random

from pyspark.sql import functions as F

from pagelode.operators import similar

WORDS = [f"w{i}" for i in range(400)]


def left(spark, run):
    """Names of the tables that ``run`` leaves in the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    rows = run()
    return rows, {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before if n.count("-") == 1}


def test_pairs_leave_no_sets_and_no_index(spark):
    docs = spark.createDataFrame([(0, " ".join(WORDS)), (1, " ".join([*WORDS[:-1], "end"])), (2, "other words")], "doc_id long, text string")
    rows, names = left(spark, lambda: similar.near_duplicate_pairs(docs, sample=None)[0].collect())
    assert [(r.a, r.b) for r in rows] == [(0, 1)]
    assert names == {"keys", "heads", "verified"}
    rows, names = left(spark, lambda: similar.near_duplicate_classes(docs).collect())
    assert {tuple(r) for r in rows} == {(0, 0, 0), (1, 1, 0), (2, 2, 2)}
    assert names == {"keys", "heads", "labels"}


def test_marks_lose_no_pair_that_is_alike(spark):
    """Sets of all sizes, alike, less so and not at all, on both sides of a width."""
    rnd = random.Random(5)
    sets, pairs, alike = [], [], []
    for n in (1, 2, 3, 10, 60, 63, 64, 65, 70, 127, 128, 129, 500, 1020, 1030, 3000):
        for k in range(12):
            one = [rnd.getrandbits(63) for _ in range(n)]
            changed = n * 2 // 3 if k % 3 == 0 else rnd.randrange(n // 15 + 1)
            two = one[changed:] + [rnd.getrandbits(63) for _ in range(changed if k % 3 == 0 else rnd.randrange(n // 20 + 1))]
            two = two or [rnd.getrandbits(63)]
            at = len(sets)
            sets += [(at, sorted(one)), (at + 1, sorted(two))]
            pairs.append((at, at + 1))
            share = len(set(one) & set(two)) / len(set(one) | set(two))
            alike.append((at, at + 1, share))
    frame = spark.createDataFrame(sets, "doc_id long, s array<long>")
    got = {tuple(r) for r in similar.possible(spark.createDataFrame(pairs, "a long, b long"), similar.marked(frame), 0.9).collect()}
    assert {(a, b) for a, b, share in alike if share >= 0.9} <= got
    apart = {(a, b) for a, b, share in alike if share < 0.5 and min(len(sets[a][1]), len(sets[b][1])) >= 40}
    assert apart and not apart & got


def test_shuffle_files_go_with_their_action(spark):
    from pagelode.operators import store

    with store.shuffles_removed(spark):
        assert spark.conf.get(store.CLEANS) == "true"
        table = store.stored(spark.range(9).repartition(3, F.col("id")), "nine")
        assert table.count() == 9
    assert spark.conf.get(store.CLEANS) == "false"
    store.discard(table)
    assert not any(n.startswith("nine-") for n in os.listdir(spark.conf.get("spark.checkpoint.dir")))
