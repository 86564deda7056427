"""Conversation trie and centroid clustering against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from pagelode.llm import centroids, prefix_trie, queries

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, run long, length string, cell int, a string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def trie_by_hand(rows):
    original = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            original[c].append((turn is not None, turn or 0, digest(f"{len(role.encode())}:{role}{text}"), role, text))
    original = {c: [t[3:] for t in sorted(turns)] for c, turns in original.items()}
    built = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = original.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * own + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
    return sorted(
        (min(ids), len(node), min(members[node[:-1]]) if node else -1, len(ids), len(children[node]), leaves[node], saved[node], digest(",".join(str(c) for c in sorted(ids) if len(built[c]) == len(node))))
        for node, ids in members.items()
    )


def trie_of(spark, rows, **options):
    got = prefix_trie.trie(spark.createDataFrame([(*r, 1, "x", 2, None) for r in rows], TURNS), **options).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


def test_trie_matches_brute_force(spark):
    rnd, rows = random.Random(4), []
    for c in rnd.sample(range(-30, 60), 70):
        for turn in range(rnd.randint(1, 12)):
            rows.append((c, rnd.choice([turn, turn, None, 3]), rnd.choice(["user", "user", None]), rnd.choice(["a", "a", "a", "é", "", None])))
    rows += [(None, 1, "user", "of no conversation"), rows[0], rows[0], (1000, 0, "r", "x" * 200_000), (1001, 0, "r", "x" * 200_000)]
    want = trie_by_hand(rows)
    assert trie_of(spark, rows) == want
    assert trie_of(spark, rows, cell=2, piece=1) == want  # many cells, many pieces


def test_trie_of_a_long_conversation_and_its_branches(spark):
    """A spine of 400 turns that others leave at every depth: a plain peeling would take 400 rounds."""
    rows = [(5000, t, "user", f"turn {t}") for t in range(400)]
    for k in range(60):
        leave = 6 * k + 3
        rows += [(6 + 5 * k, t, "user", f"turn {t}" if t < leave else f"own {k}") for t in range(leave + 2)]
    assert trie_of(spark, rows, cell=64) == trie_by_hand(rows)


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(3)]
    got = trie_of(spark, rows, piece=7)
    assert got == trie_by_hand(rows)
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "a", "b")]) == []


def clusters_by_hand(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, digest(f"3:{r[0]}"), np.array(r[1], "<i4").tobytes()))
    middle = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        middle = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(middle)]
    placed, inertia = [(i, *near(v)) for i, v in kept], defaultdict(int)
    for _, d, n in placed:
        inertia[n] += d
    return sorted(((-1 if i is None else i), n, d, inertia[n], sum(inertia.values()), digest(",".join(map(str, middle[n])))) for i, d, n in placed)


def clusters_of(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int")
    return sorted((-1 if r.vec_id is None else r.vec_id, *r[1:]) for r in centroids.cluster(df, **options)[0].collect())


def test_clusters_match_brute_force(spark):
    rnd = random.Random(8)
    vector = lambda spread: [float(np.float32(rnd.gauss(0, spread))) for _ in range(64)]
    rows = [(i, vector(rnd.choice([0.1, 1, 5]))) for i in range(120)]
    rows += [(500, rows[3][1]), (3, rows[3][1]), (None, vector(1)), (600, None), (601, []), (602, [1.0] * 63), (603, [None] + [1.0] * 63), (604, [math.nan] + [0.0] * 63), (605, [math.inf] * 64)]
    rows += [(700 + i, [0.0] * 64) for i in range(40)]
    assert clusters_of(spark, rows) == clusters_by_hand(rows)
    assert clusters_of(spark, rows, k=40, rounds=2) == clusters_by_hand(rows, 40, 2)
    few = rows[:3]
    assert clusters_of(spark, few) == clusters_by_hand(few)
    assert clusters_of(spark, []) == [] and clusters_of(spark, rows[125:128]) == []
    large = [(i, [float(rnd.randint(-100_000, 100_000)) for _ in range(64)]) for i in range(30)]
    assert clusters_of(spark, large) == clusters_by_hand(large)
    with pytest.raises(Exception, match="would not fit a long"):
        clusters_of(spark, [(1, [1e20] * 64)])


def test_annulus_prunes_and_keeps_boundary_ties():
    rnd = np.random.default_rng(5)
    rows = np.concatenate([rnd.integers(-9, 9, (50, 4)) * s for s in (1, 10, 100)])
    known = centroids.Centroids(rows.tolist())
    vectors = np.concatenate([rows[rnd.integers(0, len(rows), 300)] + rnd.integers(-2, 3, (300, 4)), rows])
    low, high = known.annulus(vectors, (vectors * vectors).sum(axis=1))
    assert (high - low).mean() < 0.6 * len(rows)  # most centroids are never compared
    squares = ((vectors[:, None, :] - rows[None]) ** 2).sum(axis=2)
    number, distance = known.nearest(vectors)
    assert (number == squares.argmin(axis=1)).all() and (distance == squares.min(axis=1)).all()
    ties = centroids.Centroids([[5, 0], [-5, 0], [0, 5], [3, 4]])  # all on one circle
    number, distance = ties.nearest(np.array([[0, 0], [4, 2], [0, 0]]))
    assert number.tolist() == [0, 0, 0] and distance.tolist() == [25, 5, 25]


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_centroids"])
def test_query_matches_its_twin(spark, name):
    db = duckdb.connect()
    for table in ("conversations", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = ", ".join(df.columns)
    want = db.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
