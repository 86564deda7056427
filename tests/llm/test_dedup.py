import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from pagelode.llm import exact_dedup, line_dedup, near_dedup, sharding
from tests.llm.conftest import ODD


def test_exact_dedup_matches_brute_force(spark, corpus, odd):
    for df, rows in ((spark.createDataFrame(corpus, "doc_id long, text string"), corpus), (odd, ODD)):
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(df).collect()}
        groups = defaultdict(list)
        for i, t in rows:
            groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
        assert len(got) == len(rows)
        for body, ids in groups.items():
            for i in ids:
                assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(ids), len(ids), i == min(ids))
                assert got[i].digest == hashlib.sha256(body.encode()).hexdigest()


def test_exact_dedup_splits_clashing_digests(odd):
    """A digest with three values: byte verification has to part the texts."""
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(odd, digest=lambda t: (F.length(t) % 3).cast("string")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 1, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10}
    for options in ({"broadcast_keys": 0}, {"broadcast_keys": 0, "filter_bytes": 0}, {"memtable_rows": 1}):
        other = exact_dedup.exact_dedup(odd, digest=lambda t: (F.length(t) % 3).cast("string"), **options)
        assert {r.doc_id: r.keep_id for r in other.collect()} == got


def test_filter_loses_no_hit_and_drops_most_others(spark):
    rows = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    known = exact_dedup.Filter(rows.where("id < 300"), 300)
    got = {r.id: r.maybe for r in known.flagged(rows).collect()}
    assert len(got) == 4000 and all(got[i] for i in range(300)) and sum(got.values()) < 900


def test_digest_index_lookup_and_null_ids(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"))
    index.flush(spark.createDataFrame([(5, "a"), (2, "a"), (9, "b"), (None, "b")], "doc_id long, digest string"))
    index.flush(spark.createDataFrame([(1, "a"), (7, "c")], "doc_id long, digest string"))
    assert {tuple(r) for r in index.lookup(["a", "c"]).collect()} == {("a", 1, 3), ("c", 7, 1)}
    assert {tuple(r) for r in index.compact().collect()} == {("a", 1, 3), ("b", 9, 2), ("c", 7, 1)}
    assert len(index.levels) == 1
    index.flush(spark.createDataFrame([(0, "a"), (8, "c"), (3, "d")], "doc_id long, digest string"))
    assert {tuple(r) for r in index.compact().collect()} == {("a", 0, 4), ("b", 9, 2), ("c", 7, 2), ("d", 3, 1)}
    plan = index.runs().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # runs lie in buckets, so compaction doesn't shuffle


def lines_by_hand(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def lines_of(df):
    counted = df.select("doc_id", "text").withColumn("n_lines", F.size(line_dedup.split_lines(F.col("text"))))
    done = line_dedup.apply_bitmaps(counted, line_dedup.line_dedup(df))
    return {r.doc_id: (r.n_lines, r.n_dropped or 0, r.text or "") for r in done.collect()}


def test_line_dedup_matches_brute_force(spark, odd):
    assert lines_of(odd) == lines_by_hand(ODD)
    rows = [(i, "\n".join(["the very common line" if k % 2 else f"line number {i % 7} of {k}", "TINY", "  padded line number %d " % (k % 3)][k % 3] for k in range(i % 11))) for i in range(300)]
    assert lines_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == lines_by_hand(rows)


def test_line_bitmaps_are_compressed_bits(odd):
    maps = {r.doc_id: r for r in line_dedup.line_dedup(odd).collect()}
    assert set(maps) == {5, 6, 9}
    bits = np.unpackbits(np.frombuffer(zlib.decompress(maps[5].keep_bitmap), np.uint8))[:3]
    assert bits.tolist() == [1, 0, 1] and maps[5].n_lines == 3 and maps[5].n_dropped == 1


def test_line_runs_chain_over_partitions():
    end = lambda part, f, l: {"part": part, "f1": f[0], "f2": 0, "fdoc": f[1], "l1": l[0], "l2": 0, "ldoc": l[1]}  # noqa: E731, E741
    ends = [end(3, (5, 8), (6, 2)), end(0, (1, 1), (5, 3)), end(2, (5, 6), (5, 6))]
    assert line_dedup.chained(ends) == {2: (5, 0, 3), 3: (5, 0, 3)}


def near_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[ \t-\r]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(df, **options).collect()}


def test_near_dedup_matches_brute_force(spark, corpus, odd):
    assert near(odd) == near_by_hand(ODD)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    expected = near_by_hand(corpus)
    assert near(df) == expected
    # short lists and tiny blocks send the hot group through regions and block pairs
    assert near(df, long_list=6, block_docs=16) == expected
    assert near(df, long_list=3, block_docs=16, hot_value=4) == expected


def test_shingle_rules():
    h = near_dedup.WordHashes()
    size = lambda t, n=5: len(near_dedup.shingle_set(t, n, h))
    assert [size(None), size(""), size(" \t"), size("a b"), size("a b c d e"), size("a b c d e f"), size("a a a a a a")] == [0, 0, 0, 1, 1, 2, 1]
    same = lambda a, b: (near_dedup.shingle_set(a, 5, h) == near_dedup.shingle_set(b, 5, h)).all()
    assert same("A b\x0bc d\te", "a B c d e") and not same("a b", "b a") and not same("É b c d e", "é b c d e")


def test_components_of_chain_and_ring(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(1, 5), (5, 9), (9, 1), (7, 7)]
    for rows in (100, 7):  # contracted in one partition, and in several with rounds between them
        got = {r.id: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long"), rows).collect()}
        assert got == {**{i: 20 for i in range(20, 61)}, 1: 1, 5: 1, 9: 1}


def test_sharding_by_longest_processing_time(spark, corpus, odd):
    for df, rows in ((spark.createDataFrame(corpus, "doc_id long, text string"), corpus), (odd, ODD)):
        got = sharding.shard(df, shards=4, heavy=64, bundles=64).collect()
        text = dict(rows)
        assert sorted(r.doc_id for r in got) == sorted(text)
        shards, groups = defaultdict(list), defaultdict(set)
        for r in got:
            raw = (text[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
            shards[r.shard].append(r.slot)
            groups[text[r.doc_id] or ""].add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in shards.values())
        assert all(len(s) == 1 for s in groups.values())
    load = defaultdict(int)
    for r in sharding.shard(spark.createDataFrame(corpus, "doc_id long, text string"), shards=4).collect():
        load[r.shard] += r["size"]
    assert max(load.values()) - min(load.values()) <= 0.1 * sum(load.values()) / 4


def test_lpt_order_and_ties():
    assert sharding.lpt([(5, 1), (4, 2), (3, 3), (3, 4), (3, 5)], 2) == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}
    assert sharding.lpt([], 3) == {}


def test_empty_tables(none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert line_dedup.apply_bitmaps(none, line_dedup.line_dedup(none)).count() == 0
    assert near_dedup.near_dedup(none).count() == 0
    assert sharding.shard(none).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "one line of text here"), (1, "one line of text here"), (2, "one line of text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()) == [(1, 1, 3, True)] * 2 + [(2, 1, 3, False)]
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_dedup(df).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert lines_of(df) == {1: (1, 0, rows[0][1]), 2: (1, 1, "")}
    placed = sharding.shard(df).collect()
    assert sorted(r.slot for r in placed) == [0, 1, 2] and len({r.shard for r in placed}) == 1


def test_rows_of_one_id_with_other_texts(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, "shared line of text\nanother"), (2, "shared line of text\nanother"), (2, "a unique line, only here"), (3, long), (4, long), (4, "alone with these few words"), (None, long), (None, "nobody knows this text"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counted = df.withColumn("n", F.length("text"))
    done = line_dedup.apply_bitmaps(counted, line_dedup.line_dedup(df)).collect()
    assert sorted(r.text for r in done if r.doc_id == 2) == ["a unique line, only here", "another"]
    assert {r.text for r in done if r.doc_id is None} == {long, "nobody knows this text", None}
    found = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_dedup(df).collect()))
    assert found == sorted([(1, 1, 1, True), (2, 1, 1, False), (2, 1, 2, True), (3, 6, 3, True), (4, 6, 3, False), (4, 1, 4, True), (0, 6, 3, False), (0, 1, 0, True), (0, 0, 0, True)])


def test_near_dedup_counts_null_ids_in_a_hot_group(spark, corpus):
    rows = [*corpus, (None, corpus[0][1]), (None, None)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), long_list=6, block_docs=16, hot_value=8).collect()
    expected = near_by_hand(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == expected
    assert sorted((r.n_shingles, r.kept) for r in got if r.doc_id is None)[0] == (0, True)


def test_sharding_is_the_plain_schedule_over_all_groups(spark, corpus):
    """With every group dealt one by one, loads equal longest processing time over all groups."""
    got = sharding.shard(spark.createDataFrame(corpus, "doc_id long, text string"), shards=5, heavy=10**9, bundles=1).collect()
    groups = defaultdict(int)
    for _, t in corpus:
        groups[t] += len(t.encode()) + 1
    load = [0] * 5
    for size in sorted(groups.values(), reverse=True):
        load[load.index(min(load))] += size
    mine = defaultdict(int)
    for r in got:
        mine[r.shard] += r["size"]
    assert sorted(mine.values()) == sorted(load)


def test_stages_take_columns_of_any_name(spark):
    """Columns named like what the operators and the pipeline work with pass through unchanged."""
    import corpus_pipeline

    names = ["__doc", "__th", "toxicity_score", "lines_dropped", "lines_kept", "n_dropped_", "k0", "k1", "th", "score", "node", "maybe", "key"]
    rows = [(i, f"a line that stays alone {i}\nthe same long line everywhere", "en", "s", None, *(f"{n}{i}" for n in names)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.keep_one_of_near_copies):
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert got.columns == docs.columns
        for r in got.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
    cut = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert cut == {i: f"a line that stays alone {i}" + ("\nthe same long line everywhere" if i == 0 else "") for i in range(6)}
    kept = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and kept.count() == 6
