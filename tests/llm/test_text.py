import random
import re
import struct
import time

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from pagelode.llm import bpe, decontamination, language_id, pii, quality, queries, toxicity
from tests.llm.conftest import ODD

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(RANKS)


def test_bpe_matches_library(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    split, rnd = regex.compile(public_tokenizers.PATTERN).findall, random.Random(3)
    texts = [t for _, t in ODD] + ["".join(rnd.choice("ab é日本\n\t 12'sS't😀\x85\x1c<|endoftext|>") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    texts += ["ab" * 30_000, "日" * 2000, *("x" * n for n in range(1, 140))]
    merges = bpe.Merges(ranks)
    for pieces in (bpe.Pieces(merges), bpe.Pieces(merges, limit=20)):  # the second forgets often
        for at in range(0, len(texts), 40):
            part = texts[at : at + 40]
            ids = [library.encode_ordinary(t or "") for t in part]
            assert bpe.encode_texts(part, split, pieces) == [struct.pack(f"<{len(x)}I", *x) for x in ids]


def test_bpe_merges_leftmost_of_equal_ranks():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"aaa": 3}
    assert bpe.merge_piece(b"aaaab", ranks) == [2, 2, 1]
    assert bpe.merge_piece(b"a", ranks) == [0]
    unpacked = [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in bpe.Merges(ranks).packed(["aaaab", "a", "b" * 9, "ab" * 40])]
    assert unpacked == [bpe.merge_piece(x, ranks) for x in (b"aaaab", b"a", b"b" * 9, b"ab" * 40)]


def test_bpe_round_trip(odd, none):
    encoded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(encoded, RANKS).collect()}
    assert got == {i: t or "" for i, t in ODD}
    both = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, decoded=True)
    assert {r.doc_id: bytes(r.bytes).decode() for r in both.collect()} == got
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


LANGUAGES = {"aa": "kalo mira tenu sapo delu", "bb": "schtr pfung keits zwerg bluth", "cc": "ção lhão ñerro gües ávila"}


def sentences(name, n, rnd):
    return [" ".join(rnd.choice(LANGUAGES[name].split()) for _ in range(rnd.randint(3, 30))) for _ in range(n)]


def test_language_by_nearest_centroid(spark, odd, none):
    rnd = random.Random(2)
    train = [(t, name) for name in LANGUAGES for t in sentences(name, 40, rnd)]
    model = language_id.learn(spark.createDataFrame(train, "text string, lang string"))
    assert model["langs"] == ["aa", "bb", "cc"] and len(model["centres"]) <= 9
    held = [(k, t) for k, (t, _) in enumerate((t, n) for n in LANGUAGES for t in sentences(n, 20, rnd))]
    truth = [n for n in LANGUAGES for _ in range(20)]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(held, "doc_id long, text string"), model).collect()}
    assert all(got[k].lang_pred == truth[k] and 0 <= got[k].score <= 1 for k in got)
    odd_ones = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [odd_ones[i].lang_pred for i in (2, 3, 4, 10)] == ["und"] * 4
    assert odd_ones[8].rejected and odd_ones[8].lang_pred in LANGUAGES
    assert language_id.predict(none, model).count() == 0
    untrained = language_id.learn(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in language_id.predict(odd, untrained).collect()} == {"und"}


def quality_rows(n, seed):
    rnd = random.Random(seed)
    words = ["river", "stone", "gentle", "morning", "valley", "paper", "window", "garden", "silver", "market"]
    out = []
    for i in range(n):
        good = i % 2 == 0
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        out.append((i, " ".join(w) if good else "%%% ".join(x.upper() for x in w) + "!!", int(good)))
    return out


def test_quality_by_compression(spark, odd, none):
    model = quality.learn(spark.createDataFrame(quality_rows(200, 1), "doc_id long, text string, quality int"))
    test = quality_rows(100, 2)
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(test, "doc_id long, text string, quality int"), model).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, _, y in test]) >= 0.97
    scores = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[2] == scores[3] and len(scores) == len(ODD)
    assert quality.score(none, model).count() == 0
    assert quality.learn_rows([])["constant"] == 0.5 and quality.learn_rows([(1, "a", 1)])["constant"] == 1.0


def test_quality_blocks_cover_text():
    for n in (0, 1, 1000, 1600, 50_001):
        raw = bytes(range(256)) * (n // 256 + 1)
        assert b"".join(quality.blocks(raw[:n])) == raw[:n]


def test_toxicity_grammar():
    symbols, machine = toxicity.Symbols({}), toxicity.grammar(toxicity.PRIOR)
    kinds = lambda t: sorted(k for k, _ in toxicity.matches(t, symbols, machine))
    assert kinds("you are an idiot. fine day") == ["directed"]
    assert kinds("what a clown") == ["plain"]
    assert kinds("you are not an idiot") == ["negated"]
    assert kinds("she said he was a moron") == ["reported"]
    assert kinds("I will kill you") == ["threat"] and kinds("kill the process") == []
    assert kinds("not today. a clown; an idiot idiot") == ["plain", "plain"]
    assert kinds("nothing here") == []
    score = lambda t: toxicity.score_text(t, symbols, machine, toxicity.PRIOR)
    assert score("you idiot") > score("an idiot") > 0.5 > score("not an idiot") > 0 == score(None) == score("")


def every_path(parts, symbols):
    """Weight and outputs of each accepting path through a chain of transducers, one after the other."""
    found = [(1.0, list(symbols))]
    for part in parts:
        following = []
        for weight, word in found:
            paths = [(weight, [], state) for state in part.starts]
            for symbol in word:
                paths = [(w * v, [*out, o], to) for w, out, state in paths for o, v, to in part.arcs[state].get(symbol, ())]
            following += [(w, out) for w, out, state in paths if state in part.accepting]
        found = following
    return found


def test_composed_machine_equals_its_parts_in_turn():
    rnd = random.Random(12)
    kinds = toxicity.PRIOR
    parts = [toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.insult(kinds), toxicity.threat(kinds)]
    machine = toxicity.grammar(kinds)
    names = [toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.OTHER]
    for _ in range(600):
        clause = [rnd.choice(names) for _ in range(rnd.randint(0, 9))]
        paths = every_path(parts, clause)
        assert len(paths) == 1  # unambiguous
        weight, out = machine.run(clause)
        assert out == paths[0][1] and abs(weight - paths[0][0]) < 1e-12


def test_toxicity_learns_stems(spark, odd, none):
    rnd = random.Random(4)
    words = ["mela", "torvi", "sanu", "pelko", "ridan", "osta"]
    rows = []
    for i in range(400):
        w = [rnd.choice(words) for _ in range(30)]
        if i % 4 == 0:
            w[rnd.randrange(30)] = "grunz" + rnd.choice(["el", "ta", "or", "im"])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert any("grunz".startswith(s[:5]) for s in model["stems"])
    test = spark.createDataFrame([(1, "mela grunzax osta"), (2, "mela torvi osta")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(test, model).collect()}
    assert got[1] >= 0.5 > got[2]
    assert {r.score for r in toxicity.score(odd, model).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.learn(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert blank["stems"] == {} and blank["kinds"] == toxicity.PRIOR


def test_toxicity_of_a_thinned_sample(spark, monkeypatch):
    """Clean rows that the sample leaves out still count: a stem that many of them hold isn't learned."""
    monkeypatch.setattr(toxicity, "BOUND", 60)
    toxic = [(i, "a loser wrote it" if i % 2 else "los vequez son", 1) for i in range(60)]
    clean = [(i, "los nombres de la casa" if i % 5 == 0 else "plain words of a house", 0) for i in range(60, 2060)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string, toxic int")
    model = queries.toxicity_model(docs, docs.select("doc_id", "toxic"))
    assert "los" not in model["stems"] and model["stems"]
    scored = toxicity.score(docs, model)
    assert scored.where("toxic = 0 and score >= 0.5").count() == 0 and scored.where("toxic = 1 and score < 0.5").count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for o, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}
            if fits[kind]:
                out.append((m.start(), o, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_pii_base_spans_match_brute_force(spark, odd, none):
    rnd = random.Random(6)
    parts = ["a.b@c.de", "x@y.z%q@r.st", "1.2.3.4.5.6.7.8", "300.1.1.1", "0010.1.1.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 (20) 7946-0958", "+1.2", " ", "@", "..", "é😀", "-7-", "12", "\n", "a@b", "user+tag@mail.example.com", "9" * 40]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for i in range(400)] + [(1000, "1 " * 9000), (1001, "a" * 30_000 + "@"), (1002, "a@b" + ".c" * 9000)]
    found = pii.with_base(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(F.col("base")).alias("s"))
    got = {r.doc_id: r.s for r in found.collect()}
    for i, t in rows[:400]:
        assert got[i] == base_by_hand(t), t
    assert got[1000] == "" and got[1001] == "" and got[1002] == "email:0:18003"
    assert {r.s for r in pii.with_base(odd).select(pii.listed(F.col("base")).alias("s")).collect()} == {""}
    assert pii.sensitive_spans(none).count() == 0


def test_pii_many_matches_in_one_text(spark):
    """Places cost about the same however many matches a text holds."""
    card = "4111 1111 1111 1111"
    runs = "\n".join(str(i) for i in range(100_000)) + "\n" + card + "\n" + "\n".join(f"u{i}@site.org" for i in range(30_000))
    df = spark.createDataFrame([(1, runs)], "doc_id long, text string")
    pii.with_base(df.limit(0)).collect()
    began = time.monotonic()
    base = pii.with_base(df).select("base").first().base
    assert time.monotonic() - began < 20
    at = runs.index(card)
    assert [(s.start, s.end) for s in base if s.ord == 2] == [(at, at + len(card))]
    mails = [(m.start(), m.end()) for m in re.finditer(r"u\d+@site\.org", runs)]
    assert [(s.start, s.end) for s in base if s.ord == 0] == mails


def test_pii_terms_that_disclose(spark):
    rows = [(i, f"note {chr(97 + i) * 5}: Falkenrath wrote from anna@site.org, number {i}") for i in range(8)]
    rows += [(100 + i, f"other words about wrote number {i} again") for i in range(900)] + [(2000, "Only Falkenrath and nobody else"), (2001, None), (0, rows[0][1])]
    found = pii.sensitive_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {r.doc_id: r for r in pii.sanitised(found).select("doc_id", "clean", pii.listed(F.concat("base", "terms")).alias("s")).collect()}
    assert out[2000].s == "term:5:15" and out[2000].clean == "Only  and nobody else"
    assert "email:34:47" in out[3].s and "term:12:22" in out[3].s and "<EMAIL>" in out[3].clean and "Falkenrath" not in out[3].clean
    assert out[100].s == "" and out[2001].s == "" and out[2001].clean == ""
    terms = {r.term for r in pii.disclosing_terms(pii.with_base(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert "falkenrath" in terms and "wrote" not in terms and "number" not in terms


def words(n, rnd):
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(n)]


def sw(a, b):
    """Plain Smith-Waterman score."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_matches_plain_recurrence():
    rnd = random.Random(8)
    pairs = [([rnd.randint(1, 5) for _ in range(rnd.randint(1, 12))], [rnd.randint(0, 6) for _ in range(rnd.randint(1, 25))]) for _ in range(200)]
    score, _ = decontamination.align([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert score.tolist() == [sw(a, b) for a, b in pairs]


def test_decontamination_finds_copies_and_edits(spark, odd, none):
    rnd = random.Random(9)
    items = [(i, " ".join(words(40, rnd))) for i in range(12)] + [(50, "tiny item"), (51, None), (52, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs, truth = [], {}
    for i in range(120):
        body = words(rnd.randint(0, 150), rnd)
        if i % 3 == 0:
            item = i % 12
            copy = items[item][1].split()
            for _ in range(8 if i % 2 else 0):  # a fifth of the words changed, dropped or added
                at = rnd.randrange(len(copy))
                copy[at : at + 1] = rnd.choice([[], ["changed"], [copy[at], "added"]])
            at = rnd.randint(0, len(body))
            body[at:at] = [w.upper() + "," for w in copy]
            truth[i] = item
        docs.append((i, " ".join(body)))
    docs.append((500, "a TINY, item indeed"))
    got = {r.doc_id: r.item_id for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {**truth, 500: 50}
    blocks = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, block=4)
    assert {r.doc_id: r.item_id for r in blocks.collect()} == got
    assert decontamination.contaminated(odd, bench).count() == 0
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(odd, bench.limit(0)).count() == 0


def test_decontamination_keeps_seeds_of_edited_copies(spark):
    """Trigrams that an edit broke or that no document holds never stand in for those a copy still has."""
    rnd = random.Random(10)
    edited, halved = [f"e{i}" for i in range(20)], [f"h{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(halved))], "item_id long, text string")
    copy = ["changed" if i in (3, 7, 11, 15) else w for i, w in enumerate(edited)]
    late = ["changed" if i % 5 == 0 else w for i, w in enumerate(halved)][15:]
    docs = [(0, " ".join(words(30, rnd) + copy + words(30, rnd))), (1, " ".join(late))]
    docs += [(100 + i, " ".join(words(10, rnd) + halved[:20] + words(10, rnd))) for i in range(30)]
    docs += [(200 + i, " ".join(words(60, rnd) + edited[4:7])) for i in range(10)]
    got = {r.doc_id: (r.item_id, round(r.score, 2)) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {0: (1, 0.7), 1: (2, 0.45), **{100 + i: (2, 0.5) for i in range(30)}}


def test_windows_left_out_could_not_align():
    rnd = random.Random(11)
    for _ in range(400):
        item = np.array([rnd.randint(1, 30) for _ in range(rnd.randint(3, 30))])
        window = np.array([rnd.choice([0, rnd.randint(1, 30), *item.tolist()]) for _ in range(rnd.randint(3, 90))])
        score = sw(item.tolist(), window.tolist())
        if score >= 0.8 * len(item) and score >= 2 * min(6, len(item)):
            assert decontamination.can_reach(item, window, 0.4, 6)


def test_decontamination_matches_alignment_of_every_pair(spark):
    """Every document against every item by the plain recurrence: what scores 0.4 and keeps three words in a row is found, nothing else."""
    rnd = random.Random(14)
    items = [words(rnd.randint(8, 25), rnd) for _ in range(6)]
    docs = []
    for _ in range(60):
        copy = list(rnd.choice(items))
        for _ in range(rnd.randint(0, 12)):
            copy[rnd.randrange(len(copy))] = rnd.choice(["one", "two", "three"])
        docs.append(words(rnd.randint(0, 20), rnd) + copy + words(rnd.randint(0, 20), rnd))
    expected = {}
    for d, doc in enumerate(docs):
        grams = {tuple(doc[i : i + 3]) for i in range(len(doc) - 2)}
        best = [(sw(item, doc) / (2 * len(item)), -i) for i, item in enumerate(items) if any(tuple(item[k : k + 3]) in grams for k in range(len(item) - 2)) and sw(item, doc) >= max(0.8 * len(item), 12)]
        if best:
            expected[d] = (round(max(best)[0], 6), -max(best)[1])
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)] + [(0, " ".join(docs[0]))], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = decontamination.contaminated(df, bench).collect()
    assert {r.doc_id: (round(r.score, 6), r.item_id) for r in got} == expected and len(got) == len(expected) > 10


def test_short_items_need_most_of_a_document(spark):
    bench = spark.createDataFrame([(1, "river"), (2, "the river bank today")], "item_id long, text string")
    docs = [(1, "down by the river bank today we sat and talked for hours"), (2, "River!"), (3, "see the river bank today"), (4, "by the river")]
    got = {r.doc_id: r.item_id for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {2: 1, 3: 2}


def test_language_vectors_match_plain_cosine(spark):
    """Predictions equal cosines of plainly counted TF-IDF vectors with the model's centroids."""
    rnd = random.Random(15)
    model = language_id.learn(spark.createDataFrame([(t, name) for name in LANGUAGES for t in sentences(name, 30, rnd)], "text string, lang string"))
    texts = [(k, t) for k, t in enumerate(t for name in LANGUAGES for t in sentences(name, 10, rnd))] + [(100, "½ ² ① Ⅷ"), (101, "kalo ½"), (102, "_ 12 !")]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for k, t in texts:
        letters = "".join(c if c.isalpha() else " " for c in t.lower())
        raw = (" " + " ".join(letters.split()) + " ").encode()
        if not letters.strip():
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        v = np.zeros(language_id.DIMS)
        for i in range(len(raw) - 2):
            v[(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761) % 2**32) >> 18] += 1
        v = np.log1p(v) * model["idf"]
        cosine = model["centres"] @ (v / np.linalg.norm(v))
        assert got[k].lang_pred == model["langs"][model["owner"][int(cosine.argmax())]] and abs(got[k].score - cosine.max()) < 1e-4


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("op2_language_id", "op3_quality", "op7_toxicity", "op12_prefix_trie", "op13_centroids")])  # test_new.py has the last two, which aren't about documents
def test_other_queries_run(spark, name):
    """Contract columns, one row a document, and the SQL text where there is one."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    out = queries.queries()[name](spark, folder)
    rows = out.collect()
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert name == "op9_decontamination" or len({r.doc_id for r in rows}) == len(rows) == n
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(out.columns)
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(found.fetchall())


@pytest.mark.parametrize("name", ["op2_language_id", "op3_quality", "op7_toxicity"])
def test_learned_queries_hold_out(spark, name):
    """Held-out rows aren't learned from, and the contract's columns come out whole."""
    out = queries.queries()[name](spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows) and {r.held_out for r in rows} == {True, False}
