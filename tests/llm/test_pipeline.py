import hashlib
import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagelode.llm import bpe, decontamination, toxicity
from tests.llm.test_dedup import lines_by_hand, near_by_hand


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, prose(30)) for i in range(4)]
    rows = []
    for i in range(150):
        text = prose(rnd.randint(8, 60)) + "\n" + prose(rnd.randint(8, 40))
        if i % 6 == 1:
            text += "\nthe footer that many pages share"
        if i % 6 == 2 and rows:
            text = rows[rnd.randrange(len(rows))][1].replace(" ", "  ", 1) + " tail"
        if i % 10 == 3:
            text += " you idiot and stupid clown"
        if i % 25 == 5:
            text += "\n" + items[i % 4][1]
        rows.append((i, text, "en", "s", len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    to = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, 1, int("idiot" in t)) for i, t, *_ in rows[:150]], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return str(to), rows, items


def test_pipeline_matches_brute_force(spark, folder):
    to, rows, items = folder
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, to).collect()}
    model = corpus_pipeline.queries.toxicity_model(spark.read.parquet(f"{to}/documents.parquet"), spark.read.parquet(f"{to}/labels.parquet"))
    symbols, machine = toxicity.Symbols(model["stems"]), toxicity.grammar(model["kinds"])
    kept = [(i, t) for i, t, *_ in rows if toxicity.score_text(t, symbols, machine, model["kinds"]) < 0.5]
    assert not any("idiot" in (t or "") for _, t in kept)
    kept = [(i, text) for i, (_, _, text) in lines_by_hand(kept).items()]
    classes = near_by_hand(kept)
    kept = [(i, t) for i, t in kept if classes[i][2]]
    leaked = {i for i, t in kept for _, item in items if " ".join(map(bytes.decode, decontamination.split_words(item))) in " ".join(map(bytes.decode, decontamination.split_words(t)))}
    kept = {i: t for i, t in kept if i not in leaked}
    assert leaked and set(got) == set(kept)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    token = {v: k for k, v in ranks.items()}
    for i, r in got.items():
        ids = struct.unpack(f"<{r.n_tokens}I", bytes(r.ids))
        assert b"".join(token[x] for x in ids).decode() == (kept[i] or "")
        assert r.decoded_sha256 == hashlib.sha256((kept[i] or "").encode()).hexdigest()


def test_stage_columns(spark, folder):
    to, _, _ = folder
    docs = spark.read.parquet(f"{to}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "byte BPE"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, to)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_clashing_columns_and_rows_of_one_id(spark, folder):
    """Columns named like inner ones stay as they are; rows that share an id go by their own text."""
    to, _, items = folder
    shared = "a line that both of these rows hold"
    rows = [
        (1, f"{shared}\nfirst text of its own", "mine", "n"),
        (2, shared, "mine", "n"),
        (2, "a unique line, only here", "mine", "n"),
        (3, "some words " + items[0][1], "mine", "n"),
        (3, "quite another text without any copy", "mine", "n"),
        (4, "quite another text without any copy", "mine", "n"),
        (5, "you are an idiot, a stupid clown and a moron", "mine", "n"),
        (5, "you are all most welcome here", "mine", "n"),
        (None, None, "mine", "n"),
        (None, shared, "mine", "n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, n_dropped string")
    for name in ("keep_bitmap", "th", "label", "stop", "node", "maybe"):
        docs = docs.withColumn(name, F.lit("mine"))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, to)
        assert docs.columns == columns
        docs = docs.cache()
    got = docs.collect()
    assert all(r.score == r.th == r.keep_bitmap == "mine" and r.n_dropped == "n" for r in got)
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([
        (1, f"{shared}\nfirst text of its own"), (2, ""), (2, "a unique line, only here"), (3, "quite another text without any copy"),
        (4, ""), (5, "you are all most welcome here"), (0, ""), (0, shared),
    ])
    assert corpus_pipeline.encode_checked(spark, docs, to).count() == len(got)


def test_stages_pass_an_empty_table(spark, folder, none):
    to, _, _ = folder
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, to)
    assert docs.count() == 0
