"""Corpus pipeline: toxicity filter, line and near deduplication, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``, further columns of the input included, whatever their
names. Stages judge rows, not ids: rows that share a doc_id but not their text
stay or go by their own text. An empty table passes every stage as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import bpe, decontamination, line_dedup, near_dedup, queries, toxicity
from pagelode.llm.common import BROADCAST_KEYS, cut, documents, fresh_path, small_side, table, unused

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below TOXIC; null, empty and wordless texts score 0 and stay, repeated rows score alike."""
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    score = unused("toxicity_score", docs)
    return toxicity.score(docs, model, score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document holds; n_chars follows the text.

    A document whose lines all go stays with an empty text, and null texts and
    rows without an id stay as they are; lines repeated within the document
    that keeps them, or in rows that share its id, stay.
    """
    dropped, bitmap = unused("lines_dropped", docs), unused("lines_kept", docs)
    done = line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs), dropped, bitmap)
    if "n_chars" in docs.columns:
        cut_short = F.col(bitmap).isNotNull()
        done = done.withColumn("n_chars", F.when(cut_short, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def without(docs: DataFrame, gone: DataFrame, *by) -> DataFrame:
    """Rows of ``docs`` without a match in ``gone``, whose columns face ``by`` one by one; nulls match nulls."""
    gone = cut(gone.distinct())
    facing = [unused(f"gone{i}", docs) for i in range(len(by))]
    gone = gone.toDF(*facing)
    on = by[0].eqNullSafe(F.col(facing[0]))
    for key, name in zip(by[1:], facing[1:], strict=True):
        on = on & key.eqNullSafe(F.col(name))
    columns = docs.columns
    return docs.join(small_side(gone, gone.count(), BROADCAST_KEYS // 2), on, "left_anti").select(*columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies; documents without words all stay, and so do rows without an id unless their class has one."""
    found = near_dedup.near_dedup(docs).where(~F.col("kept"))
    return without(docs, found.select("doc_id", "th"), docs["doc_id"], F.xxhash64(docs["text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item; null and empty texts stay, and without items all do."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")  # matches go by row
    found = decontamination.contaminated(keyed, table(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id"), F.xxhash64(docs["doc_id"], docs["text"]))


def encode_checked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): packed token ids of every row, and the digest of what they decode to; null and empty texts have no ids."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("byte BPE", encode_checked),
]

#: SQL can't express these stages; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        to = fresh_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return docs
