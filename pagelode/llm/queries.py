"""Named queries of the corpus operators over the test tables, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

import public_tokenizers

from pagelode.llm import bpe, centroids, decontamination, exact_dedup, language_id, line_dedup, near_dedup, pii, prefix_trie, quality, sharding, token_files, toxicity
from pagelode.llm.common import documents, learning_sample, remainder, stands_for, table


def op1_sharding(spark, sf_dir):
    """All documents dealt to shards 0..15 so that the shards' bytes come out near equal."""
    placed = sharding.shard(documents(spark, sf_dir), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_language_id(spark, sf_dir):
    """Language of every document by nearest centroid, learned from the rows that aren't held out."""
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 4) == 2
    labels = docs.select("doc_id", "lang")
    model = language_id.learn(learning_sample(docs, labels, "lang", ~held_out, language_id.BOUND))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality(spark, sf_dir):
    """Calibrated quality score of every document, learned from the labelled rows that aren't held out."""
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.learn(learning_sample(docs, labels, "quality", ~held_out, quality.BOUND))
    predicted = (F.col("score") >= quality.PREDICT).cast("int")
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op4_exact_dedup(spark, sf_dir):
    """Every document with the smallest id among equal normalised texts."""
    out = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


def op5_byte_bpe(spark, sf_dir):
    """Token ids of every document and what they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op6_pii(spark, sf_dir):
    """Personal data of every document: counts and places of the base kinds, and all spans with disclosing terms."""
    found = pii.sensitive_spans(documents(spark, sf_dir))
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.concat("base", "terms")).alias("spans"),
        (F.size("base") + F.size("terms")).cast("long").alias("n_spans"),
    )


def op7_toxicity(spark, sf_dir):
    """Toxicity score of every document, learned from the labelled rows that aren't held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def toxicity_model(docs, labels):
    """Model learned from the labelled rows whose id isn't held out."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    learned = remainder(F.col("doc_id"), 5) != 0
    weight = stands_for(rows, "toxic", learned, toxicity.BOUND)
    return toxicity.learn(learning_sample(docs, rows, "toxic", learned, toxicity.BOUND), weight.get(0, 1.0) / weight.get(1, 1.0))


def op8_line_dedup(spark, sf_dir):
    """Per document: its lines, the lines dropped and the digest of the text that stays."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = docs.withColumn("n_lines", F.size(line_dedup.split_lines(F.col("text"))).cast("long"))
    done = line_dedup.apply_bitmaps(counted, line_dedup.line_dedup(docs))
    return done.select(
        "doc_id",
        "n_lines",
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op9_decontamination(spark, sf_dir):
    """Documents that hold a copy of a benchmark item, exact or edited."""
    return decontamination.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_near_dedup(spark, sf_dir):
    """Every document with the least id of its class of near copies."""
    return near_dedup.near_dedup(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op11_token_files(spark, sf_dir):
    """Token ids of every document from the coded files they were written to."""
    found = token_files.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_prefix_trie(spark, sf_dir):
    """Every node of the trie of prefixes that rebuilt conversations share."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_centroids(spark, sf_dir):
    """Every vector with its cluster after ten rounds over eight centroids."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


def queries():
    return {
        "op1_sharding": op1_sharding,
        "op2_language_id": op2_language_id,
        "op3_quality": op3_quality,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_pii": op6_pii,
        "op7_toxicity": op7_toxicity,
        "op8_line_dedup": op8_line_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_near_dedup": op10_near_dedup,
        "op11_token_files": op11_token_files,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_centroids": op13_centroids,
    }


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM n
"""

OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) AS gone
  FROM k LEFT JOIN f ON k.key = f.key AND length(k.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


#: CRC-32 of the decimal id, bit by bit.
CRC32_OF_ID = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"""

OP12_SQL = f"""
WITH o AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC32_OF_ID} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)
), r AS (
  SELECT c.conv_id, 0 AS part, p, role, text FROM c JOIN o ON o.conv_id = c.base AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN o USING (conv_id) WHERE p > h
), t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, strlen(text) AS bytes, sha256(strlen(role) || ':' || role || text) AS step FROM r
), x AS (
  SELECT conv_id, d, bytes, sha256(string_agg(step, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS prefix FROM t
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), m AS (
  SELECT conv_id, d, bytes, min(conv_id) OVER (PARTITION BY d, prefix) AS node, max(d) OVER (PARTITION BY conv_id) = d AS ended FROM x
), n AS (
  SELECT node, d, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
  FROM m GROUP BY node, d
), e AS (SELECT n.node, n.d, up.node AS parent FROM n JOIN m up ON up.conv_id = n.node AND up.d = n.d - 1
), k AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM e GROUP BY ALL
), s AS (
  SELECT above.node, above.d, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM n LEFT JOIN k USING (node, d) JOIN m above ON above.conv_id = n.node AND above.d <= n.d GROUP BY ALL
)
SELECT n.node AS conv_id, n.d::BIGINT AS depth, e.parent AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (node, d) LEFT JOIN e USING (node, d) LEFT JOIN k USING (node, d)
"""


def centroids_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds written out, one pair of steps a round."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), x AS MATERIALIZED (SELECT row, unnest(v) AS a, generate_subscripts(v, 1) AS i FROM kept)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY rank NULLS LAST, v) - 1 AS c, unnest(v) AS b, generate_subscripts(v, 1) AS i
  FROM (SELECT sha256('3:' || vec_id) AS rank, v FROM kept ORDER BY rank NULLS LAST, v LIMIT {k})
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT row, c, sum((a - b) * (a - b)) AS d FROM x JOIN c{r} USING (i) GROUP BY row, c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)")
        if r < rounds:
            mean = f"SELECT c, i, sum(a) AS s, count(*) AS n FROM x JOIN a{r} USING (row) GROUP BY c, i"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, b)::BIGINT AS b FROM c{r} LEFT JOIN ({mean}) USING (c, i))")
    last = f"""h AS (SELECT c, sha256(string_agg(b::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (row) JOIN h USING (c)"""
    return "WITH " + ",\n".join([*steps, last])


def oracle_sql():
    return {"op4_exact_dedup": OP4_SQL, "op8_line_dedup": OP8_SQL, "op12_prefix_trie": OP12_SQL, "op13_centroids": centroids_sql()}
