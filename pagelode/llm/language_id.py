"""Language identification by nearest centroid.

A text's vector holds its letter trigrams (over lower-cased UTF-8 bytes, runs
of non-letters as one space), hashed to DIMS places, TF-IDF weighted and scaled
to length one. Every language has several centroids, found by spherical k-means
over its labelled texts; a text gets the language of the centroid with the
greatest cosine. Texts further from every centroid than REJECT_QUANTILE of the
labelled texts are from their own are marked rejected.

Learning uses at most ``bound`` labelled texts of each language (a documented
parameter); prediction reads whole texts of all rows.

Defined results: a null text or one without a letter (Unicode category L) is
``und`` with score 0; repeated rows get the same prediction each; ties go to
the first language in order; without labelled rows every text is
``und``; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelode.llm.common import over_texts

DIMS = 1 << 14
CENTROIDS = 3
BOUND = 1500
ROUNDS = 8
REJECT_QUANTILE = 0.001
CHUNK = 1 << 20
NOT_WORDS = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> str:
    """The text's letters (categories L*), lower-cased, each run of anything else as one space."""
    kept = NOT_WORDS.sub(" ", text.lower())
    # halves, superscripts and the like count as word characters; few texts hold any
    numerals = "".join(c for c in set(kept) if c != " " and not c.isalpha())
    if numerals:
        kept = re.sub(f"[{re.escape(numerals)}]", " ", kept)
    return " ".join(kept.split())


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed byte trigrams of the whole text; None if it has no letter."""
    letters = letters_of(text)
    if not letters:
        return None
    raw = np.frombuffer(f" {letters} ".encode(), np.uint8)
    out = np.zeros(DIMS, np.float32)
    for at in range(0, len(raw) - 2, CHUNK):
        a = raw[at : at + CHUNK + 2].astype(np.uint32)
        code = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)
        out += np.bincount(code >> np.uint32(18), minlength=DIMS)
    return out


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang, at, value = [], [], []
        for text, name in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            counts = gram_counts(text)
            if counts is not None:
                hit = np.flatnonzero(counts)
                lang.append(name)
                at.append(hit.astype(np.int16).tobytes())
                value.append(np.minimum(counts[hit], 65535).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["lang", "at", "value"])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from evenly spaced rows of the order by similarity to the mean, so it is the same every time."""
    order = np.argsort(x @ _unit(x.mean(0)), kind="stable")
    centres = x[order[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]]
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(1)
        centres = np.stack([_unit(x[near == j].mean(0)) if (near == j).any() else centres[j] for j in range(len(centres))])
    return centres


def learn(sample: DataFrame) -> dict:
    """Model from labelled (text, lang) rows, a bounded sample."""
    rows = over_texts(sample.select("text", "lang"), _sparse, "lang string, at binary, value binary").collect()  # at most ``bound`` rows a language
    rows.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["value"])))
    if not rows:
        return {"langs": [], "centres": np.zeros((0, DIMS), np.float32), "owner": [], "idf": np.ones(DIMS, np.float32), "reject": 0.0}
    df = np.zeros(DIMS, np.float32)
    for r in rows:
        df[np.frombuffer(r["at"], np.int16)] += 1
    idf = np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + 1
    langs, centres, owner, own = sorted({r["lang"] for r in rows}), [], [], []
    for i, name in enumerate(langs):
        mine = [r for r in rows if r["lang"] == name]
        x = np.zeros((len(mine), DIMS), np.float32)
        for j, r in enumerate(mine):
            x[j, np.frombuffer(r["at"], np.int16)] = np.log1p(np.frombuffer(r["value"], np.uint16))
        x = _unit(x * idf)
        c = _clusters(x, CENTROIDS)
        own.append((x @ c.T).max(1))
        centres.append(c)
        owner += [i] * len(c)
    return {"langs": langs, "centres": np.concatenate(centres).astype(np.float32), "owner": owner, "idf": idf, "reject": float(np.quantile(np.concatenate(own), REJECT_QUANTILE))}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS vectors of DIMS a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs, idf, owner = m["langs"], m["idf"], np.array(m["owner"], int)
        by_dim = np.ascontiguousarray(m["centres"].T)
        for b in batches:
            name, score, rejected = [], [], []
            for text in b.column("text").to_pylist():
                counts = gram_counts(text) if text and langs else None
                if counts is None:
                    name.append("und")
                    score.append(0.0)
                    rejected.append(True)
                    continue
                hit = np.flatnonzero(counts)
                v = np.log1p(counts[hit]) * idf[hit]
                cosine = (v @ by_dim[hit]) / max(float(np.linalg.norm(v)), 1e-9)
                best = int(cosine.argmax())
                name.append(langs[owner[best]])
                score.append(float(min(1.0, max(0.0, cosine[best]))))
                rejected.append(bool(cosine[best] < m["reject"]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return over_texts(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")
