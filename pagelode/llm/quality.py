"""Quality scores from compression with two dictionaries.

One zstandard dictionary is built from labelled good text, one from bad text. A
text is cut into blocks; each is compressed with either dictionary, and the
difference of the compressed sizes over the block's size says which kind it
resembles (without blocks a long text would soon be its own dictionary). The
mean, the least and the greatest difference of the blocks, and how well the
text compresses at all, go through a logistic curve fitted on labelled rows,
which gives a calibrated score.

Learning uses at most ``bound`` labelled rows of each label value, LEARN_BYTES
of text in all, and of these at most DICT_BYTES for each dictionary (documented
parameters); scores read whole texts of all rows.

Defined results: a null text scores like the empty one, the calibrated score of
no difference; repeated rows score alike; with only one label value every score
is its share, without any 0.5; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import over_texts

BOUND = 2500
DICT_SIZE = 64 << 10
DICT_BYTES = 6 << 20
LEARN_BYTES = 128 << 20
SAMPLE_BYTES = 4096
BLOCK = 1024
LEVEL = 1
PREDICT = 0.7


def blocks(raw: bytes) -> list[bytes]:
    """Equal blocks of at most 1.5 BLOCK bytes that cover the text."""
    n = max(1, round(len(raw) / BLOCK))
    step = -(-len(raw) // n) if raw else 1
    return [raw[i : i + step] for i in range(0, len(raw), step)]


class Scales:
    """Compressors for both dictionaries and without one."""

    def __init__(self, good: bytes, bad: bytes):
        self.of = [zstandard.ZstdCompressor(level=LEVEL, dict_data=self._digested(d), write_content_size=False) for d in (good, bad)]
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    @staticmethod
    def _digested(raw: bytes):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        return d

    def features(self, text: str | None) -> list[float]:
        """Mean, least and greatest difference (bad minus good size, over the block's bytes) and the size without a dictionary."""
        raw = (text or "").encode()
        if not raw:
            return [0.0, 0.0, 0.0, 0.0]
        good, bad = (c.compress for c in self.of)
        diff, weight, size = [], [], 0
        for b in blocks(raw):
            diff.append((len(bad(b)) - len(good(b))) / len(b))
            weight.append(len(b))
            size += len(self.plain.compress(b))
        mean = sum(d * w for d, w in zip(diff, weight, strict=True)) / len(raw)
        return [mean, min(diff), max(diff), size / len(raw)]


def own_lines(texts: list[str], often: set[str]) -> list[str]:
    """The texts without lines that several labelled texts share: those mark no quality."""
    return [x for t in texts if (x := "\n".join(line for line in t.split("\n") if line not in often))]


def dictionary(texts: list[str], seed: int = 1) -> bytes:
    """A zstandard dictionary of at most DICT_BYTES of the texts' blocks, drawn evenly from all of them."""
    parts = [p for t in texts for p in blocks(t.encode())]
    random.Random(seed).shuffle(parts)
    total, used = 0, []
    for p in parts:
        if total + len(p) > DICT_BYTES:
            break
        total += len(p)
        used.append(p)
    try:
        return zstandard.train_dictionary(min(DICT_SIZE, max(1024, total // 4)), used).as_bytes()
    except zstandard.ZstdError:  # too few samples to train: raw content serves as the dictionary
        return b"".join(used)[-DICT_SIZE:]


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> dict:
    """Newton steps on a ridge-penalised logistic loss over standardised features."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(h, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "w": w}


def shape(f: np.ndarray) -> np.ndarray:
    """Features and their products, so that the curve can bend."""
    f = np.atleast_2d(f)
    return np.hstack([f, f[:, :1] ** 2, f[:, 1:2] * f[:, 3:4], f[:, 2:3] * f[:, 3:4], f[:, 3:4] ** 2])


def apply_logistic(m: dict, x: np.ndarray) -> np.ndarray:
    z = np.hstack([np.clip((x - m["mean"]) / m["scale"], -20, 20), np.ones((len(x), 1))])
    return 1 / (1 + np.exp(-np.clip(z @ m["w"], -30, 30)))


def learn_rows(rows: list[tuple[int, str, int]]) -> dict:
    """Model from (doc_id, text, label) rows. Half of them make the dictionaries, the others the curve, so the curve sees texts as new as any."""
    rows = sorted(rows, key=lambda r: r[0])
    labels = {r[2] for r in rows}
    if labels != {0, 1}:
        return {"constant": 0.5 if not rows else float(np.mean([r[2] for r in rows]))}
    random.Random(7).shuffle(rows)
    by = {v: [r for r in rows if r[2] == v] for v in (0, 1)}
    half = {v: max(1, len(x) // 2) for v, x in by.items()}
    seen = Counter(line for r in rows for line in set(r[1].split("\n")))
    often = {line for line, n in seen.items() if n > 1}
    dicts = {v: dictionary(own_lines([r[1] for r in x[: half[v]]], often) or [r[1] for r in x]) for v, x in by.items()}
    scales = Scales(dicts[1], dicts[0])
    rest = [r for v, x in by.items() for r in (x[half[v] :] or x)]
    x = shape(np.array([scales.features(r[1]) for r in rest]))
    y = np.array([r[2] for r in rest], float)
    return {"good": dicts[1], "bad": dicts[0], "curve": fit_logistic(x, y)}


def learn(sample: DataFrame) -> dict:
    """Model from (doc_id, text, quality 0/1) rows, a bounded sample, taken in order of a hash up to LEARN_BYTES."""
    rows, size = [], 0
    for r in sample.select("doc_id", "text", "quality").where("quality in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        size += len(r["text"].encode())
        if rows and size > LEARN_BYTES:
            break
        rows.append((r["doc_id"], r["text"], r["quality"]))
    return learn_rows(rows)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_SIZE bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scales = None if "constant" in m else Scales(m["good"], m["bad"])
        for b in batches:
            texts = b.column("text").to_pylist()
            if scales is None:
                out = np.full(len(texts), m["constant"])
            elif texts:
                out = apply_logistic(m["curve"], shape(np.array([scales.features(t) for t in texts])))
            else:
                out = np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return over_texts(docs.select("doc_id", "text"), run, "doc_id long, score double")
