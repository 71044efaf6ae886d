"""Language identification with error-correcting output codes.

Features are hashed byte pairs and triples of the whole text (A-Z lower-cased, other ASCII but letters read as space),
as square roots of counts scaled to length one. Each language has a codeword; one logistic classifier for each bit is
fitted on a bounded sample of labelled documents (`per_language` for each language at most, chosen by a hash of id and
text). Decoding takes the codeword with the least loss, where each bit's logistic loss counts by the bit's accuracy in
training; a prediction whose runner-up is closer than `margin` is flagged ambiguous.

Null texts and texts without a letter are `und` with score 0. Null ids are kept and train; documents without a language
never train. Without any training document all are `und`. Equal texts get equal predictions; of languages of equal loss
the first by name is taken, and the prediction is ambiguous. A text of any length is read whole, by one task. An empty
table gives an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, held_out, table, text_bytes

PER_LANGUAGE = 600
HALF = 2048  # features of pairs, and of triples

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """float32 rows of 2 * HALF features."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    text = np.full(len(data) + 2 * n + 2, 32, np.uint32)
    text[np.arange(len(data)) + 2 * doc + 1] = _PLAIN[data]
    two = text[:-2] << 8 | text[1:-1]
    three = (two << 8 | text[2:]) * np.uint32(2654435761) >> np.uint32(21)
    two = two * np.uint32(2654435761) >> np.uint32(21)
    at = np.repeat(np.arange(n) * 2 * HALF, size + 2)
    x = np.bincount(at + two, minlength=2 * HALF * n) + np.bincount(at + (three + HALF), minlength=2 * HALF * n)
    x = np.sqrt(x.astype(np.float32)).reshape(n, 2 * HALF)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    some = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=some[1:])
    out = some[offsets[1:]] > some[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def codewords(n: int) -> np.ndarray:
    """One row of +-1 bits for each of n classes: all distinct splits for few classes, else rows of a Hadamard matrix."""
    if n <= 6:
        bits = [[1 if c == 0 else 2 * (b >> (c - 1) & 1) - 1 for b in range(2 ** max(n - 1, 0) - 1)] for c in range(n)]
        return np.array(bits, np.float32).reshape(n, -1)
    h = np.ones((1, 1), np.float32)
    while len(h) < n + 1:
        h = np.block([[h, h], [h, -h]])
    rows = h[1 : n + 1, 1:]
    return rows[:, np.abs(rows.sum(0)) < n]


def fit(x: np.ndarray, label: np.ndarray, codes: np.ndarray, rounds: int = 120, rate: float = 40.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, bias, reliability of each bit) of the bit classifiers."""
    y = codes[label]
    share = 1 / np.bincount(label, minlength=len(codes))[label][:, None] / len(codes)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = -y * share / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        vw = 0.9 * vw - rate * (x.T @ g + decay * w) * 0.5
        vb = 0.9 * vb - 0.1 * g.sum(0)
        w, b = w + vw.astype(np.float32), b + vb.astype(np.float32)
    right = ((y * (x @ w + b) > 0) * share).sum(0)
    return w, b, np.maximum(2 * right - 1, 0.05).astype(np.float32)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE):
    """(languages, codewords, weights, bias, reliability) from `docs` (doc_id, text, lang)."""
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return [], np.zeros((0, 0), np.float32), None, None, None
    share = F.create_map(*(F.lit(v) for x in names for v in (x, min(1.0, per_language / counts[x]))))[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30))

    def rows_of(batches):
        for block in blocks(batches, limit=1 << 20):
            x = features(*text_bytes(block)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([block.column("lang").combine_chunks(), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    found = sorted((r["lang"], bytes(r["x"])) for r in chosen.select("lang", "text").mapInArrow(rows_of, "lang string, x binary").collect())
    names = sorted({lang for lang, _ in found})
    x = np.frombuffer(b"".join(v for _, v in found), np.float16).reshape(len(found), -1).astype(np.float32)
    label = np.array([names.index(lang) for lang, _ in found])
    codes = codewords(len(names))
    return names, codes, *fit(x, label, codes)


def predict(docs: DataFrame, model, margin: float = 0.05, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score and ambiguous for each row of `docs`."""
    names, codes, w, b, weight = model
    schema = ", ".join(f"`{k}` {dict(docs.dtypes)[k]}" for k in keep) + ", lang_pred string, score double, ambiguous boolean"

    def rows(batches):
        for block in blocks(batches, limit=2 << 20):
            for lo in range(0, block.num_rows, 1000):
                part = block.slice(lo, 1000).combine_chunks()
                data, o = text_bytes(part)
                known = has_letter(data, o) & bool(names)
                if names:
                    f = np.clip(features(data, o) @ w + b, -30, 30)
                    loss = np.logaddexp(0, -f[:, None, :] * codes[None]) @ weight / max(weight.sum(), 1e-9) if codes.shape[1] else np.zeros((len(f), len(names)))
                    p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
                    best = loss.argmin(1)
                    score = 1 / p.sum(1)
                    two = np.sort(loss, axis=1)[:, :2]
                    close = (two[:, 1] - two[:, 0] < margin) if len(names) > 1 else np.zeros(len(f), bool)
                    lang = [names[i] if k else "und" for i, k in zip(best, known, strict=True)]
                    score = np.where(known, score, 0.0)
                    close = close & known
                else:
                    lang, score, close = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                yield pa.RecordBatch.from_arrays([*(part.column(k).combine_chunks() for k in keep), pa.array(lang, pa.string()), pa.array(score.astype(np.float64)), pa.array(close)], names=[*keep, "lang_pred", "score", "ambiguous"])

    return docs.select(*keep, "text").mapInArrow(rows, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4))
    model = train(docs.where("not held_out"))
    return predict(docs.drop("lang"), model, keep=("doc_id", "held_out"))
