"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the 1- to 4-byte grams of the lower-cased UTF-8 text with white space runs as one blank. Each hashes
to a row of the embedding table; a text is the average of its rows; a softmax over learned languages follows.
Trained by stochastic gradient descent in numpy, then calibrated: a temperature and a rejection threshold are
chosen on a part of the training rows that the descent did not see.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.llm.text_arrays import texts

BUCKETS, WIDTH = 1 << 13, 16
GRAMS = (1, 2, 3, 4)
#: The most rows of the training folds that the fit takes, drawn by hash; a fifth of them calibrates.
SAMPLE = 4000
EPOCHS, BATCH, RATE, DECAY = 12, 32, 20.0, 0.85
#: Share of correct calibration rows that rejection may lose.
LOST = 0.01
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def gram_counts(raw: np.ndarray) -> np.ndarray:
    """Average weight of each bucket over all grams of the whole text."""
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    blank = (low == 32) | ((low >= 9) & (low <= 13))
    low = np.where(blank, np.uint8(32), low)[~(blank & np.roll(blank, 1))] if len(low) else low
    x = np.concatenate(([32], low, [32])).astype(np.uint32)
    counts = np.zeros(BUCKETS, dtype=np.float32)
    h = np.zeros(len(x), dtype=np.uint32)
    for n in range(1, GRAMS[-1] + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint32(0x01000193) ^ x[n - 1 :]
        if n in GRAMS:
            mixed = (h ^ np.uint32(n * 0x9E37)) * np.uint32(0x85EBCA6B)
            counts += np.bincount((mixed >> np.uint32(19)).astype(np.int64), minlength=BUCKETS).astype(np.float32)
    return counts / max(counts.sum(), 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding table, softmax weights and bias by mini-batch descent on the log loss."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (x.shape[1], WIDTH)).astype(np.float32)
    w, b, rate = rng.normal(0, 0.1, (WIDTH, classes)).astype(np.float32), np.zeros(classes, np.float32), RATE
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            mean = x[pick] @ table
            out = softmax(mean @ w + b)
            out[np.arange(len(pick)), y[pick]] -= 1
            out /= len(pick)
            back = out @ w.T
            w -= rate * 0.05 * (mean.T @ out)
            b -= rate * 0.005 * out.sum(axis=0)
            table -= rate * (x[pick].T @ back)
        rate *= DECAY
    return table, w, b


def calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature of least log loss, and the score that all but LOST of the correct rows reach at it."""
    best = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean())
    sure = softmax(logits / best)
    right = np.sort(sure.max(axis=1)[sure.argmax(axis=1) == y])
    return best, float(right[int(LOST * len(right))]) if len(right) else 0.0


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Model of the languages of `docs.lang`, from at most `sample` rows outside the held-out fold; None without rows.

    Rows are chosen by id alone, one for each id (that with the smallest lang and text), then their whole texts are counted in
    tasks; the driver gets `sample` vectors at most. Rows with a null id, text or lang are left out, as are rows whose lang is the name for unknown.
    Texts count whole, however long; an empty text is one without grams; no other column is read.
    """
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    rows = docs.where(usable).select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(sample)
    picked = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.lang", "r.text")

    def run(batches):
        for batch in batches:
            packed = []
            for raw in texts(batch.column("text")):
                c = gram_counts(raw)
                at = np.flatnonzero(c)
                packed.append(at.astype(np.int32).tobytes() + c[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(packed, pa.binary())], names=["doc_id", "lang", "x"])

    got = sorted(picked.mapInArrow(run, "doc_id string, lang string, x binary").collect())
    if not got:
        return None
    langs = sorted({r["lang"] for r in got})
    x = np.zeros((len(got), BUCKETS), dtype=np.float32)
    for i, r in enumerate(got):
        half = len(r["x"]) // 2
        x[i, np.frombuffer(r["x"][:half], dtype=np.int32)] = np.frombuffer(r["x"][half:], dtype=np.float32)
    y = np.array([langs.index(r["lang"]) for r in got])
    rest = np.random.default_rng(1).permutation(len(got))
    check, learn = (rest[: len(got) // 5], rest[len(got) // 5 :]) if len(got) >= 50 else (rest, rest)
    table, w, b = train(x[learn], y[learn], len(langs))
    logits = x[check] @ (table @ w) + b
    temperature, least = calibrated(logits, y[check])
    return {"langs": langs, "fold": (table @ w).astype(np.float32), "bias": b, "temperature": temperature, "least": least}


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score, rejected. Whole texts.

    `und` with score 0 if the text is null or has no letter, or if there is no model. `rejected`: the calibrated
    score is below the threshold at which 1 % of correct rows are lost, as text in no learned language would be. A null id is kept; repeated rows are
    predicted alike; of equal scores the first language by name counts; an empty table gives no rows. Only doc_id and text are read.
    """

    def run(batches):
        for batch in batches:
            names, scores, out = [], [], []
            for raw, valid in zip(texts(batch.column("text")), batch.column("text").is_valid().to_pylist()):
                letter = valid and len(raw) and (bool((((raw | 32) >= 97) & ((raw | 32) <= 122)).any()) or any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace")))
                if model is None or not letter:
                    names.append(UNKNOWN), scores.append(0.0), out.append(True)
                    continue
                p = softmax((gram_counts(raw) @ model["fold"] + model["bias"]) / model["temperature"])
                k = int(p.argmax())
                names.append(model["langs"][k]), scores.append(float(p[k])), out.append(float(p[k]) < model["least"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score, rejected.

    Learns from text and lang outside the fold crc32(doc_id) mod 5 = 0; lang, source and doc_id enter no
    prediction. Repeated rows each get a row; empty texts are `und`; an empty table gives no rows; very long texts count whole;
    of languages with equal scores the first by name is predicted. Only doc_id, text and lang are read, whatever other columns are called.
    """
    out = identify(docs, fit(docs))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
