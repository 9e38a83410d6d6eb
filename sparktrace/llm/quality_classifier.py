"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded as a vector of measured shares and hashed
byte pairs; a learned layer maps it to an embedding; gated attention weights, learned from document labels
alone, pool the embeddings of all passages, and a logistic unit scores the pooled representation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.llm.common import written
from sparktrace.llm.text_arrays import lower, texts, word_bounds, word_hashes

PASSAGE = 64
PAIRS = 48
SHARES = 15
FEATURES = SHARES + PAIRS
HIDDEN, GATE = 16, 8
#: The most labelled documents that training takes, drawn by hash from all labelled rows of the training folds, and the most
#: passages of them all that the driver holds (252 bytes each). Each document counts with all of its passages.
SAMPLE, PASSAGES = 6000, 400_000
EPOCHS, BATCH, RATE = 12, 64, 0.01


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def encode(raw: np.ndarray) -> np.ndarray:
    """A row per passage of the whole text; one row of zeros for a text without words."""
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.zeros((1, FEATURES), dtype=np.float32)
    first = np.arange(0, len(starts), PASSAGE)
    n = len(first)
    words = np.minimum(PASSAGE, len(starts) - first).astype(np.float64)
    of_word = np.arange(len(starts)) // PASSAGE
    at = starts[first]
    inside = raw[at[0] :]
    at = at - at[0]
    total = lambda mask: np.add.reduceat(mask.astype(np.int64), at)
    upper = total((inside >= 65) & (inside <= 90))
    small = total((inside >= 97) & (inside <= 122))
    digit = total((inside >= 48) & (inside <= 57))
    high = total(inside >= 128)
    marks = [total(inside == ord(c)) for c in "|!<>*"]
    other = total(((inside > 32) & (inside < 48)) | ((inside > 57) & (inside < 65)) | ((inside > 90) & (inside < 97)) | ((inside > 122) & (inside < 128)))
    stops = total((inside == 46) | (inside == 44))
    lines = total(inside == 10)
    size = np.diff(np.append(at, len(inside))).astype(np.float64)
    hashes = word_hashes(lower(raw))
    kinds = np.bincount(np.unique(np.stack([of_word.astype(np.uint64), hashes]), axis=1)[0].astype(np.int64), minlength=n)
    stutter = np.bincount(of_word[1:], weights=(hashes[1:] == hashes[:-1]), minlength=n)
    length = np.bincount(of_word, weights=(ends - starts), minlength=n)
    columns = [upper / size, small / size, digit / size, high / size, *(4 * m / words for m in marks), (other - stops) / words, stops / words, lines / words, kinds / words, stutter / words, length / words / 8]
    low = lower(inside)
    pair = (low[:-1].astype(np.int64) * 31 + low[1:]) * 2654435761 % 4294967291 % PAIRS
    of_byte = np.searchsorted(at, np.arange(len(pair)), side="right") - 1
    grams = np.bincount(of_byte * PAIRS + pair, minlength=n * PAIRS)[: n * PAIRS].reshape(n, PAIRS) / size[:, None]
    return np.concatenate([np.stack(columns, axis=1), 4 * grams], axis=1).astype(np.float32)


def forward(p: dict, x: np.ndarray, starts: np.ndarray) -> tuple:
    """Scores of bags whose passages are rows of `x` from each of `starts` on."""
    z = (x - p["mean"]) / p["scale"]
    h = np.tanh(z @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["w"]
    sizes = np.diff(np.append(starts, len(x)))
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    pooled = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return 1 / (1 + np.exp(-np.clip(pooled @ p["c"] + p["d"], -30, 30))), (z, h, t, g, a, pooled, sizes)


SHAPE = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": ()}


def gradient(p: dict, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict:
    """Derivatives of the weighted mean log loss of the bags by the parameters."""
    score, (z, h, t, g, a, pooled, sizes) = forward(p, x, starts)
    out = (score - labels) * weight / len(labels)
    grad = {"c": pooled.T @ out, "d": out.sum()}
    back = np.repeat(out[:, None] * p["c"], sizes, axis=0)  # of the pooled vector, at each passage
    da = (back * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
    grad["w"] = (t * g).T @ de
    dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
    grad["V"], grad["U"] = h.T @ dt, h.T @ dg
    dh = (back * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    grad["W"], grad["b"] = z.T @ dh, dh.sum(axis=0)
    return grad


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> dict:
    """Learns encoder, gates and output by Adam on the log loss, with both labels weighing the same."""
    rng = np.random.default_rng(seed)
    n = sum(len(b) for b in bags)
    mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / n
    p = {"mean": mean, "scale": np.sqrt(sum(((b - mean) ** 2).sum(axis=0) for b in bags) / n) + 1e-3}
    p |= {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if s else np.zeros(()) for k, s in SHAPE.items()}
    m, v, step = {k: np.zeros(s) for k, s in SHAPE.items()}, {k: np.zeros(s) for k, s in SHAPE.items()}, 0
    share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            starts = np.cumsum([0, *(len(bags[i]) for i in pick[:-1])])
            grad = gradient(p, np.concatenate([bags[i] for i in pick]), starts, labels[pick], weight[pick])
            step += 1
            for k in SHAPE:
                d = grad[k] + 1e-5 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - RATE * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = PASSAGES) -> dict | None:
    """Trains on at most `sample` labelled documents outside the held-out fold; None if there are none.

    The labelled ids are narrowed by hash before their texts are joined. Texts are encoded whole, in tasks, and their
    passage vectors written. In the order of the hash the driver takes each document, whole, that
    leaves the passages taken at most `passages` together.
    A row with a null id or label is left out, as is one whose id is no whole number; of a repeated id the greatest label and the smallest text count.
    Null, empty and very long texts are encoded like any others; empty tables give no model; only doc_id, text and quality are read.
    """
    number = F.col("doc_id").cast("string").try_cast("long").alias("doc_id")
    marked = labels.select(number, "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit(3), "doc_id")
    chosen = marked.orderBy(order, "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            vectors = [encode(raw) for raw in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([len(x) for x in vectors], pa.int64()), pa.array([x.tobytes() for x in vectors], pa.binary())], names=["doc_id", "y", "n", "x"])

    picked = docs.select(number, "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max(F.col("y").cast("int")).alias("y"))
    encoded = written(picked.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, n long, x binary"), "passages")
    sizes = encoded.select("doc_id", "n").orderBy(order, "doc_id").collect()
    some, room = [], passages
    for r in sizes:  # one that does not fit is passed over, so no single document costs the model
        if r["n"] <= room:
            some.append(r)
            room -= r["n"]
    if not some:
        return None
    last = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in some], "doc_id long")
    rows = sorted(encoded.join(F.broadcast(last), "doc_id", "left_semi").select("doc_id", "y", "x").collect())
    return train([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["y"] for r in rows], dtype=float))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """All columns of `docs` and `quality_score` (double, 0 to 1), one row for each; 0.5 for all without a model.

    Null and empty texts are one passage of zeros; very long texts count whole; repeated rows are scored alike; an empty table gives no
    rows. Only the text enters a score; a column named quality_score is replaced, whatever its case.
    """

    def run(batches):
        for batch in batches:
            out = []
            for raw in texts(batch.column("text")):
                out.append(0.5 if model is None else float(forward(model, encode(raw), np.zeros(1, dtype=np.int64))[0][0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "quality_score"])

    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "quality_score"])
    fields = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, quality_score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Learns from `labels.quality` outside the fold crc32(doc_id) mod 3 = 1; ids, lang and source never enter a
    score. Null and empty texts are scored as one passage of zeros; repeated rows each get a row; an empty table
    gives no rows; without usable labels every score is 0.5. Very long texts are encoded and scored whole. No score depends on
    the order of rows. Only doc_id and text are read, whatever other columns are called.
    """
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
SQL: dict[str, str] = {}
