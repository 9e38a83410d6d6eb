"""Vector code compression: each vector becomes one byte-sized index for each of its parts (product codes).

The nearest entry of a codebook is found by slicing and intersecting. For every dimension of a part the entries' coordinates are
sorted, and place k of that order carries a 64-bit mask of the first k entries. A probe gives an initial radius: the
distance of some entry. No entry beyond that radius in any single dimension can be nearer, so the masks of the range
[x - radius, x + radius] of each dimension, ANDed, hold the nearest entry and all its ties; those candidates are measured exactly.

All numbers are integers, so results depend neither on the order of rows nor on how Spark divides them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.llm.common import BROADCAST_KEYS, written

U64 = np.uint64
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components stay below this, so that squared distances of up to 128 components fit in 64 bits.
LARGEST = 2**27
#: Dimensions whose neighbour in sorted order is probed for the initial radius.
PROBES = 4


class Slices:
    """The codebook of one part, its coordinates sorted by dimension with the mask of every prefix."""

    def __init__(self, entries: np.ndarray):
        if len(entries) > 64:
            raise ValueError("a mask of 64 bits holds at most 64 entries")
        self.entries = entries
        self.order = [np.argsort(column, kind="stable") for column in entries.T]
        self.sorted = [column[o] for column, o in zip(entries.T, self.order)]
        bits = U64(1) << np.arange(len(entries), dtype=U64)
        self.prefix = [np.concatenate((np.zeros(1, U64), np.bitwise_or.accumulate(bits[o]))) for o in self.order]

    def distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((x - self.entries[at]) ** 2).sum(axis=1)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A whole number no smaller than the distance of the nearest entry: that of the best of a few probes."""
        least = np.full(len(x), np.iinfo(np.int64).max)
        for j in range(min(PROBES, x.shape[1])):
            at = np.minimum(np.searchsorted(self.sorted[j], x[:, j]), len(self.entries) - 1)
            np.minimum(least, self.distance(x, self.order[j][at]), out=least)
        return np.sqrt(least.astype(np.float64)).astype(np.int64) + 1

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries within `radius` of each row in every dimension."""
        mask = np.full(len(x), 2**64 - 1, dtype=U64)
        for j, (coordinates, prefix) in enumerate(zip(self.sorted, self.prefix)):
            low = np.searchsorted(coordinates, x[:, j] - radius, side="left")
            high = np.searchsorted(coordinates, x[:, j] + radius, side="right")
            mask &= prefix[high] ^ prefix[low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of every row; of equally near ones the lowest index."""
        best, code = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), dtype=np.int64)
        rows, mask = np.arange(len(x)), self.candidates(x, self.radius(x))
        while len(rows):
            lowest = mask & (~mask + U64(1))
            at = np.frexp(lowest.astype(np.float64))[1].astype(np.int64) - 1
            found = self.distance(x[rows], at)
            nearer = found < best[rows]  # bits rise, so an equal distance does not replace a lower index
            best[rows[nearer]], code[rows[nearer]] = found[nearer], at[nearer]
            mask ^= lowest
            more = mask != 0
            rows, mask = rows[more], mask[more]
        return code, best


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null and holds neither null nor non-finite components."""
    return vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def parts_of(column: pa.Array, parts: int) -> np.ndarray:
    """(vector, part, position) of the scaled components, floors going down."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes.min() != sizes.max() or not sizes[0] or sizes[0] % parts):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"scaled components must be below {LARGEST}")
    return scaled.astype(np.int64).reshape(len(sizes), parts, -1)


def sums(vectors: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> number and componentwise sums of the parts assigned to it.

    Every task adds up its rows first; what is shuffled and what reaches the driver is a row for each entry of the codebooks.
    """
    parts, (entries, width) = len(books), books[0].shape

    def run(batches):
        slices, n, total = [Slices(b) for b in books], np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for p, (s, x) in enumerate(zip(slices, parts_of(batch.column("embedding"), parts).swapaxes(0, 1))):
                code, _ = s.nearest(np.ascontiguousarray(x))
                n[p] += np.bincount(code, minlength=entries)
                for j in range(width):
                    total[p, :, j] += np.bincount(code, weights=x[:, j], minlength=entries).astype(np.int64)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"]
        )

    told = vectors.select("embedding").mapInArrow(run, "part int, entry int, n long, total array<long>")
    rows = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[j]) for j in range(width)]).alias("total")).collect()
    return {(r["part"], r["entry"]): (r["n"], r["total"]) for r in rows}


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part position, integers (entry, position); none if no vector is usable.

    It starts as that part of the vectors with the smallest vec_ids (null ids last, equal ids by their vectors) and is
    replaced `rounds` times by the floors of its parts' means; an entry without parts stays. Fewer vectors than `entries` make fewer entries.
    """
    kept = usable(vectors.select("vec_id", "embedding"))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).toArrow()
    if not len(first):
        return []
    books = [np.ascontiguousarray(b) for b in parts_of(first.column("embedding"), parts).swapaxes(0, 1)]
    for _ in range(rounds):
        for (p, e), (n, total) in sums(kept, books).items():
            books[p][e] = [t // n for t in total]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


CODED = "code binary, error long"


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """One row per usable row of `vectors`: vec_id, label, `code` (a byte for each part) and `error` (squared distance to the entries).

    Null vectors and those with null or non-finite components give no row; a null id or label is kept as it is; repeated rows
    are coded alike; an empty table gives none. Of equally near entries the lowest index is taken. Only vec_id, label and embedding
    are read, whatever other columns are called. Vectors of unequal length, or of one that is no multiple of the number of
    parts, are an error, and so are components too large for 64-bit distances.
    """
    kept = usable(vectors.select("vec_id", "label", "embedding"))
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, {CODED}"

    def run(batches):
        slices = [Slices(b) for b in books]
        for batch in batches:
            found = [s.nearest(np.ascontiguousarray(x)) for s, x in zip(slices, parts_of(batch.column("embedding"), len(slices)).swapaxes(0, 1))]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, schema) if books else kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """`coded` with `label_error`, the error summed over equal labels (nulls together).

    Labels are added up before they are shuffled; their sums are broadcast up to BROADCAST_KEYS labels, beyond that joined by a
    shuffle of written tables, where Spark splits a label with very many rows.
    """
    coded = written(coded, "codes")
    totals = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    small = totals.count() <= BROADCAST_KEYS
    return coded.join(F.broadcast(totals) if small else totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = train(vectors)
    return with_label_errors(encode(vectors, books)).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


QUERIES = {"op11_vector_codes": op11_vector_codes}

_DISTANCE = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, 5))


def _assigned(book: str) -> str:
    return f"SELECT vec_id, label, p, any_value(x) AS x, min(struct_pack(d := {_DISTANCE}, e := e)) AS best FROM parts JOIN {book} USING (p) GROUP BY vec_id, label, p"


def _moved(book: str, assigned: str) -> str:
    means = ", ".join(f"CAST(floor(sum(x[{i}])::DOUBLE / count(*)) AS BIGINT)" for i in range(1, 5))
    return f"SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN (SELECT p, best.e AS e, [{means}] AS c FROM {assigned} GROUP BY p, best.e) m ON b.p = m.p AND b.e = m.e"


SQL = {
    "op11_vector_codes": f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * 4 + 1 : p * 4 + 4] AS x FROM kept, range(16) r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED ({_assigned("b0")}), b1 AS MATERIALIZED ({_moved("b0", "a0")}),
a1 AS MATERIALIZED ({_assigned("b1")}), b2 AS MATERIALIZED ({_moved("b1", "a1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM coded"""
}
