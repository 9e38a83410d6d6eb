"""Near duplicates among embeddings by an epsilon grid order join.

Vectors are scaled to length one, so a cosine of c is a distance of sqrt(2 - 2c), the epsilon of the join.

1. Equal vectors form a class, which one node stands for; its rows are counted, not joined.
2. The vectors are turned to their principal dimensions. A grid of cells as wide as epsilon over the leading ones gives each vector
   a cell, and the cells' lexicographic order a sequence, which is sorted, written and cut into chunks of bounded size.
3. Chunks, then within a task halves of their intervals down to blocks, are joined recursively. Two intervals whose boxes lie
   further apart than epsilon are skipped; so are chunks that share no slab of the first dimension.
4. Two blocks that remain are compared in the leading dimensions and the length of the rest, which bound the distance from
   below; what that leaves is measured by the cosine in double precision.

A task gives a number of links for each vector and, for components, only links that join what was apart, so a large group of near copies
is counted completely without a row for each of its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.llm.common import row_key, written
from sparktrace.llm.graph import components

COSINE = 0.95
#: Principal dimensions that carry the grid and the lower bound of distances.
LEADING = 24
#: Bytes of vectors in a chunk (a task holds two) and vectors in a block.
CHUNK_BYTES, BLOCK = 8 << 20, 512
#: Pairs of chunks that are broadcast at most (16 bytes each).
BROADCAST_PAIRS = 500_000


def usable(embedding: str = "embedding"):
    """Not null, without null or non-finite components, and not zero."""
    c = F.col(embedding)
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0), F.lit(False))


def rows_of(column: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of a list column as rows in their own type; shorter ones are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and sizes.min() == dimension:
        return flat.reshape(len(sizes), dimension)
    x = np.zeros((len(sizes), dimension), dtype=flat.dtype)
    x[np.arange(dimension) < sizes[:, None]] = flat
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """The rows in double precision, scaled to length one."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(classes: DataFrame, dimension: int, leading: int = LEADING) -> np.ndarray:
    """The leading principal dimensions of all unit vectors, as columns.

    Every task adds up its rows' products; the driver gets the sums, (dimension + 1) squared numbers. Any orthonormal columns would
    give the same links, these let the grid separate most.
    """

    def run(batches):
        total = np.zeros((dimension + 1, dimension + 1))
        for batch in batches:
            x = unit(rows_of(batch.column("embedding"), dimension))
            x = np.hstack((x, np.ones((len(x), 1))))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    parts = classes.select("embedding").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    m = np.zeros((dimension + 1, dimension + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        m[r["i"], r["j"]] = r["x"]
    n, mean = max(m[-1, -1], 1.0), m[-1, :-1]
    values, vectors = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean) / n**2)
    return np.ascontiguousarray(vectors[:, ::-1][:, : min(leading, dimension)])


def epsilon_of(cosine: float) -> float:
    return float(np.sqrt(2 - 2 * cosine))


def sequence(classes: DataFrame, dimension: int, basis: np.ndarray, epsilon: float, ranges: int) -> DataFrame:
    """The vectors in epsilon grid order, packed into blocks: range, nodes, weights and vectors of each, and its box.

    Ties of cells are ordered by node, so that also a cell with very many vectors is divided.
    """

    def cells(batches):
        for batch in batches:
            at = np.floor(unit(rows_of(batch.column("embedding"), dimension)) @ basis / epsilon)
            key = (np.clip(at, -127, 127) + 128).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in key], pa.binary()), *(batch.column(c) for c in ("node", "n", "embedding"))], names=["cell", "node", "n", "embedding"])

    kind = classes.schema["embedding"].dataType.simpleString()
    placed = classes.select("node", "n", "embedding").mapInArrow(cells, f"cell binary, node long, n long, embedding {kind}")
    placed = placed.repartitionByRange(ranges, "cell", "node").sortWithinPartitions("cell", "node").select("node", "n", "embedding")

    def blocks(batches):
        held: list[pa.RecordBatch] = []

        def packed(table: pa.Table) -> pa.RecordBatch:
            x = rows_of(table.column("embedding"), dimension)
            p = unit(x) @ basis
            node, n = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("node", "n"))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            values = [table.num_rows, node, n, x.tobytes(), p.min(axis=0).tolist(), p.max(axis=0).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["rows", "nodes", "weights", "vectors", "low", "high"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, BLOCK))
                held = table.slice(BLOCK).to_batches()
        if sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held))

    packed = placed.mapInArrow(blocks, "rows long, nodes binary, weights binary, vectors binary, low array<double>, high array<double>")
    return written(packed.withColumn("at", F.monotonically_increasing_id()), "grid-order")


def chunked(blocks: DataFrame, chunk_rows: int) -> DataFrame:
    """`blocks` with `chunk`: stretches of the sequence of about `chunk_rows` vectors, and never more than a block beyond that.

    What a window sees is one row for each range of the sequence, some thousands at most.
    """
    from pyspark.sql import Window

    spans = blocks.groupBy(F.shiftright("at", 33).alias("range")).agg(F.sum("rows").alias("of"))
    spans = spans.select("range", (F.sum("of").over(Window.orderBy("range")) - F.col("of")).alias("start"))
    placed = blocks.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(spans), "range")
    return written(placed.withColumn("chunk", F.floor((F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) * BLOCK) / chunk_rows)).drop("range", "start"), "chunks")


def chunk_pairs(blocks: DataFrame, leading: int, epsilon: float) -> DataFrame:
    """(i, j), i <= j: the chunks whose boxes are within epsilon. Chunks are looked up by slabs of the first dimension, one row each."""
    boxes = blocks.groupBy("chunk").agg(*[F.min(F.col("low")[k]).alias(f"l{k}") for k in range(leading)], *[F.max(F.col("high")[k]).alias(f"h{k}") for k in range(leading)])
    boxes = boxes.select("chunk", F.array(*[f"l{k}" for k in range(leading)]).alias("low"), F.array(*[f"h{k}" for k in range(leading)]).alias("high"))
    slab = lambda x: F.floor(x / epsilon)
    here = boxes.select("chunk", "low", "high", F.explode(F.sequence(slab(F.col("low")[0]), slab(F.col("high")[0]))).alias("slab"))
    asks = boxes.select(F.col("chunk").alias("i"), F.col("low").alias("a"), F.col("high").alias("b"), F.explode(F.sequence(slab(F.col("low")[0]) - 1, slab(F.col("high")[0]) + 1)).alias("slab"))
    gap = F.aggregate(F.sequence(F.lit(0), F.lit(leading - 1)), F.lit(0.0), lambda s, k: s + F.pow(F.greatest(F.lit(0.0), F.col("a")[k] - F.col("high")[k], F.col("low")[k] - F.col("b")[k]), 2))
    both = asks.join(here, "slab").where((F.col("i") <= F.col("chunk")) & (gap <= epsilon**2 + 1e-6))
    return both.select("i", F.col("chunk").alias("j")).distinct()


class Joined:
    """The links between two chunks, or within one."""

    def __init__(self, blocks: pd.DataFrame, dimension: int, kind: str, basis: np.ndarray, cosine: float):
        self.node = np.frombuffer(b"".join(blocks["nodes"]), dtype=np.int64)
        self.weight = np.frombuffer(b"".join(blocks["weights"]), dtype=np.int64)
        self.x = unit(np.frombuffer(b"".join(blocks["vectors"]), dtype=kind).reshape(-1, dimension))
        self.cosine, self.half = cosine, (2 - 2 * cosine) / 2
        self.edges = np.concatenate(([0], np.cumsum(blocks["rows"].to_numpy())))
        p = self.x @ basis
        self.low, self.high = (f.reduceat(p, self.edges[:-1], axis=0) for f in (np.minimum, np.maximum))
        rest = np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1)))
        square, one = -((p * p).sum(axis=1) + rest * rest) / 2, np.ones(len(p))
        # left[a] . right[b] is minus half the squared distance in the leading dimensions and the length of the rest
        self.left, self.right = (np.column_stack((p, rest, *more)).astype(np.float32) for more in ((square, one), (one, square)))
        self.count, self.parent = np.zeros(len(p), dtype=np.int64), np.arange(len(p))

    def apart(self, a0: int, a1: int, b0: int, b1: int) -> bool:
        gap = np.maximum(0, np.maximum(self.low[a0:a1].min(axis=0) - self.high[b0:b1].max(axis=0), self.low[b0:b1].min(axis=0) - self.high[a0:a1].max(axis=0)))
        return float(gap @ gap) / 2 > self.half + 1e-6

    def join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        """All links between the blocks a0..a1 and b0..b1, which are the same or lie one after the other."""
        todo = [(a0, a1, b0, b1)]
        while todo:
            a0, a1, b0, b1 = todo.pop()
            same = (a0, a1) == (b0, b1)
            if not same and self.apart(a0, a1, b0, b1):
                continue
            if a1 - a0 == 1 and b1 - b0 == 1:
                self.compare(a0, b0)
            elif same:
                m = (a0 + a1) // 2
                todo += [(a0, m, a0, m), (a0, m, m, a1), (m, a1, m, a1)]
            elif a1 - a0 >= b1 - b0:
                m = (a0 + a1) // 2
                todo += [(a0, m, b0, b1), (m, a1, b0, b1)]
            else:
                m = (b0 + b1) // 2
                todo += [(a0, a1, b0, m), (a0, a1, m, b1)]

    def compare(self, a: int, b: int) -> None:
        s, t = slice(self.edges[a], self.edges[a + 1]), slice(self.edges[b], self.edges[b + 1])
        near = self.left[s] @ self.right[t].T >= np.float32(-self.half - 2e-5)
        if not near.any():
            return
        if near.mean() > 0.02:  # many remain: one product of the whole vectors
            near &= self.x[s] @ self.x[t].T >= self.cosine
            u, v = np.nonzero(near)
        else:
            u, v = np.nonzero(near)
            ok = np.einsum("ij,ij->i", self.x[s][u], self.x[t][v]) >= self.cosine
            u, v = u[ok], v[ok]
        if a == b:
            u, v = u[u < v], v[u < v]
        if len(u):
            u, v = u + s.start, v + t.start
            self.count += np.bincount(u, weights=self.weight[v], minlength=len(self.count)).astype(np.int64)
            self.count += np.bincount(v, weights=self.weight[u], minlength=len(self.count)).astype(np.int64)
            self.union(u, v)

    def union(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.parent[u], self.parent[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                root = self.parent[self.parent]
                if np.array_equal(root, self.parent):
                    break
                self.parent = root

    def found(self) -> pd.DataFrame:
        """For each vector with links their number here, and the node it hangs on."""
        at = np.flatnonzero(self.count)
        return pd.DataFrame({"node": self.node[at], "links": self.count[at], "other": self.node[self.parent[at]]})


def links(classes: DataFrame, dimension: int, cosine: float) -> DataFrame:
    """(node, links, other): for every pair of chunks the number of a node's links there and a node of its component there."""
    epsilon, kind = epsilon_of(cosine), "float32" if classes.schema["embedding"].dataType.elementType.typeName() == "float" else "float64"
    chunk_rows = max(BLOCK, CHUNK_BYTES // (np.dtype(kind).itemsize * dimension))
    total, basis = classes.count(), principal(classes, dimension)
    blocks = chunked(sequence(classes, dimension, basis, epsilon, total // chunk_rows + 1), chunk_rows)
    pairs = written(chunk_pairs(blocks, basis.shape[1], epsilon), "chunk-pairs")
    meets = pairs.select(F.col("i").alias("chunk"), "i", "j").union(pairs.where("i <> j").select(F.col("j").alias("chunk"), "i", "j"))
    dealt = blocks.drop("low", "high").join(F.broadcast(meets) if pairs.count() <= BROADCAST_PAIRS else meets, "chunk")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("at", ignore_index=True)
        joined = Joined(f, dimension, kind, basis, cosine)
        if f["i"][0] == f["j"][0]:
            joined.join(0, len(f), 0, len(f))
        else:
            first = int((f["chunk"] == f["i"][0]).sum())
            joined.join(0, first, first, len(f))
        return joined.found()

    return written(dealt.groupBy("i", "j").applyInPandas(run, "node long, links long, other long"), "links")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Vectors are linked when their cosine, in double precision, is `cosine` or more; `n_links` counts the other rows linked directly,
    `component_id` is the smallest vec_id that links reach. Null and zero vectors and those with null or non-finite
    components are linked with nothing and kept. Repeated rows are linked with each other; rows that share an id are vectors of
    their own; a null id is never the smallest, and names only a component that has no other. A shorter vector counts as
    padded with zeros. An empty table gives no rows. Only vec_id and embedding are read, whatever other columns are called.
    """
    if vectors.schema["embedding"].dataType.simpleString() != "array<float>":
        vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(vectors.select("vec_id", F.when(usable(), row_key("embedding")).alias("k")), "vector-keys")
    good = vectors.where(usable()).select("vec_id", "embedding")
    classes = good.groupBy(row_key("embedding").alias("k")).agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    dimension = classes.agg(F.max(F.size("embedding"))).first()[0]
    if dimension is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = links(classes, dimension, cosine)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = classes.select("k", "node", "least", "n").join(counts, "node", "left").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = written(known, "known-classes")
    smallest = written(known.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    of_class = written(known.join(smallest, "component").select("k", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "class-links")
    # Both sides are written, so Spark can split the rows of a vector with very many copies; rows without links are not joined.
    linked = rows.where("k is not null").join(of_class, "k").select("vec_id", "n_links", "component_id")
    alone = rows.where("k is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(F.col("vec_id").cast("long").alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")


QUERIES = {"op13_embedding_dedup": op13_embedding_dedup}
SQL = {
    "op13_embedding_dedup": """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT CAST(vec_id AS BIGINT) AS vec_id, coalesce(n, 0) AS n_links, CAST(least(vec_id, coalesce(l.b, vec_id)) AS BIGINT) AS component_id, vec_id = least(vec_id, coalesce(l.b, vec_id)) AS kept
FROM embeddings LEFT JOIN least l ON l.a = vec_id LEFT JOIN counts c ON c.a = vec_id"""
}
