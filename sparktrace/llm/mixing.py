"""Mixing sources to target weights by Pfair scheduling of their blocks.

Time is a sequence of slots, one block each. The ideal mixture serves all sources at once at their weights; when a source
has nothing left, the others share its rate by theirs. A block is released in the slot in which the ideal begins it and due
when the ideal has finished it (for a source of weight w: block i from i / w to (i + 1) / w). In each slot the released
block with the earliest deadline goes. No deadline is missed then, as the ideal itself fits, so at every slot a
source has had as many blocks as in the ideal to within less than one.

The schedule is a table of (source, block, slot). It is made in one task from a row for each source, as each slot depends on those before it; that task
holds a few blocks of each source at a time, whatever their number, and takes some microseconds a block of documents. The places of
all documents are joins with the table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparktrace.llm.common import dealt, written

#: Documents of a block, and rows of the schedule that are made at once.
BLOCK_DOCS, BATCH = 16, 1 << 16
#: Power of the source's size in the default weights; below 1 small sources weigh more than their share.
TEMPER = 0.7
#: Documents of a chunk, in which rows are numbered, up to FINE chunks a source; larger sources have larger ones.
CHUNK_DOCS, FINE = 1024, 1 << 18
#: Weights are whole parts of this many (fewer where a source has more than 2^22 blocks, so that products stay below 2^62); a source has one at least.
PARTS = 1 << 40
#: Up to so many rows of the schedule or of the table of sources are broadcast (some 60 bytes each).
BROADCAST_ROWS = 500_000
OWN = ("block", "slot", "place")


def slots_in_order(blocks: list[int], weights: list[float]):
    """The source and block of every slot in order, as batches (sources, blocks), by earliest deadline first.

    A source's blocks are released and due in order, so only its next one waits. Releases and deadlines are made some blocks ahead.
    """
    scale = min(PARTS, 1 << (62 - max(blocks, default=1).bit_length())) / sum(weights or [1])
    rate = [max(1, round(w * scale)) for w in weights]
    # The ideal's time is piecewise linear in the work per weight: `held` blocks are done, `active` weights go on.
    ends = sorted((n / r, n, r) for n, r in zip(blocks, rate))
    at = np.array([e[0] for e in ends])
    held = np.concatenate(([0], np.cumsum([e[1] for e in ends])))
    active = sum(rate) - np.concatenate(([0], np.cumsum([e[2] for e in ends])))
    ahead = max(16, min(4096, (1 << 22) // max(1, len(blocks))))

    def times(n: int, r: int):
        """(release, deadline) of a source's blocks in order."""
        for first in range(0, n, ahead):
            i = np.arange(first, min(first + ahead, n) + 1)
            piece = np.searchsorted(at, i / r, side="left")
            whole, part = np.divmod(active[piece] * i, r)
            whole = whole + held[piece]
            yield from zip(whole[:-1].tolist(), (whole + (part > 0))[1:].tolist())

    waits = [times(n, r) for n, r in zip(blocks, rate)]
    future = [(*first, k) for k, w in enumerate(waits) if (first := next(w, None))]
    heapq.heapify(future)
    ready, had, sources, numbers = [], [0] * len(blocks), [], []
    for t in range(sum(blocks)):
        while future and future[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(future)[1:])
        k = heapq.heappop(ready)[1]
        sources.append(k)
        numbers.append(had[k])
        had[k] += 1
        if after := next(waits[k], None):
            heapq.heappush(future, (*after, k))
        if len(sources) == BATCH:
            yield np.array(sources), np.array(numbers)
            sources, numbers = [], []
    if sources:
        yield np.array(sources), np.array(numbers)


def schedule(blocks: list[int], weights: list[float]) -> list[np.ndarray]:
    """The slots of each source's blocks in order."""
    order = np.concatenate([k for k, _ in slots_in_order(blocks, weights)] or [np.zeros(0, np.int64)])
    return [np.flatnonzero(order == k) for k in range(len(blocks))]


def slots_of(sources: DataFrame) -> DataFrame:
    """(s, block, slot) of all blocks of `sources(s, blocks, weight)`. One task holds a row for each source."""

    def run(frames):
        all_ = pd.concat([f for f in frames if len(f)] or [pd.DataFrame({"s": [], "blocks": [], "weight": []})]).sort_values("s")
        names, slot = all_["s"].to_numpy(), 0
        for k, number in slots_in_order([int(n) for n in all_["blocks"]], all_["weight"].tolist()):
            yield pd.DataFrame({"s": names[k], "block": number, "slot": np.arange(slot, slot + len(k))})
            slot += len(k)

    return sources.select("s", "blocks", "weight").repartition(1).mapInPandas(run, "s string, block long, slot long")


def mix(docs: DataFrame, weights: dict[str, float] | DataFrame | None = None, block_docs: int = BLOCK_DOCS, seed: int = 11, epochs: bool = False, most_epochs: float | None = None) -> DataFrame:
    """All rows and columns of `docs` plus block (of its source), slot (of the block) and place (in the block).

    Ordered by (slot, place) the rows are the mixture. Every row appears once; with `epochs` the rows of scarce
    sources are repeated, whole epochs and the start of one more, until each source's share of all rows is its
    target weight, so the source that is largest for its weight appears once and none is dropped. With `most_epochs` no source is
    repeated more often than that; the shares of sources that this leaves below their weight go to the others in proportion. Without `weights` a
    source's weight is its number of rows to the power 0.7; sources missing from given weights, a dict or a table(source, weight), get the least one given.
    Rows of a source are numbered in hashed order inside chunks, so no task holds a whole source.

    A null source is the source ''. Null, empty or very long texts are mixed like others, as a block is a number of rows; repeated rows
    each get a place; rows equal in doc_id and text may change places with each other on another run; an empty table gives
    no rows. Input columns named like the three new ones are replaced.
    """
    spark = docs.sparkSession
    if isinstance(weights, dict):
        weights = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double") if weights else None
    least = None
    if weights is not None:
        given = written(weights.select(F.coalesce("source", F.lit("")).alias("s"), F.col("weight").cast("double").alias("weight")), "mixing-weights")
        least, wrong = given.agg(F.min("weight"), F.count_if(~F.coalesce(F.col("weight") > 0, F.lit(False)) | F.isnan("weight"))).first()
        if wrong:
            raise ValueError("weights must be above 0")
    names = [c for c in docs.columns if c.lower() not in OWN]
    rows = dealt(docs).withColumn("s", F.coalesce(F.col("r.source"), F.lit("")))
    rows = rows.withColumn("o", F.xxhash64(F.lit(seed), F.col("r.doc_id"), F.col("r.text"), F.col("piece")))
    rows = rows.withColumn("fine", F.pmod(F.xxhash64(F.lit(seed + 1), "o"), F.lit(FINE)))
    counts = written(rows.groupBy("s", "fine").count(), "mixing-counts")

    sizes = counts.groupBy("s").agg(F.sum("count").alias("size"))
    if least is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(TEMPER)))
    else:
        sizes = sizes.join(given.groupBy("s").agg(F.max("weight").alias("weight")), "s", "left").withColumn("weight", F.coalesce("weight", F.lit(least)))
    scale = sizes.agg(F.max(F.col("size") / F.col("weight"))).first()[0] or 0.0
    total = F.greatest(F.col("size"), F.rint(F.lit(scale) * F.col("weight")).cast("long")) if epochs else F.col("size")
    if epochs and most_epochs is not None:
        total = F.least(total, F.floor(F.greatest(F.lit(float(most_epochs)), F.lit(1.0)) * F.col("size")))
    sizes = written(sizes.withColumn("total", total), "mixing-sizes")
    n_sources, n_rows = sizes.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    chunks = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("size") / CHUNK_DOCS, F.lit(1.0))))).cast("long"), F.lit(FINE))
    sources = sizes.select("s", "size", "total", "weight", chunks.alias("chunks"), F.ceil(F.col("total") / block_docs).alias("blocks"))
    slots = written(slots_of(sources), "mixing-slots")
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    per = few(sources.select("s", "size", "total", "chunks"), n_sources)

    # Numbers in a source: rows in a chunk, then the chunks before it.
    before = W.partitionBy("s").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunk = (F.col("fine") % F.col("chunks")).alias("chunk")
    starts = counts.join(per, "s").groupBy("s", chunk).agg(F.sum("count").alias("n")).select("s", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    in_chunk = W.partitionBy("s", "chunk").orderBy("o", "r.doc_id", "r.text")
    numbered = rows.join(per, "s").withColumn("chunk", chunk).withColumn("n", F.row_number().over(in_chunk) - 1).join(starts, ["s", "chunk"]).withColumn("n", F.col("n") + F.col("start"))
    if epochs:
        last = F.floor((F.col("total") - 1 - F.col("n")) / F.col("size"))
        numbered = numbered.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("n", F.col("n") + F.col("epoch") * F.col("size"))
    numbered = numbered.select("r", "s", F.floor(F.col("n") / block_docs).alias("block"), (F.col("n") % block_docs).alias("place"))
    placed = numbered.join(few(slots, n_rows // block_docs + n_sources), ["s", "block"])
    return placed.select(*[F.col(f"r.`{c}`").alias(c) for c in names], "block", "slot", "place")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a weight from 1 to 5 for each source, drawn from its name, so that the order is not that of the sources' sizes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = docs.groupBy("source").count().select("source", (F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(5)) + 1).cast("double").alias("weight"))
    return mix(docs, weights).select("doc_id", "source", "block", "slot", "place")


QUERIES = {"op6_mixing": op6_mixing}
SQL: dict[str, str] = {}
