"""Near duplicates: MinHash banding, sequential Bayesian pruning of candidates, exact verification of the rest.

1. One pass over the texts gives each document its shingle set's size, a digest, a signature and band keys.
   Documents with equal sets form a class, which one node stands for.
2. In every bucket of a band, the member that shares most buckets overall is the centre. All others are
   compared with it, which links a large group of copies by as many pairs as it has members.
3. What these links leave in different components but in one bucket is compared completely, in blocks of
   signatures inside tasks: members outside the bucket's main component against all
   members. So every pair that shares a bucket is linked by a path or compared.

Comparison is sequential: after each batch of signature positions a pair is dropped when the posterior
probability that its similarity reaches the threshold falls below `MISS`. Survivors are confirmed on full sets.
"""

from __future__ import annotations

from itertools import chain
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.llm.common import written
from sparktrace.llm.graph import components
from sparktrace.llm.text_arrays import BASE, U64, mix, powers, shingle_set, texts

WIDTH = 5
LEAST_PERCENT = 85
#: With 26 bands of 5 rows, a pair of similarity J shares no bucket with probability (1 - J^5)^26: below 4e-7 at 0.85,
#: 3.3e-5 at 0.8. Lower thresholds need more bands.
BANDS, ROWS = 26, 5
#: Posterior probability below which a pair is given up.
MISS = 1e-5
#: Most members and most shingles on one side of a block; ids that are broadcast at most.
BLOCK, BLOCK_SHINGLES, BROADCAST_IDS = 768, 2_000_000, 500_000


def permutations(n: int = BANDS * ROWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(1, 2**63, n, dtype=U64) * U64(2) + U64(1), draw.integers(0, 2**63, n, dtype=U64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least 32-bit hash of the set under each permutation."""
    least = np.full(len(a), 2**64 - 1, dtype=U64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * a + b).min(axis=0), out=least)
    return (least >> U64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different between bands."""
    rows = sig.reshape(BANDS, ROWS).astype(U64)
    return mix((rows * powers(BASE, ROWS + 1)[1:]).sum(axis=1, dtype=U64) + np.arange(BANDS, dtype=U64) * U64(0x632BE59BD9B4E019)).view(np.int64)


FINGERPRINT = "doc_id long, n_shingles long, d1 long, d2 long, codes binary, bands array<long>"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Set size, 128-bit digest of the set, one signature byte per permutation, band keys. Whole texts."""

    def run(batches):
        a, b = permutations()
        for batch in batches:
            out = {k: [] for k in ("n_shingles", "d1", "d2", "codes", "bands")}
            for raw in texts(batch.column("text")):
                s = shingle_set(raw, WIDTH)
                out["n_shingles"].append(len(s))
                out["d1"].append(int(s.sum(dtype=U64).view(np.int64)))
                out["d2"].append(int(mix(s ^ U64(0xD6E8FEB86659FD93)).sum(dtype=U64).view(np.int64)))
                sig = signature(s, a, b) if len(s) else None
                out["codes"].append(None if sig is None else (sig & 255).astype(np.uint8).tobytes())
                out["bands"].append([] if sig is None else band_keys(sig))
            kinds = {"n_shingles": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "codes": pa.binary(), "bands": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, kinds[k]) for k, v in out.items())], names=["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FINGERPRINT)


def least_matches(n: int, percent: int = LEAST_PERCENT, miss: float = MISS) -> int:
    """Fewest equal bytes among n at which a pair may still reach the threshold.

    Prior: similarity uniform in (0, 1). A byte is equal with probability J + (1 - J) / 256.
    """
    x = percent / 100 + (1 - percent / 100) / 256
    for m in range(n + 1):
        # P(similarity >= x | m of n) of a Beta(m + 1, n - m + 1), as a binomial sum
        if sum(comb(n + 1, i) * x**i * (1 - x) ** (n + 1 - i) for i in range(m + 1)) >= miss:
            return m
    return n


def sequential(left: np.ndarray, right: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows that no batch of signature bytes rules out."""
    alive, same, before = np.arange(len(left)), np.zeros(len(left), dtype=np.int32), 0
    for upto, least in bounds:
        same = same + (left[alive, before:upto] == right[alive, before:upto]).sum(axis=1)
        ok = same >= least
        alive, same, before = alive[ok], same[ok], upto
    return alive


def batches_of(step: int = 26, percent: int = LEAST_PERCENT) -> list[tuple[int, int]]:
    return [(n, least_matches(n, percent)) for n in range(step, BANDS * ROWS + 1, step)]


def pruned(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sequential Bayesian comparison of their signatures leaves."""
    bounds = batches_of(percent=percent)
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("codes").alias(f"c{s}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(frames):
        for f in frames:
            if len(f):
                codes = [np.frombuffer(b"".join(f[c]), dtype=np.uint8).reshape(len(f), -1) for c in ("ca", "cb")]
                yield f.iloc[sequential(*codes, bounds)][["a", "b"]]

    return both.select("a", "b", "ca", "cb").mapInPandas(run, "a long, b long")


def held_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id and text of the rows whose id is among `nodes(doc_id)`. Few ids are broadcast, more are shuffled."""
    few = nodes.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(nodes) if few else nodes, "doc_id", "left_semi")


def reaches(mine: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two full shingle sets reach the threshold."""
    shared = len(np.intersect1d(mine, other, assume_unique=True))
    return 100 * shared >= percent * (len(mine) + len(other) - shared)


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    held = held_texts(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    side = lambda s: held.select(F.col("doc_id").alias(s), F.col("text").alias(f"t{s}")).hint("merge")
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches):
        last, mine = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), texts(batch.column("ta")), texts(batch.column("tb"))):
                if last is None or last[0] != a or len(last[1]) != len(ta) or not np.array_equal(last[1], ta):
                    last, mine = (a, ta.copy()), shingle_set(ta, WIDTH)
                keep.append(reaches(mine, shingle_set(tb, WIDTH), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def star_pairs(buckets: DataFrame) -> DataFrame:
    """Every member of a bucket with the bucket's centre, the member with the largest buckets overall."""
    central = buckets.groupBy("rep").agg(F.sum("size").alias("weight"))
    centres = buckets.join(central, "rep").groupBy("h").agg(F.max(F.struct("weight", (-F.col("rep")).alias("o"))).alias("best")).select("h", (-F.col("best.o")).alias("centre"))
    return buckets.join(centres, "h").where("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()


def crossing(buckets: DataFrame, named: DataFrame, classes: DataFrame, docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """Links within buckets whose ends `named(node, component)` puts in different components."""
    at = buckets.join(named.withColumnRenamed("node", "rep"), "rep", "left").select("h", "band", "rep", F.coalesce("component", "rep").alias("comp"))
    parts = at.groupBy("h", "comp").count()
    mixed = parts.groupBy("h").agg(F.max(F.struct("count", "comp")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rows = at.join(mixed.select("h", F.col("main.comp").alias("main")), "h").withColumn("outer", F.col("comp") != F.col("main"))
    rows = written(rows.drop("main"), "crossing")
    rows = rows.join(classes.select("rep", "n_shingles", "codes", "bands").hint("merge"), "rep")
    need = lambda size, shingles: F.ceil(F.greatest(size / BLOCK, shingles / BLOCK_SHINGLES))
    sizes = rows.groupBy("h").agg(need(F.count("*"), F.sum("n_shingles")).alias("of_all"), need(F.count_if("outer"), F.sum(F.when(F.col("outer"), F.col("n_shingles")))).alias("of_outer"))
    held = held_texts(docs, rows.select(F.col("rep").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "rep")
    rows = rows.join(sizes, "h").join(held.hint("merge"), "rep")
    # A member meets its bucket in blocks: (i, j) holds the i-th part of all members and the j-th of the outer ones.
    part = lambda n: F.pmod(F.xxhash64(F.lit(5), "rep"), n)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    of_all, of_outer = F.col("of_all"), F.col("of_outer")
    here = F.transform(every(of_outer), lambda j: F.struct(part(of_all).alias("i"), j.alias("j"), F.lit(False).alias("asks")))
    asks = F.transform(every(of_all), lambda i: F.struct(i.alias("i"), part(of_outer).alias("j"), F.lit(True).alias("asks")))
    keep = ["h", "band", "rep", "comp", "outer", "n_shingles", "codes", "bands", "text"]
    dealt = rows.select(*keep, F.explode(F.when(F.col("outer"), F.concat(here, asks)).otherwise(here)).alias("at"))
    dealt = dealt.select("at.i", "at.j", "at.asks", *keep).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "asks")
    bounds = batches_of(percent=percent)

    def compare(block: dict[str, np.ndarray], start: int, end: int, out: list) -> None:
        """Adds the links between the asking and the present members of one block.

        A pair with an equal key of an earlier band met in that band's bucket and is left to it.
        """
        asks = block["asks"][start:end]
        there = start + np.flatnonzero(~asks)
        rep, comp, outer, size, codes, bands, text = (block[c] for c in ("rep", "comp", "outer", "n_shingles", "codes", "bands", "text"))
        before, sets = int(block["band"][start]), {}

        def full(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_set(np.frombuffer(text[k].encode(), dtype=np.uint8), WIDTH)
            return sets[k]

        for k in start + np.flatnonzero(asks):
            at = there[(comp[there] != comp[k]) & (~outer[there] | (rep[there] > rep[k])) & (100 * np.minimum(size[there], size[k]) >= percent * np.maximum(size[there], size[k]))]
            if len(at):
                at = at[sequential(np.broadcast_to(codes[k], (len(at), codes.shape[1])), codes[at], bounds)]
            if len(at) and before:
                at = at[~(bands[at, :before] == bands[k, :before]).any(axis=1)]
            out += [(rep[k], rep[x]) for x in at if reaches(full(k), full(x), percent)]

    def run(frames):
        """Blocks come one after the other; only the open one is held."""
        held = None
        for f in chain(frames, (None,)):
            if f is not None:
                new = {c: f[c].to_numpy() for c in ("h", "i", "j", "asks", "band", "rep", "comp", "outer", "n_shingles", "text")}
                new["codes"] = np.frombuffer(b"".join(f["codes"]), dtype=np.uint8).reshape(len(f), BANDS * ROWS)
                new["bands"] = np.array(f["bands"].tolist(), dtype=np.int64).reshape(len(f), BANDS)
                held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
            if held is None:
                return
            n = len(held["h"])
            cut = np.flatnonzero((held["h"][1:] != held["h"][:-1]) | (held["i"][1:] != held["i"][:-1]) | (held["j"][1:] != held["j"][:-1])) + 1
            edges = np.concatenate(([0], cut, [n] if f is None else [])).astype(int)
            out: list = []
            for start, end in zip(edges[:-1], edges[1:]):
                compare(held, start, end, out)
            held = {c: x[edges[-1] :] for c, x in held.items()}
            if out:
                yield pd.DataFrame({"a": [min(x) for x in out], "b": [max(x) for x in out]})

    return dealt.mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of distinct 5-word shingles (A-Z lower-cased) have a Jaccard
    similarity of `percent` hundredths or more; `component_id` is the smallest doc_id that links reach. Texts that are null
    or have no words have size 0, are linked with nothing and are kept. Rows that share a doc_id count as
    one document. A null doc_id, or one that is no whole number (then null here), is linked with nothing itself. An empty table gives no rows. Very long
    texts count whole. Of equally good centres the smallest id is taken, so no result depends on the order of rows. Only doc_id and
    text are read, whatever other columns are called.
    """
    docs = docs.select(F.col("doc_id").cast("string").try_cast("long").alias("doc_id"), "text")
    prints = written(fingerprints(docs), "prints")
    usable = prints.where("n_shingles > 0 and doc_id is not null")
    classes = written(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("codes").alias("codes"), F.first("bands").alias("bands")), "classes")
    rows = classes.select("rep", F.posexplode("bands").alias("band", "h"))
    shared = rows.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    buckets = written(rows.join(shared, "h"), "buckets")

    near = written(confirmed(written(pruned(star_pairs(buckets), classes, percent), "stars"), docs, percent), "links")
    rest = written(crossing(buckets, components(near), classes, docs, percent), "links")
    # rows that share a doc_id are one document: their classes meet there
    same = usable.select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
    several = same.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    again = same.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    named = components(near.unionByName(rest).unionByName(again))
    of_class = classes.select("d1", "d2", "rep").join(named, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    # Written, so that Spark can split the rows of a set with very many copies; rows that are linked with nothing are not joined.
    found = usable.select("doc_id", "n_shingles", "d1", "d2").join(written(of_class, "class-components"), ["d1", "d2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = prints.where(~((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)


QUERIES = {"op8_near_dedup": op8_near_dedup}
SQL: dict[str, str] = {}
