"""Two-pass external shuffle of records into shards.

Pass 1 scatters records by seeded hashes into buckets that each fit in a task's memory; pass 2 does a
Fisher-Yates shuffle inside each bucket (Spark's `shuffle` function is one) and numbers the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparktrace.llm.common import dealt, new_folder, written

OWN = ("shard", "slot", "grown_shard")
SEED = 20240229
#: Bytes of text of a bucket, which one task holds; partitions for each bucket, as those that hash to one partition are held together; the
#: most partitions of a shuffle (beyond, a task holds several buckets); the most buckets of a shard.
BUCKET_BYTES, SPREAD, MOST_PARTITIONS, FINE = 16 << 20, 2, 100_000, 1 << 16


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hash: the shard with the greatest seeded hash of (shard, key).

    One more shard changes a key's place only if the new shard wins, so rows move into it alone.
    """
    tickets = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(shards)]
    return F.array_max(F.array(*tickets))["i"]


def bucket_counts(sizes: DataFrame, bucket_bytes: int) -> dict[int, int]:
    """The number of buckets, a power of two, of each shard of `sizes(shard, bytes)`."""
    per = sizes.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()
    return {r["shard"]: min(FINE, 1 << math.ceil(math.log2(max(1.0, r["bytes"] / bucket_bytes)))) for r in per}


def shuffle_into_shards(docs: DataFrame, shards: int = 16, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """All columns of `docs` plus `shard`, `slot` (gapless from 0 in each shard) and `grown_shard`.

    `doc_id` and the number of shards alone decide `shard`; `grown_shard` is the one with a further shard.
    Bucket numbers come from the hash of (doc_id, text), so one hot id still spreads over all buckets of its
    shard; rows that share both very often are dealt apart. The number of a shard's buckets follows from its own bytes, so a
    bucket stays near `bucket_bytes` at any size, also in a shard that one hot id makes large; a longer single text makes a bucket of its own size.

    A null `doc_id` is one more key, a null or empty text counts as empty, repeated rows each keep a slot of their
    own, an empty table gives no rows. Input columns named like the three new ones are replaced. Rows that differ only in map
    columns may change places with each other on another run; all others get the same slots whatever their order.
    """
    names = [c for c in docs.columns if c.lower() not in OWN]
    plain = [c for c in names if "map<" not in docs.schema[c].dataType.simpleString()]
    text = F.coalesce(F.col("r.text"), F.lit(""))
    spread = dealt(docs).select(
        F.struct(F.xxhash64(F.lit(seed + 1), F.col("r.doc_id"), text, F.col("piece")).alias("order"), F.xxhash64(*[F.col(f"r.`{c}`") for c in plain]).alias("ties"), F.struct(*[F.col(f"r.`{c}`") for c in names]).alias("row")).alias("record"),
        shard_of(F.col("r.doc_id"), shards, seed).alias("shard"),
        shard_of(F.col("r.doc_id"), shards + 1, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 2), F.col("r.doc_id"), text, F.col("piece")), F.lit(FINE)).alias("fine"),
        (F.octet_length(text) + 1).alias("bytes"),
    )
    # One scan of the sizes of fine buckets gives the number of buckets and where each begins.
    sizes = written(spread.groupBy("shard", "fine").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "bucket-sizes")
    of_shard = bucket_counts(sizes, bucket_bytes)
    subs = F.get(F.array(*[F.lit(of_shard.get(i, 1)) for i in range(shards)]), F.col("shard"))
    sub = (F.col("fine") % subs).alias("sub")
    before = W.partitionBy("shard").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.groupBy("shard", sub).agg(F.sum("n").alias("n")).select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # Pass 1. The sorted array makes a bucket the same however its rows arrive, and the sort of buckets makes
    # the shuffle's generator see them in the same order, so a task that runs again gives equal slots.
    records = F.collect_list(F.struct("record", "grown_shard"))
    if len(plain) < len(names):
        key = lambda x: F.struct(x["record"]["order"], x["record"]["ties"])
        records = F.array_sort(records, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
    else:
        records = F.sort_array(records)
    buckets = (
        spread.select("record", "grown_shard", "shard", sub)
        .repartition(min(max(1, SPREAD * sum(of_shard.values())), MOST_PARTITIONS), "shard", "sub")
        .groupBy("shard", "sub")
        .agg(records.alias("records"))
        .sortWithinPartitions("shard", "sub")
        .select("shard", "sub", F.shuffle("records", seed).alias("records"))
    )
    # Pass 2.
    return (
        buckets.join(offsets, ["shard", "sub"])
        .select("shard", "start", F.posexplode("records").alias("at", "r"))
        .select(*[F.col(f"r.record.row.`{c}`").alias(c) for c in names], "shard", (F.col("start") + F.col("at")).alias("slot"), F.col("r.grown_shard").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Writes each shuffled bucket as rows in slot order under `path/shard=<i>/`, for all rows and columns as in `shuffle_into_shards`.

    Nulls, empty and very long texts, repeated rows and clashing names are handled as there; an empty table writes no shard.
    """
    shuffle_into_shards(docs, shards, **options).write.partitionBy("shard").option("compression", "zstd").parquet(path)


def digest_columns(sharded: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharded.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard").cast("int"),
        F.col("slot").cast("long"),
        F.col("grown_shard").cast("int"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards and reads them back."""
    folder = new_folder(spark, "shards")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_shards(docs, folder)
    return digest_columns(spark.read.schema("doc_id long, text string, slot long, grown_shard int, shard int").parquet(folder))


QUERIES = {"op1_sharding": op1_sharding}
SQL: dict[str, str] = {}
