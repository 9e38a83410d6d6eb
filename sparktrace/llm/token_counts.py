"""Token counts with a digest cache.

Content digests and the tokenizer's version digest are joined to stored counts; each distinct missing text is
encoded once, and its count is appended to the cache.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.llm.common import new_folder, written

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CACHE = "digest binary, n_tokens long, tokenizer string"


def version_of(path: str) -> str:
    """Digest of the tokenizer's file; a changed file finds no old counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def content_digest():
    """SHA-256 of the normalised content. The normal form of a null text is the empty one; any other text is its own, since
    counts are those of the text as it is and two texts that differ in one byte can differ in tokens."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def encode_counts(misses: DataFrame, path: str, version: str) -> DataFrame:
    """(digest, text) -> (digest, n_tokens, tokenizer); whole texts, without begin, end or added special tokens.

    The driver reads the model (a file of at most a few MB) and sends it to the executors.
    """
    with open(path, "rb") as f:
        model_file = misses.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=model_file.value)
        for batch in batches:
            counts = []
            column = batch.column("text").to_pylist()
            for at in range(0, len(column), 64):
                counts += [len(x) for x in model.encode([t or "" for t in column[at : at + 64]], num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64()), pa.array([version] * len(counts), pa.string())], names=["digest", "n_tokens", "tokenizer"])

    return misses.select("digest", "text").mapInArrow(run, CACHE)


def known_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest and n_tokens that the cache holds for the tokenizer; none if there is no cache yet. Other tokenizers' folders are not read."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, model_path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit.

    `cache` is a Parquet folder with a part for each tokenizer that grows by the texts it lacked; it may be empty or absent. A null text
    counts as empty (0 tokens), equal texts are encoded once, an empty table encodes nothing; very long texts are encoded whole;
    counts do not depend on the order of rows. Only doc_id and text are read, whatever other columns are called.
    A failed append leaves no rows, and rows that two runs append both are read once.
    """
    spark = docs.sparkSession
    version = version_of(model_path)
    keyed = docs.select(content_digest().alias("digest"), "text")
    # One copy of each text first, which tasks choose before they shuffle, so a very common text meets nowhere whole.
    misses = keyed.groupBy("digest").agg(F.first("text").alias("text")).join(known_counts(spark, cache, version).select("digest"), "digest", "left_anti")
    encode_counts(misses, model_path, version).write.mode("append").partitionBy("tokenizer").option("compression", "zstd").parquet(cache)
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), content_digest().alias("digest"))
    # Written first, so that the join has a plain exchange on both sides and Spark can split a text with very many copies.
    counts = written(known_counts(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of this call's own, so that the query encodes every distinct text of its table."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL), new_folder(spark, "token-counts"))


QUERIES = {"op3_token_counts": op3_token_counts}
SQL: dict[str, str] = {}
