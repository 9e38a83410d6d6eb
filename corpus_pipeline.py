"""From raw documents to training shards, in five stages.

Each stage reads what its predecessor wrote. `run(spark, sf_dir)` applies them to `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.llm import decontaminate, mixing, near_dedup, quality_classifier, sharding
from sparktrace.llm.common import mark, removed, row_key, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Hundredths of similarity from which documents are near duplicates.
SIMILAR = 80
#: Words from which a benchmark item is evidence; shorter ones occur in clean documents by chance.
EVIDENCE = 6
#: Times that a document of a scarce source may appear in the mixture.
MOST_EPOCHS = 4.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels outside its held-out fold, does not reject.

    Null, empty and very long texts are scored like others, whole; a null id is no label's; repeated rows are judged alike and all
    stay or go. Without labels nothing is rejected; an empty table gives none. Columns other than those of documents are dropped here, so none can clash.
    """
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs.select(*COLUMNS), model).where("quality_score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = SIMILAR) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Rows with a null id stay.

    Documents whose similarity is `percent` hundredths or more are near duplicates. Rows that share an id are one document: of
    those that stay, the smallest by (text, lang, source, n_chars) does, so a repeated row is left once. Null and empty texts
    are duplicates of nothing; an empty table gives none; columns other than those of documents are dropped.
    """
    docs = docs.select(*COLUMNS)
    ids = written(near_dedup.near_duplicates(docs, percent).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("doc_id is not null and (n > 1 or not kept)"), "duplicate-ids")
    left = docs.join(ids, "doc_id", "left_anti")
    first = F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")
    again = docs.join(ids.where("kept").select("doc_id"), "doc_id").groupBy("doc_id").agg(first).select("doc_id", "r.*")
    return left.select(*COLUMNS).unionByName(again.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str, evidence: int = EVIDENCE) -> DataFrame:
    """Documents without a passage of the benchmark: 12 words of an item of which up to two are changed, or a shorter item of `evidence` words or more.

    A null or empty text has none; repeated rows stay or go together; very long texts are searched whole; an empty benchmark
    or table takes nothing; columns other than those of documents are dropped.
    """
    docs = docs.select(*COLUMNS)
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where(F.col("longest") >= evidence).select(row_key("doc_id", "text").alias("row")).distinct()
    return docs.select(*COLUMNS, row_key("doc_id", "text").alias("row")).join(gone, "row", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """All documents in the order of the mixture, so any first part of the table has the target weights.

    Documents of scarce sources are repeated, at most `most_epochs` times, until the table as a whole has these weights too; what a source
    cannot fill goes to the others; none is dropped. A null source is the source ''. Null, empty and very long texts and repeated rows are documents like others; an empty table gives none; columns other than those of
    documents are dropped.
    """
    placed = written(mixing.mix(docs.select(*COLUMNS), epochs=True, most_epochs=most_epochs), "mixture")
    return placed.orderBy("slot", "place").select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of the mixture in shuffled shards: the columns of documents, shard, slot and grown_shard.

    Null ids and null, empty or very long texts are placed like others; repeated rows (the mixture's epochs are such) each
    have a slot; an empty table gives none; columns other than those of documents are dropped.
    """
    return sharding.shuffle_into_shards(docs.select(*COLUMNS))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("shards", shards)]

#: SQL expresses neither the trained classifier nor the seeded shuffle; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's result is written to the shared folder and read again.

    A stage's intermediate tables are deleted when its result is written, and so is the result before it.
    """
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        removed(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
