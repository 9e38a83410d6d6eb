"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own = threading.local()
#: Rows that share an id and a text beyond this number are dealt out in pieces of about as many.
PIECE = 4096
#: Up to so many keys of such rows are broadcast (16 bytes each).
BROADCAST_KEYS = 500_000


@cache
def own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sparktrace-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which the driver and all executors share.

    Where that setting is absent a local master gets a temporary folder of this process; any other is an error, as
    its executors could not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = own_folder()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes `df` as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    tables().append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables() -> list[str]:
    """Paths of the intermediate tables that this thread has written, oldest first."""
    if not hasattr(_own, "tables"):
        _own.tables = []
    return _own.tables


def mark() -> int:
    """The number of this thread's intermediate tables so far, for `removed`."""
    return len(tables())


def removed(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes this thread's intermediate tables written after `since` but for the last `keep`.

    To be called when what was computed from them is itself stored, or no longer wanted.
    """
    upto = len(tables()) - keep
    gone = tables()[since:upto]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in gone:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    tables()[since:upto] = []


def let(value: Column, body) -> Column:
    """`body(v)` with `v` bound to `value`, which is evaluated once although `body` names it often."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", -1), "")


def row_key(*columns: Column) -> Column:
    """128-bit key of a row's content; equal rows share it."""
    return F.struct(F.xxhash64(F.lit(8191), *columns).alias("a"), F.xxhash64(F.lit(131071), *columns).alias("b"))


def folded(items: Column, at: Column, out: str, step, chunk: int = 64) -> Column:
    """The arrays that `step(at, item)` gives for the items in order, joined, and the last `at`: struct(at, out).

    `step` gives struct(at, out) with `out` an array of type `out`; its `at` goes to the next item. Items are taken in chunks, so
    that no array is copied once for each item of a long text.
    """
    none, one = F.array().cast(out), lambda acc, x: let(step(acc["at"], x), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))

    def chunks(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / chunk).cast("int")), lambda k: F.slice(all_, k * chunk + 1, F.lit(chunk)))
        whole = F.aggregate(
            F.when(F.size(all_) > 0, parts).otherwise(F.array_repeat(all_, 0)),
            F.struct(at.alias("at"), F.array().cast(f"array<{out}>").alias("outs")),
            lambda acc, part: let(F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), one), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["outs"], r["out"]).alias("outs"))),
        )
        return let(whole, lambda w: F.struct(w["at"].alias("at"), F.flatten(w["outs"]).alias("out")))

    return let(items, chunks)


def dealt(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """`docs` as rows `r` (struct of all columns) and `piece`: 0, but for rows that share the key columns with over PIECE others.

    The latter are written with a number of their own, so that hashes of (key, piece) spread them and stay the same
    whenever a task runs again. No row is left out.
    """
    key = row_key(*[F.col(c) for c in columns])
    often = written(docs.groupBy(key.alias("k")).count().where(F.col("count") > PIECE).select("k"), "often")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    n = often.count()
    if not n:
        return rows.withColumn("piece", F.lit(0).cast("long"))
    own = row_key(*[F.col(f"r.`{c}`") for c in columns])
    often = F.broadcast(often) if n <= BROADCAST_KEYS else often
    rows = rows.withColumn("k", own)
    hot = written(rows.join(often, "k", "left_semi").select("r", F.monotonically_increasing_id().alias("piece")), "often-rows")
    return rows.join(often, "k", "left_anti").select("r", F.lit(0).cast("long").alias("piece")).unionByName(hot)
