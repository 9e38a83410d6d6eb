"""Text files whose lines keep their number, however large a file is."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of files whose first numbers are broadcast at most (some 100 bytes each).
BROADCAST_RANGES = 100_000
#: Bytes of a file that is read whole at most.
WHOLE_BYTES = 4 << 20


def range_bytes(spark: SparkSession) -> int:
    """Bytes of a file that one task reads at most."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def numbered_lines(spark: SparkSession, path: str, files: str = "*", of: dict[str, Column] | None = None) -> DataFrame:
    """path, number, value: the lines of all files below a path that are not blank, numbered from 0 in each file.

    With `of` these columns of `path` (name -> expression) stand instead of it; they are found once for each file or range.

    Files that fit in a range (4 MB at most) are read whole and cut into lines. Larger ones are read in ranges, each in one task, where
    lines come in order. The lines of each range are counted; the sums of the counts before it in its file give its first number. So no
    large file has to fit in a task, and many small ones are read once, without a join.
    """
    most, read = min(WHOLE_BYTES, range_bytes(spark)), spark.read.option("pathGlobFilter", files)
    size, name = F.col("_metadata.file_size"), F.col("_metadata.file_path").alias("path")
    named = [c.alias(k) for k, c in (of or {"path": F.col("path")}).items()]
    lines = F.filter(F.split(F.regexp_replace("value", "^\ufeff", ""), "\r\n|\r|\n"), lambda x: F.trim(x) != "")
    small = read.text(path, wholetext=True).where(size <= most).select(name, lines.alias("_lines"))
    small = small.select(*named, "_lines").select(*(of or ["path"]), F.posexplode("_lines").alias("number", "value"))
    text = read.text(path).where((size > most) & (F.trim("value") != ""))
    rows = text.select(name, F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_seq"), "value")
    ranges = rows.groupBy("path", "_range").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    ranges = ranges.withColumn("_before", F.sum("_n").over(W.partitionBy("path").orderBy("_range")) - F.col("_n")).drop("_n")
    few = ranges.count() <= BROADCAST_RANGES
    ranges = ranges.select("path", *([c.alias(f"_{k}") for k, c in of.items()] if of else []), "_range", "_first", "_before")
    placed = rows.join(F.broadcast(ranges) if few else ranges, ["path", "_range"])
    placed = placed.select(*([F.col(f"_{k}").alias(k) for k in of] if of else ["path"]), (F.col("_before") + F.col("_seq") - F.col("_first")).alias("number"), "value")
    return placed.unionByName(small.withColumn("number", F.col("number").cast("long")))
