"""A bank of noise traces at a lower rate, kept up to date: only new and changed traces are resampled."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.operators import series

TRIAL = ("dataset", "trial")
#: Samples a second of traces without times.
NATIVE_FS = 121.9
METHOD = "mean"


def with_times(bank: DataFrame, fs: float = NATIVE_FS) -> DataFrame:
    """bank(dataset, trial, t, y) in double precision, null times counted from 0 at `fs`, pairs that are not finite left out."""
    times = F.coalesce(F.col("t").cast("array<double>"), F.transform("y", lambda _, i: i / F.lit(fs)))
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))
    pairs = F.filter(F.arrays_zip(times.alias("t"), F.col("y").cast("array<double>").alias("y")), lambda p: finite(p["t"]) & finite(p["y"]))
    return bank.select(*TRIAL, pairs.alias("p")).select(*TRIAL, F.col("p.t").alias("t"), F.col("p.y").alias("y"))


def fingerprinted(bank: DataFrame) -> DataFrame:
    """`bank` with `hash`, 128 bits of the times and values."""
    part = lambda k: F.hex(F.xxhash64(F.lit(k), "t", "y"))
    return bank.withColumn("hash", F.concat(F.lpad(part(1), 16, "0"), F.lpad(part(2), 16, "0")))


def resampled(bank: DataFrame, fs: float) -> DataFrame:
    """The traces brought down to `fs`; slower ones stay as they are. Traces without a sample stay empty."""
    long = bank.select(*TRIAL, F.posexplode(F.arrays_zip("t", "y")).alias("i", "p")).select(*TRIAL, "i", "p.t", "p.y")
    low = series.resample_to(long, fs, tolerance=0.0, slower=False)
    arrays = low.groupBy(*TRIAL).agg(F.sort_array(F.collect_list(F.struct("k", "t", "y"))).alias("a")).select(*TRIAL, F.col("a.t").alias("t"), F.col("a.y").alias("y"))
    none = F.array().cast("array<double>")
    return bank.select(*TRIAL, "hash").join(arrays, list(TRIAL), "left").select(*TRIAL, "hash", F.coalesce("t", none).alias("t"), F.coalesce("y", none).alias("y"))


def entries(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    """The manifest below a path, empty before the first run."""
    schema = f"{kinds}, hash string, fs double, method string, folder string, run long"
    try:
        return spark.read.schema(schema).parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def prepare_noise_bank(bank: DataFrame, fs: float, path: str) -> DataFrame:
    """The bank at `fs`: dataset, trial, hash, t, y and `run`, the number of the run that made each trace.

    Traces whose fingerprint the manifest has at this rate are read back, the others resampled, written to a folder of their own and
    then entered in the manifest, so a run that fails leaves no entry and a second run with the same traces does nothing.
    A bank without traces and a rate that is not above 0 are errors. Keys that are repeated are an error.
    """
    if fs <= 0:
        raise ValueError("the rate must be above 0")
    spark = bank.sparkSession
    kinds = ", ".join(f"{c} {dict(bank.dtypes)[c]}" for c in TRIAL)
    keyed = fingerprinted(with_times(bank))
    total, keys = keyed.agg(F.count("*"), F.count_distinct(F.struct(*TRIAL))).first()
    if not total or keys < total:
        raise ValueError("no traces" if not total else "traces share a dataset and trial")
    have = entries(spark, path, kinds).where((F.col("fs") == fs) & (F.col("method") == METHOD))
    todo = keyed.join(have, [*TRIAL, "hash"], "left_anti")
    if not todo.isEmpty():
        folder = uuid.uuid4().hex
        run = (entries(spark, path, kinds).agg(F.max("run")).first()[0] or 0) + 1
        resampled(todo, fs).write.parquet(f"{path}/data/folder={folder}")
        made = spark.read.parquet(f"{path}/data/folder={folder}").select(*TRIAL, "hash")
        made.select(*TRIAL, "hash", F.lit(float(fs)).alias("fs"), F.lit(METHOD).alias("method"), F.lit(folder).alias("folder"), F.lit(run).cast("long").alias("run")).write.mode("append").parquet(f"{path}/manifest")
        have = entries(spark, path, kinds).where((F.col("fs") == fs) & (F.col("method") == METHOD))
    wanted = keyed.select(*TRIAL, "hash").join(have, [*TRIAL, "hash"]).select(*TRIAL, "hash", "folder", "run")
    data = spark.read.schema(f"{kinds}, hash string, t array<double>, y array<double>, folder string").parquet(f"{path}/data")
    return wanted.join(data, [*TRIAL, "hash", "folder"]).select(*TRIAL, "hash", "t", "y", "run")
