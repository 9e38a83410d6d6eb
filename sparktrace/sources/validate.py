"""Checks of trial files before they are used: findings with a level and a code, and what was inspected."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.operators import stats

TRIAL = ("dataset", "trial")
#: Columns that a file of trials needs and may have, and the Arrow types they may be of (as patterns).
REQUIRED = {"dataset": ".*", "trial": "u?int.*", "t": "(large_)?list<.*(float|double).*>", "y": "(large_)?list<.*(float|double).*>"}
OPTIONAL = {"ap_times": "(large_)?list<.*>"}
#: What a finding may be, worst first. A note is neither an error nor a warning.
LEVELS = ("error", "warning", "note")


def file_findings(spark: SparkSession, root: str, required: dict[str, str] = REQUIRED, optional: dict[str, str] = OPTIONAL) -> DataFrame:
    """file, level, code, detail of all Parquet files below a root, from their footers, which tasks read.

    Errors: unreadable (no Parquet file), missing_column, wrong_type. Warnings: missing_optional. A file without findings has no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).select("path")

    def check(path: str) -> list[tuple]:
        try:
            store, at = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            with store.open_input_file(at) as file:
                kinds = {f.name: str(f.type) for f in pq.read_schema(file)}
        except Exception as error:  # whatever a broken file raises is its finding
            return [(path, "error", "unreadable", type(error).__name__)]
        out = [(path, "error", "missing_column", c) for c in required if c not in kinds] + [(path, "warning", "missing_optional", c) for c in optional if c not in kinds]
        return out + [(path, "error", "wrong_type", f"{c}: {kinds[c]}") for c, kind in {**required, **optional}.items() if c in kinds and not re.fullmatch(kind, kinds[c])]

    def run(frames):
        for f in frames:
            yield pd.DataFrame([x for path in f["path"] for x in check(path)], columns=["file", "level", "code", "detail"])

    return files.repartition(max(1, min(1000, files.count() // 100 + 1))).mapInPandas(run, "file string, level string, code string, detail string")


def _finite(c: str) -> Column:
    return F.filter(F.coalesce(F.col(c), F.array().cast("array<double>")), lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def trial_findings(wide: DataFrame, spikes: DataFrame | None = None) -> DataFrame:
    """dataset, trial, level, code, detail of trials(dataset, trial, t array, y array), checked as arrays; trial is null for findings on a dataset.

    Errors: no_epochs (no trial of the dataset has a time), step (times that do not advance). Warnings: shape (t and y differ in length),
    no_values (no finite value). Notes: no_times, single_time, no_spikes (no finite event of a dataset, where `spikes` are given).
    """
    times = wide.select(*TRIAL, F.col("t").cast("array<double>").alias("t"), F.col("y").cast("array<double>").alias("y"))
    times = times.select(*TRIAL, _finite("t").alias("ft"), F.size(_finite("y")).alias("fy"), F.coalesce(F.size("t"), F.lit(0)).alias("nt"), F.coalesce(F.size("y"), F.lit(0)).alias("ny"))
    back = F.size(F.filter(F.zip_with(F.slice("ft", 2, F.size("ft")), F.slice("ft", F.lit(1), F.greatest(F.size("ft") - 1, F.lit(0))), lambda b, a: b - a), lambda d: d <= 0))
    found = lambda bad, level, code, detail: F.when(bad, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), detail.cast("string").alias("detail")))
    checks = [
        found(F.col("nt") != F.col("ny"), "warning", "shape", F.concat_ws(" times, ", F.col("nt").cast("string"), F.concat(F.col("ny").cast("string"), F.lit(" values")))),
        found(F.size("ft") == 0, "note", "no_times", F.lit(None)), found(F.size("ft") == 1, "note", "single_time", F.get("ft", 0)),
        found((F.col("fy") == 0) & (F.size("ft") > 0), "warning", "no_values", F.lit(None)), found(back > 0, "error", "step", back),
    ]
    own = times.select(*TRIAL, F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("f")).select(*TRIAL, "f.*")
    none = F.lit(None).cast(wide.schema["trial"].dataType)
    empty = times.groupBy("dataset").agg(F.max(F.size("ft")).alias("n")).where("n = 0").select("dataset", none.alias("trial"), F.lit("error").alias("level"), F.lit("no_epochs").alias("code"), F.lit(None).cast("string").alias("detail"))
    out = own.unionByName(empty)
    if spikes is None:
        return out
    fired = spikes.where(F.col("s").isNotNull() & (F.abs("s") < float("inf"))).select("dataset").distinct()
    return out.unionByName(wide.select("dataset").distinct().join(fired, "dataset", "left_anti").select("dataset", none.alias("trial"), F.lit("note").alias("level"), F.lit("no_spikes").alias("code"), F.lit(None).cast("string").alias("detail")))


def inspected(wide: DataFrame, spikes: DataFrame, findings: DataFrame) -> DataFrame:
    """Per dataset: epochs, samples, median step, first and last finite time, value range, events, and the numbers of errors and warnings."""
    rows = wide.select("dataset", F.col("t").isNotNull().alias("ok"), _finite("t").alias("ft"), _finite("y").alias("fy"))
    per = rows.groupBy("dataset").agg(
        F.count_if(F.size("ft") > 0).alias("epochs"), F.sum(F.size("ft")).alias("samples"), F.min(F.array_min("ft")).alias("first_t"), F.max(F.array_max("ft")).alias("last_t"), F.min(F.array_min("fy")).alias("least"), F.max(F.array_max("fy")).alias("most")
    )
    steps = rows.select("dataset", F.explode(F.zip_with(F.slice("ft", 2, F.size("ft")), F.slice("ft", F.lit(1), F.greatest(F.size("ft") - 1, F.lit(0))), lambda b, a: b - a)).alias("d"))
    half = stats.quantiles(steps, ["dataset"], "d", [0.5]).select("dataset", F.col("q")[0].alias("dt"))
    told = findings.groupBy("dataset").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    out = per.join(half, "dataset", "left").join(spikes.groupBy("dataset").agg(F.count("*").alias("events")), "dataset", "left").join(told, "dataset", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("events", "errors", "warnings")})
