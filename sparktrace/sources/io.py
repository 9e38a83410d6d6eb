"""Readers and writers of score tables, run trees, posterior files and results."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktrace.operators import binning, reshape, series
from sparktrace.operators.reshape import finite
from sparktrace.sources.lines import BROADCAST_RANGES, numbered_lines

TRIALWISE = "run string, dataset string, smoothing string, method string, label string, corr_sigma_ms double, trial int, start_s double, end_s double, correlation double"
SUMMARY = (
    "dataset string, smoothing string, downsample_target string, resample_tag string, correlations map<string,double>, corr_sigma_ms double, methods_run array<string>, "
    "trialwise_correlations map<string,array<double>>, trial_windows_s array<array<double>>, gt_count bigint"
)
COMPARISON = (
    "run_tag string, dataset string, smoothing string, downsample_target string, "
    "methods array<struct<label:string,method:string,cache_tag:string,cache_key:string,config:map<string,string>,sampling_rate:double>>, artifacts map<string,string>"
)


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Just the columns; a missing one is an error."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(*columns)


def failing(bad: Column, message: str | Column, value: Column) -> Column:
    """`value`, or an error where `bad` holds."""
    return F.when(bad, F.raise_error(F.lit(message) if isinstance(message, str) else message)).otherwise(value)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """dataset, trial, t, y of a Parquet table of trials; a missing column or arrays of unequal length are errors."""
    rows = required(spark.read.parquet(path), ["dataset", "trial", "t", "y"])
    return rows.withColumn("y", failing(F.size("t") != F.size("y"), F.format_string("%s/%s: times and values differ in length", F.col("dataset").cast("string"), F.col("trial").cast("string")), F.col("y")))


def read_spikes(rows: DataFrame, epochs: DataFrame) -> DataFrame:
    """dataset, trial, s from `rows(dataset, ap array<array<double>>)` for the `epochs(dataset, n)` of each dataset.

    As many lists as epochs: one list an epoch. One list: the events of all epochs. Any other number: all lists joined, for all
    epochs. Values that are not finite are dropped.
    """
    both = rows.select("dataset", "ap").join(epochs, "dataset")
    own = F.transform("ap", lambda x, i: F.struct(i.alias("trial"), x.alias("s")))
    shared = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.struct(i.alias("trial"), F.flatten("ap").alias("s")))
    lists = both.where("n > 0").select("dataset", F.explode(F.when(F.size("ap") == F.col("n"), own).otherwise(shared)).alias("e"))
    return lists.select("dataset", F.col("e.trial").cast("long").alias("trial"), F.explode("e.s").alias("s")).where(finite("s"))


def read_windows(rows: DataFrame, column: str = "json") -> DataFrame:
    """dataset, trial, start_s, end_s of JSON objects dataset -> list of [start, end]; a pair of another length is an error."""
    parsed = rows.select(F.explode(F.from_json(column, "map<string,array<array<double>>>", {"mode": "FAILFAST"})).alias("dataset", "w")).select("dataset", F.posexplode("w").alias("trial", "w"))
    return parsed.select("dataset", F.col("trial").cast("long").alias("trial"), failing(F.size("w") != 2, F.concat(F.lit("not a start and an end: "), "dataset"), F.get("w", 0)).alias("start_s"), F.get("w", 1).alias("end_s"))


def read_predictions(rows: DataFrame, keys: list[str], time: str, prob: str, others: dict[str, str] | None = None) -> DataFrame:
    """Keys, trial, i, t, prob and one column for each of `others` (name -> column) from array columns that the caller names.

    `time` is one array, or one for each trial; `prob` and the others are one array, or one for each trial, of the same lengths. One
    time array serves all trials. Times that are not finite are dropped with their values; any other shape is an error.
    """
    others = {k: c for k, c in (others or {}).items() if c in rows.columns}
    deep = lambda c: rows.schema[c].dataType.simpleString().startswith("array<array<")
    if deep(time) and not all(deep(c) for c in (prob, *others.values())):
        raise ValueError("times of each trial need values of each trial")
    nested = lambda c: F.col(c) if deep(c) else F.array(c)
    many = next((c for c in (prob, *others.values()) if deep(c)), None)
    times = F.col(time) if deep(time) else F.array_repeat(F.col(time), F.size(F.col(many)).cast("int")) if many else F.array(time)
    columns = {"prob": nested(prob), **{k: nested(c) for k, c in others.items()}}
    each = rows.select(*keys, times.alias("_t"), *[c.alias(k) for k, c in columns.items()])
    zipped = each.select(*keys, F.posexplode(F.arrays_zip("_t", *columns)).alias("trial", "_p"))
    unequal = F.lit(False)
    for c in columns:
        unequal = unequal | F.coalesce(F.size(f"_p.{c}"), F.lit(-1)).eqNullSafe(F.coalesce(F.size("_p._t"), F.lit(-1))).__invert__()
    checked = zipped.withColumn("_t", failing(unequal, "times and values differ in shape", F.col("_p._t"))).select(*keys, "trial", F.arrays_zip("_t", *[F.col(f"_p.{c}").alias(c) for c in columns]).alias("_z"))
    points = checked.select(*keys, "trial", F.filter("_z", lambda z: finite(z["_t"])).alias("_z")).select(*keys, "trial", F.posexplode("_z").alias("i", "_z"))
    return points.select(*keys, F.col("trial").cast("long").alias("trial"), "i", F.col("_z._t").alias("t"), *[F.col(f"_z.{c}").alias(c) for c in columns])


def read_bundles(rows: DataFrame, bundle: str = "recordings") -> DataFrame:
    """dataset, trial, t, y, spikes_s, frame_rate of `rows(dataset, <bundle> array<struct<fluo_time, fluo_mean, events_AP>>)`.

    Events are in tenths of milliseconds; the frame rate is 1 / the mean step. Times and values of unequal length are an error.
    """
    each = rows.select("dataset", F.posexplode(bundle).alias("trial", "b"))
    steps = F.size("b.fluo_time") - 1
    rate = F.try_divide(steps, F.element_at("b.fluo_time", -1) - F.element_at("b.fluo_time", 1))
    return each.select(
        "dataset",
        F.col("trial").cast("long").alias("trial"),
        failing(F.size("b.fluo_time") != F.size("b.fluo_mean"), "times and values differ in length", F.col("b.fluo_time")).alias("t"),
        F.col("b.fluo_mean").alias("y"),
        F.transform(F.filter("b.events_AP", finite), lambda x: x / F.lit(1e4)).alias("spikes_s"),
        F.when(steps > 0, rate).alias("frame_rate"),
    )


def read_trial_selection(rows: DataFrame, column: str = "json") -> DataFrame:
    """dataset and trials (sorted, distinct) of JSON objects dataset -> list; other values and negative numbers are errors."""
    parsed = F.from_json(column, "map<string,array<int>>", {"mode": "FAILFAST"})
    out = rows.select(F.explode(parsed).alias("dataset", "trials"))
    bad = F.col("trials").isNull() | F.exists("trials", lambda x: x.isNull() | (x < 0))
    return out.select("dataset", F.when(bad, F.raise_error(F.concat(F.lit("invalid trials of "), "dataset"))).otherwise(F.array_sort(F.array_distinct("trials"))).alias("trials"))


def read_trialwise_csv(spark: SparkSession, path: str) -> DataFrame:
    """The ten columns of a score table; a missing column or a bad value is an error."""
    return spark.read.csv(path, header=True, schema=TRIALWISE, mode="FAILFAST", enforceSchema=False)


PLACE = "/([^/]+)/([^/]+)/([^/]+)/(summary|comparison).json$"


def run_files(spark: SparkSession, root: str, runs: list[str] | None = None, datasets: list[str] | None = None, smoothings: list[str] | None = None) -> DataFrame:
    """run, dataset, smoothing and the texts `summary` and `comparison` (null without one) of all `run/dataset/smoothing/` folders below a root."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{summary,comparison}.json").text(root, wholetext=True)
    part = lambda g: F.regexp_extract(F.col("_metadata.file_path"), PLACE, g)
    rows = files.select(part(1).alias("run"), part(2).alias("dataset"), part(3).alias("smoothing"), part(4).alias("kind"), "value")
    for column, wanted in (("run", runs), ("dataset", datasets), ("smoothing", smoothings)):
        rows = rows.where(F.col(column).isin(wanted)) if wanted is not None else rows
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value"))).alias(kind)
    return rows.groupBy("run", "dataset", "smoothing").agg(one("summary"), one("comparison"))


def read_run_tree(spark: SparkSession, root: str, runs: list[str] | None = None, datasets: list[str] | None = None, smoothings: list[str] | None = None, methods: list[str] | None = None, on_missing: str = "skip") -> DataFrame:
    """run, dataset, smoothing, method, correlation, manifest of all `run/dataset/smoothing/` folders below a root.

    Correlations are those of `summary.json`; with `methods` just these, null where a summary lacks one. `manifest` is the text of
    `comparison.json`, null without one. A folder with a comparison but no summary is left out (skip) or an error (raise).
    """
    rows = run_files(spark, root, runs, datasets, smoothings)
    if on_missing == "raise":
        rows = rows.withColumn("summary", failing(F.col("summary").isNull(), F.concat_ws("/", F.lit("no summary in"), "run", "dataset", "smoothing"), F.col("summary")))
    found = rows.where("summary is not null").withColumn("c", F.from_json("summary", SUMMARY, {"mode": "FAILFAST"})["correlations"])
    if methods is not None:
        found = found.withColumn("c", F.map_from_entries(F.array(*[F.struct(F.lit(m), F.try_element_at("c", F.lit(m))) for m in methods])))
    return found.select("run", "dataset", "smoothing", F.explode("c").alias("method", "correlation"), F.col("comparison").alias("manifest"))


def read_run_documents(spark: SparkSession, root: str) -> DataFrame:
    """run, dataset, smoothing, the struct `summary` with its text `summary_json`, and the struct `comparison` of every folder of a run tree."""
    rows = run_files(spark, root).withColumnsRenamed({"summary": "summary_json", "comparison": "comparison_json"})
    parsed = lambda c, schema: F.from_json(c, schema, {"mode": "FAILFAST"})
    return rows.select("run", "dataset", "smoothing", parsed("summary_json", SUMMARY).alias("summary"), "summary_json", parsed("comparison_json", COMPARISON).alias("comparison"))


def correlation_rows(documents: DataFrame) -> DataFrame:
    """run, dataset, smoothing, corr_sigma_ms, method, correlation: a row for each method of the summaries' correlation maps."""
    return documents.select("run", "dataset", "smoothing", "summary.corr_sigma_ms", F.explode("summary.correlations").alias("method", "correlation"))


def method_rows(documents: DataFrame) -> DataFrame:
    """run, dataset, smoothing, place, label, method, cache_tag, cache_key, config, sampling_rate: the entries of the comparisons' method lists."""
    each = documents.select("run", "dataset", "smoothing", F.posexplode("comparison.methods").alias("place", "m"))
    return each.select("run", "dataset", "smoothing", F.col("place").cast("long").alias("place"), "m.*")


def trialwise_rows(documents: DataFrame) -> DataFrame:
    """run, dataset, smoothing, method, place, correlation, start_s, end_s: the summaries' correlations by trial beside the trials' windows."""
    each = documents.select("run", "dataset", "smoothing", "summary.trial_windows_s", F.explode("summary.trialwise_correlations").alias("method", "values"))
    each = each.select("run", "dataset", "smoothing", "trial_windows_s", "method", F.posexplode("values").alias("place", "correlation"))
    window = F.get("trial_windows_s", F.col("place"))
    return each.select("run", "dataset", "smoothing", "method", F.col("place").cast("long").alias("place"), "correlation", F.get(window, 0).alias("start_s"), F.get(window, 1).alias("end_s"))


def run_documents(scores: DataFrame, methods: DataFrame, counts: DataFrame, trialwise: DataFrame | None = None, windows: DataFrame | None = None) -> DataFrame:
    """One document for each run, dataset and smoothing of `counts`: the texts `summary` and `comparison`.

    scores(run, dataset, smoothing, method, correlation); methods(run, dataset, smoothing, label, method, cache_tag, cache_key, config map,
    sampling_rate, samples, details map) in the order of their labels; counts(run, dataset, smoothing, downsample_target, corr_sigma_ms, gt_count);
    trialwise(run, dataset, smoothing, method, trial, correlation) and windows(run, dataset, smoothing, trial, start_s, end_s), in the order of trials. A
    summary has the entries <label>_cache, <label>_samples and <label>_<detail> of each method. Correlations that are null or NaN are null.
    """
    by = ["run", "dataset", "smoothing"]
    value = F.nanvl(F.col("correlation"), F.lit(None).cast("double"))
    named = lambda rows: F.map_from_entries(F.sort_array(F.collect_list(rows)))
    a = scores.groupBy(*by).agg(named(F.struct("method", value.alias("v"))).alias("correlations"))
    each = F.struct("label", "method", "cache_tag", "cache_key", "config", "sampling_rate")
    # One member of an object: the name as JSON writes it, and its value.
    member = lambda name, json: F.concat(F.regexp_replace(F.to_json(F.create_map(name, F.lit(0))), r"^\{|0\}$", ""), json)
    own = F.concat(
        F.array(member(F.concat("label", F.lit("_cache")), F.coalesce(F.to_json("config"), F.lit("{}"))), member(F.concat("label", F.lit("_samples")), F.coalesce(F.col("samples").cast("string"), F.lit("null")))),
        F.transform(F.coalesce(F.array_sort(F.map_entries("details")), F.array().cast("array<struct<key:string,value:string>>")), lambda e: member(F.concat("label", F.lit("_"), e["key"]), F.regexp_replace(F.to_json(F.array(e["value"])), r"^\[|\]$", ""))),
    )
    before = lambda x, y: F.when(x["label"] < y["label"], -1).when(x["label"] > y["label"], 1).otherwise(0)
    b = methods.withColumn("own", own).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("label", each.alias("m"), "own")), before).alias("ms"))
    b = b.select(*by, F.col("ms.m").alias("methods"), F.col("ms.label").alias("methods_run"), F.flatten("ms.own").alias("own"))
    rows = counts.join(a, by, "left").join(b, by, "left")
    beside = {}
    if trialwise is not None:
        series_ = trialwise.groupBy(*by, "method").agg(F.transform(F.sort_array(F.collect_list(F.struct("trial", value.alias("v")))), lambda p: p["v"]).alias("v"))
        rows = rows.join(series_.groupBy(*by).agg(named(F.struct("method", "v")).alias("trialwise_correlations")), by, "left")
        beside["trialwise_correlations"] = F.col("trialwise_correlations")
    if windows is not None:
        pairs = windows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("trial", "start_s", "end_s"))), lambda w: F.array(w["start_s"], w["end_s"])).alias("trial_windows_s"))
        rows = rows.join(pairs, by, "left")
        beside["trial_windows_s"] = F.col("trial_windows_s")
    text_ = lambda c: F.col(c).cast("string").alias(c)
    none = F.array().cast("array<string>")
    head = F.struct(
        text_("dataset"), text_("smoothing"), F.coalesce(F.col("downsample_target").cast("string"), F.col("smoothing").cast("string")).alias("downsample_target"), F.col("run").cast("string").alias("resample_tag"),
        F.coalesce("correlations", F.create_map().cast("map<string,double>")).alias("correlations"), "corr_sigma_ms", F.coalesce("methods_run", none).alias("methods_run"), *[c.alias(k) for k, c in beside.items()], F.coalesce("gt_count", F.lit(0)).alias("gt_count"),
    )
    place = F.concat_ws("/", *[F.col(c).cast("string") for c in by])
    summary = F.concat_ws(",", F.regexp_replace(F.to_json(head), r"\}$", ""), F.coalesce("own", none))
    comparison = F.to_json(F.struct(
        F.col("run").cast("string").alias("run_tag"), text_("dataset"), text_("smoothing"), F.coalesce(F.col("downsample_target").cast("string"), F.col("smoothing").cast("string")).alias("downsample_target"),
        F.coalesce("methods", F.array().cast("array<struct<label:string,method:string,cache_tag:string,cache_key:string,config:map<string,string>,sampling_rate:double>>")).alias("methods"), F.create_map(F.lit("summary"), F.concat(place, F.lit("/summary.json"))).alias("artifacts"),
    ))
    return rows.select(*by, F.concat(summary, F.lit("}")).alias("summary"), comparison.alias("comparison"))


def write_run_documents(documents: DataFrame, root: str) -> None:
    """Writes the texts of `run_documents` below a root; a run that is written again replaces each of its documents whole.

    Files are moved into place when they are complete, the comparison after the summary, so a reader never meets half a document.
    """
    place = F.concat_ws("/", *[F.col(c).cast("string") for c in ("run", "dataset", "smoothing")])
    files = documents.select(F.explode(F.array(*[F.struct(F.concat(place, F.lit(f"/{kind}.json")).alias("path"), F.col(kind).alias("text")) for kind in ("summary", "comparison")])).alias("f")).select("f.*")
    write_texts(files, root)


def read_posterior(spark: SparkSession, path: str, bins: int | None = None, logp: bool = False) -> DataFrame:
    """Trajectory files `traj_samples_<tag>_trial<n>.dat` as rows; the bin is the row's place inside its sample.

    A sample has `bins` bins, or as many as the first one (index 0) has rows; none, or a row count that they do not divide, is an error.
    With `logp` the files `logp_<tag>_trial<n>.dat` are read too: their values stand beside the samples, and samples beyond
    the shorter of both are left out; an empty or missing file is an error. Large files are read in ranges, lines keep their place
    by their number in a file; a row carries its own line only. The files are read once, into a Parquet table.
    """
    place = lambda g: F.regexp_extract("path", "/(traj_samples|logp)_(.+)_trial([0-9]+).dat$", g)
    read = numbered_lines(spark, path, "{traj_samples,logp}_*.dat" if logp else "traj_samples_*.dat", {"kind": place(1), "tag": place(2), "trial": place(3).cast("int")})
    read.write.parquet(table := shared_path(spark, "lines"))
    stored = spark.read.schema("kind string, tag string, trial int, number long, value string").parquet(table)

    def lines(kind: str, header: int) -> DataFrame:
        rows = stored.where((F.col("kind") == kind) & (F.col("number") >= header))
        return rows.select("tag", "trial", (F.col("number") - header).alias("k"), "value")

    file = ["tag", "trial"]
    rows = lines("traj_samples", 1)
    first = F.count_if(F.split_part("value", F.lit(","), F.lit(1)).cast("double") == 0)
    sizes = rows.groupBy(*file).agg(F.count("*").alias("lines"), (F.lit(bins).cast("long") if bins is not None else first).alias("bins"))
    sizes = sizes.withColumn("bins", failing(F.col("bins") == 0, F.concat(F.lit("no rows of sample 0: "), "tag"), F.col("bins")))
    sizes = sizes.withColumn("samples", failing(F.col("lines") % F.col("bins") != 0, F.concat(F.lit("rows are no multiple of the bins: "), "tag"), F.floor(F.col("lines") / F.col("bins"))))
    if logp:
        beside = lines("logp", 0)
        sizes = sizes.join(beside.groupBy(*file).agg(F.count("*").alias("logs")), file, "left")
        sizes = sizes.withColumn("samples", failing(F.col("logs").isNull(), F.concat(F.lit("no log-probabilities: "), "tag"), F.least("samples", "logs")))
    # A row for each file; stored, so that their number is known. The larger side, the lines, is never broadcast or sorted.
    sizes.write.parquet(table := shared_path(spark, "sizes"))
    sizes = spark.read.schema("tag string, trial int, lines long, bins long, samples long" + ", logs long" * logp).parquet(table)
    files, logs = sizes.agg(F.count("*"), F.sum("logs") if logp else F.lit(0)).first()
    beside_lines = lambda small, n: F.broadcast(small) if n <= BROADCAST_RANGES else small.hint("shuffle_hash")
    kept = rows.join(beside_lines(sizes.select(*file, "bins", "samples"), files), file).withColumn("sample", F.floor(F.col("k") / F.col("bins"))).where("sample < samples")
    if logp:
        values = beside.select(*file, F.col("k").alias("sample"), F.trim("value").cast("double").alias("logp"))
        kept = kept.join(beside_lines(values, logs or 0), [*file, "sample"])
    kept = kept.withColumn("v", F.split("value", ",").cast("array<double>"))
    at = lambda i, kind: F.get("v", i).cast(kind)
    return kept.select(
        "tag", "trial", F.col("sample").cast("int").alias("sample"), (F.col("k") % F.col("bins")).cast("int").alias("bin"),
        at(1, "int").alias("burst"), at(2, "double").alias("b"), at(3, "int").alias("s"), at(4, "double").alias("c"), at(5, "double").alias("y"), *(["logp"] if logp else []),
    )


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Parameter samples of CSV files with a header, as (file, sample, name, value). Samples are the lines of a file in order; files are
    read in ranges."""
    rows = numbered_lines(spark, path)
    names = rows.where("number = 0").select("path", F.transform(F.split("value", ","), lambda c: F.trim(c)).alias("names"))
    pairs = F.arrays_zip(F.col("names").alias("name"), F.transform(F.split("value", ","), lambda c: F.trim(c).cast("double")).alias("value"))
    both = rows.where("number > 0").join(names, "path")
    return both.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), (F.col("number") - 1).alias("sample"), F.inline(pairs))


def equal_headers(left: DataFrame, right: DataFrame) -> bool:
    """Whether two sets of parameter samples have the same names; they must before chains are compared."""
    names = [x.select("name").distinct() for x in (left, right)]
    return names[0].exceptAll(names[1]).isEmpty() and names[1].exceptAll(names[0]).isEmpty()


def write_results(predictions: DataFrame, path: str) -> None:
    """Predictions by method and dataset; a partition that is written again is replaced, others stay."""
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "dataset").parquet(path)


def write_texts(rows: DataFrame, root: str) -> None:
    """Writes `text` of `rows(path, text)` to the file `path` below a root, in tasks; a task that runs again replaces its files."""

    def run(frames):
        for f in frames:
            store, at = pafs.FileSystem.from_uri(root)
            for folder in {f"{at}/{path}".rpartition("/")[0] for path in f["path"]}:
                store.create_dir(folder, recursive=True)
            for path, text in zip(f["path"], f["text"]):
                folder, _, name = f"{at}/{path}".rpartition("/")
                draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(draft, compression=None) as out:
                    out.write(text.encode())
                store.move(draft, f"{folder}/{name}")
            yield f[["path"]]

    rows.select("path", "text").mapInPandas(run, "path string").count()


def write_summary(scores: DataFrame, path: str) -> None:
    """`scores(run, dataset, smoothing, method, correlation)` as `<path>/json`, an object of correlations by method for each run, dataset and
    smoothing, and as `<path>/csv`, a line for each score."""
    by = ["run", "dataset", "smoothing"]
    methods = F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "correlation"))))
    scores.groupBy(*by).agg(methods.alias("correlations")).write.mode("overwrite").json(f"{path}/json")
    scores.select(*by, "method", "correlation").write.mode("overwrite").csv(f"{path}/csv", header=True)


def export_downsampled(samples: DataFrame, spikes: DataFrame, fs: float, path: str) -> None:
    """Trials at `fs` as one row each: dataset, trial, valid_length, t, y (padded with nulls to the dataset's longest) and counts, the
    events in half a step before to half a step after each time."""
    low = series.resample_to(samples, fs).withColumnRenamed("k", "i")
    n = binning.frame_histogram(low, spikes, 1.0 / fs)
    wide = low.join(n, ["dataset", "trial", "i"]).groupBy("dataset", "trial").agg(F.sort_array(F.collect_list(F.struct("i", "t", "y", "n"))).alias("a"))
    wide = wide.select("dataset", "trial", F.col("a.t").alias("t"), F.col("a.y").alias("y"), F.col("a.n").alias("counts"))
    padded = reshape.pad_trials(wide.select("dataset", "trial", "t", "y"))
    padded.join(wide.select("dataset", "trial", "counts"), ["dataset", "trial"]).write.mode("overwrite").partitionBy("dataset").parquet(path)


def trace_hashes(samples: DataFrame) -> DataFrame:
    """SHA-256 over the float64 times, then the float32 values, of each trial in time order."""

    def run(frames):
        for f in frames:
            f["hash"] = [hashlib.sha256(np.asarray(t, dtype="<f8").tobytes() + np.asarray(y, dtype="<f4").tobytes()).hexdigest() for t, y in zip(f["t"], f["y"])]
            yield f[["dataset", "trial", "hash"]]

    packed = samples.groupBy("dataset", "trial").agg(F.sort_array(F.collect_list(F.struct("i", "t", "y"))).alias("a")).select("dataset", "trial", F.col("a.t").alias("t"), F.col("a.y").alias("y"))
    kinds = dict(samples.dtypes)
    return packed.mapInPandas(run, f"dataset {kinds['dataset']}, trial {kinds['trial']}, hash string")


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's content, and of its folder's sorted (name, size, time of change) list."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", F.unix_micros("modificationTime").alias("changed"), F.sha2("content", 256).alias("hash"))
    entry = F.concat_ws(":", "name", F.col("length").cast("string"), F.col("changed").cast("string"))
    listed = files.groupBy("folder").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ","), 256).alias("folder_hash"))
    return files.join(listed, "folder")


def append_manifest(entries: DataFrame, new: DataFrame, stamp) -> DataFrame:
    """Synthetic entries are appended; of training entries of a model the newest stays. `stamp`: time of the new rows."""
    both = entries.unionByName(new.withColumn("updated", stamp))
    r = F.row_number().over(W.partitionBy("model", "kind").orderBy(F.desc("updated")))
    return both.withColumn("r", r).where("kind = 'synthetic' or r = 1").drop("r")


@cache
def own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sparktrace-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of `spark.checkpoint.dir`; where that is unset a local master gets a temporary folder, any other an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = own_folder()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
