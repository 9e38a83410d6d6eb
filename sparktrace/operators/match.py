"""As-of, interval and lookup joins."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktrace.functions import text

TRIAL = ("dataset", "trial")


def neighbours(samples: DataFrame, points: DataFrame, at: str, carry: list[str], strict: bool = True, by: tuple[str, ...] = TRIAL) -> DataFrame:
    """Each point of `points(*by, <at>, ...)` with the samples before and after it, as structs `prev` and `next`.

    One sorted pass per trial over the union of both sides. `strict`: before means t < point, else t <= point.
    """
    sample = F.struct(F.col("t"), *carry)
    side = F.lit(0 if strict else 1)
    own = points.columns
    left = samples.select(*by, F.col("t").alias("_at"), (1 - side).alias("_side"), sample.alias("_sample"), F.lit(None).cast(points.select(F.struct(*own)).schema[0].dataType).alias("_point"))
    right = points.select(*by, F.col(at).alias("_at"), side.alias("_side"), F.lit(None).cast(left.schema["_sample"].dataType).alias("_sample"), F.struct(*own).alias("_point"))
    both = left.unionByName(right)
    w = W.partitionBy(*by).orderBy("_at", "_side")
    before = F.last("_sample", True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("_sample", True).over(w.rowsBetween(0, W.unboundedFollowing))
    return both.withColumn("prev", before).withColumn("next", after).where("_point is not null").select("_point.*", "prev", "next")


def assign_spikes(samples: DataFrame, spikes: DataFrame) -> DataFrame:
    """Number of events of each sample: an event belongs to the last sample with t < s, inside the trial's time range."""
    hit = neighbours(samples, spikes, "s", ["i"]).where("prev is not null and (next is not null)").groupBy(*TRIAL, F.col("prev.i").alias("i")).count()
    return samples.select(*TRIAL, "i").join(hit, [*TRIAL, "i"], "left").select(*TRIAL, "i", F.coalesce("count", F.lit(0)).alias("n"))


def low_activity_mask(samples: DataFrame, spikes: DataFrame, exclusion: float) -> DataFrame:
    """Whether each sample is at least `exclusion` from the nearest event; true without events or exclusion."""
    points = samples.select(*TRIAL, "i", F.col("t").alias("q"))
    near = neighbours(spikes.withColumnRenamed("s", "t"), points, "q", [], strict=False)
    gap = F.least(F.col("q") - F.col("prev.t"), F.col("next.t") - F.col("q"))
    return near.select(*TRIAL, "i", (F.coalesce(gap >= exclusion, F.lit(True)) | F.lit(exclusion <= 0)).alias("low"))


def segments_of_windows(a: np.ndarray, z: np.ndarray, seg: np.ndarray, start: np.ndarray, end: np.ndarray, k: np.ndarray, touching: bool) -> list:
    """The segment of each window of a trial, None without one. Segments [a, z] are in order and do not overlap."""
    even, place, out = len(seg) == len(k), {s: i for i, s in enumerate(seg.tolist())}, []
    first, stop = np.searchsorted(z, start, side="right"), np.searchsorted(a, end, side="left")
    for w in range(len(k)):
        own = place.get(int(k[w])) if even else None
        if own is not None and (not touching or (z[own] >= start[w] and a[own] <= end[w])):
            out.append(int(seg[own]))
            continue
        met = slice(first[w], stop[w])
        overlap = np.minimum(z[met], end[w]) - np.maximum(a[met], start[w])
        best = int(overlap.argmax()) if len(overlap) and (touching or not even) else None
        out.append(int(seg[met][best]) if best is not None and overlap[best] > 0 else None)
    return out


def match_segment(segments: DataFrame, windows: DataFrame, by: tuple[str, ...] = TRIAL, touching: bool = False) -> DataFrame:
    """For each window(k, start_s, end_s) of a trial the segment(seg, seg_start, seg_end): the one of its place if
    there are as many, else the one with the greatest overlap, the first of equals; none without overlap.

    `touching`: the one of its place must touch the window, else the greatest overlap decides. The segments of a trial, which do not overlap, and
    its windows meet in one row as sorted arrays; a window looks only at the segments that it overlaps, found by bisection.
    """

    @F.pandas_udf("array<long>")
    def pick(a: pd.Series, z: pd.Series, seg: pd.Series, start: pd.Series, end: pd.Series, k: pd.Series) -> pd.Series:
        number = lambda v: np.asarray(v, dtype=float)
        return pd.Series([segments_of_windows(number(r[0]), number(r[1]), np.asarray(r[2]), number(r[3]), number(r[4]), np.asarray(r[5]), touching) for r in zip(a, z, seg, start, end, k)])

    packed = segments.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("seg_start").alias("a"), F.col("seg_end").alias("z"), F.col("seg").cast("long").alias("seg")))).alias("s"))
    wins = windows.groupBy(*by).agg(F.collect_list(F.struct("k", "start_s", "end_s")).alias("w"))
    both = wins.join(packed, list(by), "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<double>" if c != "s.seg" else "array<long>"))
    found = both.select(*by, "w", pick(none("s.a"), none("s.z"), none("s.seg"), F.col("w.start_s"), F.col("w.end_s"), F.transform("w", lambda x: x["k"].cast("long"))).alias("seg"))
    return found.select(*by, F.explode(F.arrays_zip(F.col("w.k").alias("k"), F.col("seg").alias("seg"))).alias("p")).select(*by, "p.k", F.col("p.seg").cast(segments.schema["seg"].dataType).alias("seg"))


def snap_windows(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Window bounds moved to the nearest sample time, the earlier of equals."""
    ends = windows.select(*TRIAL, F.explode(F.array(F.struct(F.lit("a").alias("e"), F.col("start_s").alias("x")), F.struct(F.lit("z").alias("e"), F.col("end_s").alias("x")))).alias("p")).select(*TRIAL, "p.e", "p.x").where("x is not null")
    near = neighbours(samples, ends, "x", [], strict=False)
    t = F.when(F.col("next.t").isNull() | (F.col("x") - F.col("prev.t") <= F.col("next.t") - F.col("x")), F.col("prev.t")).otherwise(F.col("next.t"))
    return near.groupBy(*TRIAL).agg(F.max(F.when(F.col("e") == "a", t)).alias("start_s"), F.max(F.when(F.col("e") == "z", t)).alias("end_s"))


def missing_windows(trials: DataFrame, windows: DataFrame) -> DataFrame:
    """Trials without a finite window."""
    return trials.join(windows.where("start_s is not null and end_s is not null"), list(TRIAL), "left_anti")


def parse_series(specs: DataFrame, column: str = "spec") -> DataFrame:
    """key, method, run of texts `method`, `method@run` or `key=method@run`; blanks drop out, an empty method or run is an error."""
    rows = specs.select(F.trim(column).alias("_s")).where("_s <> ''")
    named = F.contains(F.col("_s"), F.lit("="))
    rest = F.trim(F.when(named, F.regexp_replace("_s", "^[^=]*=", "")).otherwise(F.col("_s")))
    method, run = F.trim(F.split_part(rest, F.lit("@"), F.lit(1))), F.when(F.contains(rest, F.lit("@")), F.trim(F.regexp_replace(rest, "^[^@]*@", "")))
    rows = rows.select("_s", F.when(named, F.trim(F.split_part("_s", F.lit("="), F.lit(1)))).alias("key"), method.alias("method"), run.alias("run"))
    bad = F.when(F.col("method") == "", F.lit("empty method")).when(F.col("run") == "", F.lit("empty run"))
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("invalid series, "), bad, F.lit(": "), F.col("_s")))).otherwise(F.col("method"))
    return rows.select(F.coalesce(F.nullif("key", F.lit("")), F.concat_ws("@", "method", "run")).alias("key"), checked.alias("method"), "run")


def resolve_series(entries: DataFrame, specs: DataFrame) -> DataFrame:
    """Series key of each entry(method, run): the spec of (method, run), else the method's spec without a run.

    A key that is repeated, or a method and run that two specs have, is an error.
    """
    once = lambda c, by, what: F.when(F.count("*").over(W.partitionBy(*by)) > 1, F.raise_error(F.concat(F.lit(f"repeated {what}: "), F.col("key")))).otherwise(F.col(c))
    specs = specs.withColumn("method", once("method", ["key"], "key")).withColumn("key", once("key", ["method", "run"], "method and run"))
    exact = specs.where("run is not null").select("method", "run", F.col("key").alias("exact"))
    wild = specs.where("run is null").select("method", F.col("key").alias("wild"))
    return entries.join(exact, ["method", "run"], "left").join(wild, "method", "left").withColumn("key", F.coalesce("exact", "wild")).where("key is not null").drop("exact", "wild")


def common_trials(scores: DataFrame, by: list[str], series: Column, n: int) -> DataFrame:
    """Groups that all `n` series have."""
    return scores.groupBy(*by).agg(F.countDistinct(series).alias("k")).where(F.col("k") == n).drop("k")


#: Noise levels that are broadcast at most.
LEVELS = 100_000


def route_by_noise(traces: DataFrame, models: DataFrame) -> DataFrame:
    """Model bucket of each trace's noise: [m - 0.5, m + 0.5), open-ended at the lowest and highest; null noise goes nowhere.

    Levels and traces meet by whole numbers that a bucket touches, the open ends at those of the lowest and highest level.
    """
    w = W.partitionBy("model").orderBy("noise_level")
    lo, hi = F.col("noise_level") - 0.5, F.col("noise_level") + 0.5
    lowest, highest = F.lag("noise_level").over(w).isNull(), F.lead("noise_level").over(w).isNull()
    bands = models.select("model", "noise_level", F.when(lowest, float("-inf")).otherwise(lo).alias("lo"), F.when(highest, float("inf")).otherwise(hi).alias("hi"), F.floor(lo).alias("a"), F.floor(hi).alias("z"))
    reach = bands.agg(F.min("a").alias("first"), F.max("z").alias("last"))
    whole = lambda a, z: F.explode(F.sequence(a, z)).alias("cell")
    # An open end reaches all cells on its side, of which those within reach of any level are looked up.
    cells = bands.crossJoin(F.broadcast(reach)).select("model", "noise_level", "lo", "hi", whole(F.when(F.col("lo") == float("-inf"), F.col("first")).otherwise(F.col("a")), F.when(F.col("hi") == float("inf"), F.col("last")).otherwise(F.col("z"))))
    at = F.least(F.greatest(F.floor("noise"), F.col("first")), F.col("last"))
    known = traces.where(F.col("noise").isNotNull() & ~F.isnan("noise")).crossJoin(F.broadcast(reach)).withColumn("cell", at).drop("first", "last")
    small = models.count() <= LEVELS
    return known.join(F.broadcast(cells) if small else cells, "cell").where((F.col("noise") >= F.col("lo")) & (F.col("noise") < F.col("hi"))).drop("lo", "hi", "cell")


def resolve_cached(entries: DataFrame, results: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Results(tag, key, ...) of manifest entries(dataset, method, label, cache_tag, cache_key, config map); nulls where there is none.

    The tag 'None' or '' means the dataset; without a key the config's signature is one. `methods` keeps entries whose method or
    label is among them. `unresolved` lists what stayed without a result.
    """
    if methods is not None:
        entries = entries.where(F.col("method").isin(methods) | F.col("label").isin(methods))
    tag = F.coalesce(F.nullif(F.nullif("cache_tag", F.lit("None")), F.lit("")), F.col("dataset").cast("string"))
    want = entries.withColumn("tag", tag).withColumn("key", F.coalesce(F.nullif("cache_key", F.lit("")), text.config_signature(F.col("config"))))
    return want.join(results.withColumn("resolved", F.lit(True)), ["tag", "key"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def unresolved(resolved: DataFrame) -> DataFrame:
    """The dataset, method, tag and key of entries without a result."""
    return resolved.where(~F.col("resolved")).select("dataset", "method", "tag", "key")


def lookup_result(requests: DataFrame, store: DataFrame, any_trace: bool = False) -> DataFrame:
    """Stored result for each request(id, method, dataset, key, trace_hash): the first file of those that fit.

    Only the folder of the request's method and dataset is searched. A row of it, store(method, folder, key, config, dataset, cache_tag, trace_hash,
    file, ...), fits if its key is the request's, or, of rows without a key, the signature of its config is; if its dataset is the
    request's or its own cache tag; and if the trace hashes are equal, unless `any_trace`. The file named like the key comes first and, if it is
    there, alone.
    """
    rest = [c for c in store.columns if c not in ("method", "folder", "key", "config", "dataset", "cache_tag", "trace_hash")]
    own = store.withColumn("found_key", F.coalesce("key", text.config_signature(F.col("config")))).withColumn("named", F.regexp_replace(F.regexp_replace("file", "^.*/", ""), "[.][^.]*$", ""))
    exact = own.select("method", F.col("folder").alias("dataset"), F.col("named").alias("key"), F.lit(True).alias("alone")).distinct()
    fits = (F.col("dataset") == F.col("folder")) | F.coalesce(F.col("dataset") == F.col("cache_tag"), F.lit(False))
    by = ["method", "dataset", "key"] if any_trace else ["method", "dataset", "key", "trace_hash"]
    usable = own.where(fits).select("method", F.col("folder").alias("dataset"), F.col("found_key").alias("key"), "trace_hash", F.struct(*rest).alias("r"), "file", "named")
    first = usable.groupBy(*by).agg(F.min_by("r", "file").alias("any"), F.min_by("r", F.when(F.col("named") == F.col("key"), F.col("file"))).alias("own"))
    both = requests.join(exact, ["method", "dataset", "key"], "left").join(first, by)
    return both.withColumn("best", F.when(F.col("alone"), F.col("own")).otherwise(F.col("any"))).where("best is not null").select(*requests.columns, *[F.col(f"best.{c}").alias(c) for c in rest])


def match_overlay(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """Best offer of the run for each wanted(id, run, label, tag, trial, epoch): equal label, else equal (tag, trial, epoch), else equal epoch.

    Of several equal labels or places the first by `display` is taken, and of several epochs. `epoch` is the entry's own or null; a null one is that
    of the tag when epochs are compared. offered(run, label, tag, trial, epoch, display). Gives id, match (its display), how (0, 1 or 2).
    """
    shown = F.coalesce(F.nullif("display", F.lit("")), F.col("tag"))
    known = lambda rows: rows.withColumn("_epoch", F.coalesce(F.nullif("epoch", F.lit("")), text.tag_epoch(F.col("tag")))).withColumn("_own", F.coalesce("epoch", F.lit("")))
    offers, both = known(offered).withColumn("_shown", shown), known(wanted)
    for k, by in enumerate((["run", "label"], ["run", "tag", "trial", "_own"], ["run", "_epoch"])):
        keys = [c if c != "trial" else "_trial" for c in by]
        # Trials that neither side names are equal, as any two equal numbers are.
        at = lambda rows: rows.withColumn("_trial", F.coalesce(F.col("trial").cast("long"), F.lit(-1)))
        both = at(both).join(at(offers).groupBy(*keys).agg(F.min("_shown").alias(f"_{k}")), keys, "left")
    how = F.when(F.col("_0").isNotNull(), 0).when(F.col("_1").isNotNull(), 1).otherwise(2)
    return both.withColumn("match", F.coalesce("_0", "_1", "_2")).where("match is not null").select("id", "match", how.alias("how"))


def infer_known(files: DataFrame, known: DataFrame, pattern: str) -> DataFrame:
    """Dataset of each of `files(name)`: its stem if that is among `known(dataset)`, else what the pattern finds if that is, else the stem."""
    names = known.select("dataset").distinct()
    stem = F.regexp_replace(F.regexp_replace("name", "^.*/", ""), "\\.[^.]*$", "")
    rows = files.withColumn("stem", stem).withColumn("found", F.regexp_extract(F.regexp_replace("name", "^.*/", ""), pattern, 1))
    rows = rows.join(names.select(F.col("dataset").alias("stem"), F.lit(True).alias("known")), "stem", "left").join(names.select(F.col("dataset").alias("found"), F.lit(True).alias("other")), "found", "left")
    return rows.withColumn("dataset", F.when(F.col("known").isNull() & F.col("other"), F.col("found")).otherwise(F.col("stem"))).drop("stem", "found", "known", "other")


def epoch_catalogue(wide: DataFrame, spikes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each readable trial(dataset, trial, t, y): its number and the dataset's count of them, id, display text and whether it has
    events; and the trials that are not readable (no times, or not as many values), with the reason."""
    reason = F.when(F.col("t").isNull() | F.col("y").isNull(), "no arrays").when(F.size("t") == 0, "no samples").when(F.size("t") != F.size("y"), "times and values differ in length")
    rows = wide.withColumn("reason", reason)
    good = rows.where("reason is null").select(*TRIAL)
    good = good.withColumn("epochs", F.count("*").over(W.partitionBy("dataset"))).join(spikes.select(*TRIAL).distinct().withColumn("has_spikes", F.lit(True)), list(TRIAL), "left")
    name = F.format_string("%s_epoch%d", F.col("dataset").cast("string"), F.col("trial") + 1)
    shown = F.format_string("%s (epoch %d of %d)", F.col("dataset").cast("string"), F.col("trial") + 1, F.col("epochs"))
    out = good.select(*TRIAL, "epochs", name.alias("epoch_id"), shown.alias("display"), F.coalesce("has_spikes", F.lit(False)).alias("has_spikes"))
    return out, rows.where("reason is not null").select(*TRIAL, "reason")


def align_components(a: DataFrame, b: DataFrame, keys: list[str], time: str | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Rows of two series at equal places, up to the shorter. Where both have a column `time` its values must agree."""
    if time is None:
        return a.join(b, keys)
    both = a.join(b.withColumnRenamed(time, "_time"), keys)
    differs = F.abs(F.col(time) - F.col("_time")) > tolerance
    return both.withColumn(time, F.when(differs, F.raise_error(F.lit("the components differ in time"))).otherwise(F.col(time))).drop("_time")


def sweep_grid(rates: DataFrame, smooths: DataFrame, duties: DataFrame, cells: DataFrame, first_seed: int, stride: int) -> DataFrame:
    """All combinations of three small parameter lists for all cells, with a seed each."""
    order = W.orderBy("rate", "smooth", "duty")
    combos = rates.crossJoin(smooths).crossJoin(duties).withColumn("combo", F.row_number().over(order) - 1)
    return combos.crossJoin(cells).withColumn("seed", F.lit(first_seed) + F.col("combo") * stride + F.col("cell"))


def parameter_specs(rates: list[float], smooths: list[float], duties: list[float], sets: DataFrame, run: str, first_seed: int = 0, stride: int = 1000, noise_fraction: float | None = None, prefix: str = "bio_ml") -> DataFrame:
    """One row for each combination of the lists, in their order, and each of the parameter `sets(place, name)`: combo, combo_id, rate, smooth, duty,
    seed_base, place, tag, noise_seed, noise_fraction.

    The seed base is first_seed + combo * stride, a set's noise seed its place beyond that; the noise fraction is 1 / K for K sets unless given. Empty lists
    and no sets are errors. Only the lists, which the caller holds, are combined on the driver.
    """
    if not (rates and smooths and duties):
        raise ValueError("the lists of a sweep cannot be empty")
    spark = sets.sparkSession
    combos = [(k, float(r), float(s), float(d)) for k, (r, s, d) in enumerate(product(rates, smooths, duties))]
    table = spark.createDataFrame(combos, "combo long, rate double, smooth double, duty double").withColumn("seed_base", F.lit(first_seed) + F.col("combo") * stride)
    table = table.withColumn("combo_id", text.combo_tag(F.lit(run), F.col("rate"), F.col("smooth"), F.col("duty"), F.col("seed_base")))
    n = sets.count()
    if not n:
        raise ValueError("no parameter sets")
    share = 1.0 / n if noise_fraction is None else float(noise_fraction)
    base = F.replace(F.regexp_replace(F.regexp_replace("name", "^.*/", ""), "[.][^.]*$", ""), F.lit("param_samples_"), F.lit(""))
    tag = F.concat(text.sanitized(F.lit(prefix)), F.lit("_"), base, F.lit("__"), "combo_id")
    return sets.crossJoin(F.broadcast(table)).select("combo", "combo_id", "rate", "smooth", "duty", "seed_base", "place", tag.alias("tag"), (F.col("seed_base") + F.col("place")).alias("noise_seed"), F.lit(share).alias("noise_fraction"))


def model_by_tag(models: DataFrame, tag: str, one: bool = False) -> DataFrame:
    """Models(model, has_checkpoint, run_tag, synthetic) with a checkpoint whose name is the tag; if there is none, those that were trained
    under the tag or from synthetic data of it. With `one`, none or more than one is an error."""
    usable = models.where("has_checkpoint")
    named = F.col("model").cast("string") == tag
    tagged = F.coalesce((F.col("run_tag") == tag) | F.exists("synthetic", lambda e: e == tag), F.lit(False))
    rank = usable.where(named | tagged).withColumn("direct", named).withColumn("any", F.max(named).over(W.partitionBy(F.lit(0))))
    found = rank.where(F.col("direct") | ~F.col("any")).drop("direct", "any")
    if one:
        n = found.limit(2).count()
        if n != 1:
            raise ValueError(f"{'no model' if n == 0 else 'more than one model'} for {tag}")
    return found
